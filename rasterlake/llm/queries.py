"""The numbered queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, exact_dedup, html_text, langid, lexical, mixing, packing, pieces, pii, simhash, token_counts, topk
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h
  FROM documents),
r AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r),
t AS (SELECT source, w, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * w) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.w,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id) - d.size / 2 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN size > 0 THEN CAST(least(greatest(floor((target - middle) / source_size) + 1, 0), 3) AS BIGINT) ELSE 0 END AS n FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(n * size AS BIGINT) AS taken FROM q"""


@query("op2_source_mixing", MIX_SQL)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(table(spark, sf_dir, "documents"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """One row per document in training order; rows that are the same are taken together and come back each."""
    plan = mixing.plan_passes(docs).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return plan.sort("positions", "h").select(
        "doc_id", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken")
    )


@query(
    "op4_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"), simhash.Rule(shingle=4, words=1, distance=4))
    return found.drop("text_hash")


@query("op1_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html_text.extract(table(spark, sf_dir, "pages"))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*pii.BASE)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


@query("op6_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    marked = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    casts = [F.col(f.name).cast(f.dataType).alias(f.name) for f in turns.schema]
    return chat.read_back(chat.format_conversations(turns.unionByName(marked.select(*casts))))


@query("op5_sentencepiece")
def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_token_counts")
def token_counts_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def held_out() -> Column:
    """A null id counts as the empty text, which is not held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row_id, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.row_id <> c.row_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""


@query("op7_exact_top_k", TOP_SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    return topk.search(rows.select("vec_id", topk.scaled(F.col("embedding")).alias("embedding")), F.col("vec_id") % 50 == 0, k=5)


@query("op11_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


RANK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS words
  FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(words)) AS n_terms FROM d WHERE len(words) > 0),
t AS (SELECT DISTINCT unnest(words) AS term FROM i),
o AS (SELECT row_id, doc_id, len(words) AS n, unnest(words) AS term FROM d),
tf AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM o SEMI JOIN t USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, g GROUP BY term, n_docs),
p AS (SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n * n_docs) // n_terms AS BIGINT)))) AS part
      FROM tf JOIN w USING (term), g),
s AS (SELECT item_id, row_id, doc_id, CAST(sum(part) AS BIGINT) AS score
      FROM (SELECT item_id, unnest(words) AS term FROM i) JOIN p USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


@query("op12_ranked_lexical_search", RANK_SQL)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PHRASE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
k AS (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS k FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (SELECT x.lang, x.phrase, a, x.k, h.f AS l, r.f AS r, n,
             CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(h.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM x JOIN t USING (lang)
      JOIN f h ON h.lang = x.lang AND h.phrase = array_to_string(w[1:x.k], ' ')
      JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[x.k + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[b:b + size - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, words - size + 2)) AS b FROM (SELECT *, unnest(range(2, words)) AS size FROM c)) GROUP BY 1, 2),
z AS (SELECT m.* FROM m LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= 2000"""


@query("op13_phrase_collocations", PHRASE_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
