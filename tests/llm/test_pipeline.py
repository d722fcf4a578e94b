"""The pipeline against a plain version of its stages, and its parts missing."""

import re
from collections import defaultdict

import corpus_pipeline
from conftest import SF_DIR
from rows import DOCS, clashing, empty

from rasterlake.llm import langid, mixing, pieces


def shingles(text, size=5):
    """The set of a text's word shingles; the whole sequence if it is shorter."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def one_of_each_group(texts):
    """The smallest id of each group of texts linked by a similarity of 0.8 or more, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ordered = sorted(texts)
    for n, a in enumerate(ordered):
        for b in ordered[:n]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in texts}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.train(docs)
    kept = {r.doc_id for r in langid.identify(docs, model).collect() if not r.rejected}
    last = {}
    for i in sorted(kept):
        last[rows[i].text] = i
    kept = set(last.values())
    kept = one_of_each_group({i: rows[i].text or "" for i in kept})
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or "")) for i in kept}
    plan = {r.doc_id: r.passes for r in mixing.plan_passes(docs.filter(docs.doc_id.isin(list(kept)))).collect()}
    assert set(plan) == kept and all(plan[i] == 0 for i in kept if not sizes[i])

    got = corpus_pipeline.run(spark, SF_DIR).collect()
    found = defaultdict(int)
    for r in got:
        found[r.doc_id] += 1
        assert r.round_trip
    assert found == {i: n for i, n in plan.items() if n}
    codec = pieces.codec(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    assert all(list(codec.encode(rows[r.doc_id].text)) == r.ids for r in got)


def test_stages_on_odd_and_empty_rows(spark):
    for table in (clashing(spark).withColumnRenamed("score", "extra").withColumnRenamed("rejected", "n_chars"), empty(spark)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == table.columns, name
            docs = spark.createDataFrame(out.collect(), table.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert len(DOCS) == 12


def test_positions_keep_the_order_of_the_mix(spark, tmp_path):
    """The mix written and read again, where files come back by size: positions give the order in which it was sorted."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mixing.mix_documents(docs).collect()
    mixing.mix_documents(docs).write.parquet(str(tmp_path / "mix"))
    encoded = corpus_pipeline.encode_texts(spark, spark.read.parquet(str(tmp_path / "mix")), SF_DIR).collect()
    assert len({r.position for r in encoded}) == len(rows)
    assert [r.doc_id for r in sorted(encoded, key=lambda r: r.position)] == [r.doc_id for r in rows]
