"""Ranked lexical search by scanning documents with an Aho-Corasick automaton of all items' terms.

There is no index of the documents. A text is brought to a plain form in which every sign between terms is one space and spaces stand
around it; the automaton's words are the items' terms between two spaces, so that it finds whole terms only (neighbours share a space).
One scan gives how often each term occurs in each document, and one small row per document goes on: its length in terms and the terms of
items that it holds. The numbers of documents, of all terms and of documents by term are summed from these rows. A second pass turns them
into scores, block by block: the table of terms by items maps what the automaton found to the items, and every task keeps the best k of
each item only, which are merged at last.

Items are handled ``ITEMS`` at a time, or fewer if their texts are long, so that what a task holds and what is broadcast is bounded however
many items there are; more items mean further scans. Scores are whole numbers: every sum stays below 2**53, so it is exact in doubles too.

Defined cases: a null text has no terms; an item without terms has no results; a null item id counts as any other; rows repeated in the
documents are documents of their own; equal scores go to the smaller id, null ids last; the order of repeated ids is that of their
lengths; an empty table of either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hotkeys import first_per_key
from ..session import cut_lineage
from .common import slices, small_batches

ITEMS = 1024
TEXT_BYTES = 1 << 20  # of the items of one scan
K = 10
ROWS = 256  # documents whose scores are worked out at a time
COLUMNS = 4096  # and terms
# One step for every byte: capitals to small letters, signs of ASCII between terms to spaces, all else as it is.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def signs(plain: bytes) -> str:
    """Bytes as signs, one each, which is what the automaton reads."""
    return plain.decode("latin-1")


def terms_of(text: str | None) -> list[str]:
    """Distinct terms in order of their first place, as byte signs."""
    return [signs(t) for t in dict.fromkeys((text or "").encode().translate(PLAIN).split())]


class Terms:
    """The terms of some items, numbered, and which item has which."""

    def __init__(self, texts: list[str | None]):
        self.of_item = [terms_of(t) for t in texts]
        self.numbers = {t: n for n, t in enumerate(dict.fromkeys(t for terms in self.of_item for t in terms))}

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, number in self.numbers.items():
            found.add_word(f" {term} ", number)
        found.make_automaton()
        return found

    def items_by_term(self) -> tuple[np.ndarray, np.ndarray]:
        """The items of term t are ``items[starts[t]:starts[t + 1]]``."""
        pairs = [(self.numbers[t], item) for item, terms in enumerate(self.of_item) for t in terms]
        term, item = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        return np.searchsorted(term, np.arange(len(self.numbers) + 1)), item


def item_scores(rows: int, row: np.ndarray, term: np.ndarray, parts: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int) -> np.ndarray:
    """Documents by items: the sums of what each term of a document adds to the items that have it, some thousand terms at a time."""
    used, place = np.unique(term, return_inverse=True)
    out = np.zeros((rows, n_items))
    for low in range(0, len(used), COLUMNS):
        now = used[low:low + COLUMNS]
        inside = (place >= low) & (place < low + len(now))
        values = np.zeros((rows, len(now)))
        values[row[inside], place[inside] - low] = parts[inside]
        each = starts[now + 1] - starts[now]
        flat = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[now], each)
        members = np.zeros((len(now), n_items))
        members[np.repeat(np.arange(len(now)), each), items[flat]] = 1
        out += values @ members
    return out


_SCANS: dict[str, tuple] = {}


def _once(key: str, build):
    """``build()`` once per worker and scan; the one before it is let go."""
    if key not in _SCANS:
        _SCANS.clear()
        _SCANS[key] = build()
    return _SCANS[key]


def count_terms(docs: DataFrame, terms: Terms, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` (numbers) and ``tf`` of every document with a term of its own."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scan = uuid.uuid4().hex

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _once(scan, terms.automaton)
        any_terms = len(terms.numbers) > 0
        for batch in slices(batches):
            at, lengths, found, times = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                plain = text.as_py().translate(PLAIN)
                n = len(plain.split())
                if n:
                    counts = Counter(map(itemgetter(1), automaton.iter(f" {signs(plain)} "))) if any_terms else {}
                    at.append(row)
                    lengths.append(n)
                    found.append(list(counts.keys()))
                    times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tf"],
            )

    return rows.mapInArrow(step, f"doc_id {kind}, n bigint, terms array<int>, tf array<bigint>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _best(scores: np.ndarray, ids: pa.Array, lengths: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the best k scores above 0: the order of the result, with enough rows kept at a tie."""
    rows = np.flatnonzero(scores > 0)
    if len(rows) > k:
        bar = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= bar]
    if len(rows) <= k:
        return rows
    tied = pa.table({"s": scores[rows], "i": ids.take(pa.array(rows)), "n": lengths[rows]})
    return rows[pc.sort_indices(tied, [("s", "descending"), ("i", "ascending"), ("n", "ascending")]).to_numpy()[:k]]  # null ids go last


def best_documents(counted: DataFrame, terms: Terms, weights: np.ndarray, documents: int, all_terms: int, k: int = K) -> DataFrame:
    """``item`` (number), ``doc_id``, ``n``, ``score``: at least the best k of each item, from each task its own best."""
    kind = counted.schema["doc_id"].dataType.simpleString()
    scan = uuid.uuid4().hex

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, of_term = _once(scan, terms.items_by_term)
        names = ["item", "doc_id", "n", "score"]
        kept: pa.Table | None = None

        def trimmed(parts: list[pa.Table]) -> pa.Table:
            """The best k of every item."""
            every = pa.concat_tables(parts).sort_by(
                [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("n", "ascending")]
            )
            item = every.column("item").to_numpy()
            first = np.flatnonzero(np.diff(item, prepend=-1))
            place = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
            return every.filter(pa.array(place < k))

        for batch in slices(batches, ROWS):
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            lists = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            column = lists.flatten().to_numpy()
            tf = batch.column("tf").flatten().to_numpy()
            m = 10 + (90 * n * documents) // all_terms
            parts = weights[column] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            scores = item_scores(batch.num_rows, row, column, parts, starts, of_term, len(terms.of_item))
            items, rows = [], []
            for item in np.flatnonzero(scores.max(axis=0, initial=0) > 0):
                best = _best(scores[:, item], batch.column("doc_id"), n, k)
                items.append(np.full(len(best), item))
                rows.append(best)
            if not rows:
                continue
            at, item = np.concatenate(rows), np.concatenate(items)
            found = pa.table(
                [pa.array(item, pa.int32()), batch.column("doc_id").take(pa.array(at)), pa.array(n[at]), pa.array(scores[at, item].astype(np.int64))],
                names=names,
            )
            kept = trimmed([found] if kept is None else [kept, found])
        if kept is not None:
            yield from kept.to_batches()

    return counted.mapInArrow(step, f"item int, doc_id {kind}, n bigint, score bigint")


def _search_items(docs: DataFrame, texts: list[str | None], k: int, id_col: str, text_col: str) -> DataFrame:
    """``item`` (number), ``rank``, ``doc_id``, ``score`` for a bounded number of items: two passes, of which the first reads the texts."""
    terms = Terms(texts)
    longest = max(map(len, terms.of_item), default=0)
    counted = cut_lineage(count_terms(docs, terms, id_col, text_col))
    documents, all_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(terms.numbers), np.int64)
    for term, df in holding.toLocalIterator():  # one row per term of the items at most
        weights[term] = weight(documents, df)
    if int(weights.max(initial=0)) * 1_000_000 * longest >= 2**53:
        raise ValueError("an item has too many terms for exact sums")
    found = best_documents(counted, terms, weights, documents, all_terms, k)
    ranked = first_per_key(found, ["item"], k, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n"], "rank")
    return ranked.select("item", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", per_scan: int = ITEMS, scan_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of each item's best k documents with a score above 0."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kind = wanted.schema["item_id"].dataType.simpleString()
    parts: list[DataFrame] = []

    def scan(group: list) -> None:
        found = _search_items(docs, [r.text for r in group], k, id_col, text_col)
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(group)], f"item int, item_id {kind}")
        parts.append(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))

    group, size = [], 0
    for row in wanted.toLocalIterator():  # the items pass the driver in parts; no more than one scan's are held
        bytes_of = len((row.text or "").encode())
        if group and (len(group) == per_scan or size + bytes_of > scan_bytes):
            scan(group)
            group, size = [], 0
        group.append(row)
        size += bytes_of
    if group or not parts:
        scan(group)
    return functools.reduce(DataFrame.unionByName, parts)
