"""Phrase collocations by Toivonen's mining of frequent phrases.

A phrase can be frequent only if the phrases without its first and without its last word are. A sample of the documents is mined at a
lowered support, level by level, and proposes phrases. One pass over all documents then counts the proposed phrases and their negative
border: every phrase that occurs, was not proposed, and whose parts without first and without last word both were; for single words, every
word that was not proposed. If no phrase of the border is frequent, all frequent phrases are known with their exact counts. Otherwise they
join the known ones and further passes count what their border adds, until none is frequent. The sample decides how many passes there
are and never what is found.

The known phrases form a trie that a task walks for all its words at once with numpy; identities are numbers of words and nodes, not
hashes, so counts are exact. Tasks add up before they send: one row per node, and one per border phrase or word and some million words.
The trie is handed to the tasks while it has at most ``NODES`` nodes, which is checked; a node takes 20 bytes in a task that counts and 32
on the driver, where no phrase is ever spelled out. Beyond that all phrases are counted by a shuffle, with the same result.

Defined cases: a null text is empty, a null language is ``und``; words are cut at spaces and tabs only, pieces at the marks below; a text
without words adds nothing; repeated rows count as often as they are there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.hotkeys import first_per_key, lookup
from ..session import cut_lineage
from .common import slices, sized, small_batches, text_or_empty

SUPPORT = 100
LONGEST = 5
TOP = 2000
SHARE = 8  # one document in so many is in the sample
LOWERED = 0.7  # of the support expected there
NODES = 8_000_000
TASKS = 96  # of a pass at least, if the table has as many: each sends the counts of nearly all nodes
SENT = 1 << 20  # counts of nodes sent in a batch
HELD = 400_000  # border rows and words that a task holds before it sends them on
PARTS = 64
UNKNOWN, BREAK, NOTHING = -1, -2, -3
SHIFT = 31
# One step for every byte: capitals to small letters, marks that end a piece to line ends, tabs to spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a text with a line end between pieces; there may be empty words, which are none."""
    return text.translate(FOLDED).replace(b"\n", b" \n ").split(b" ")


class Trie:
    """Known phrases: nodes of single words by language, and nodes of longer ones by their first part's node and last word's node."""

    def __init__(self) -> None:
        self.first: dict[str, dict[bytes, int]] = {}
        self.parent = np.empty(0, np.int32)  # -1 for a single word
        self.last = np.empty(0, np.int32)
        self.count = np.empty(0, np.int64)
        self._index()

    def __len__(self) -> int:
        return self.size

    def _index(self) -> None:
        self.size = len(self.parent)
        longer = np.flatnonzero(self.parent >= 0).astype(np.int32)
        keys = self.parent[longer].astype(np.int64) << SHIFT | self.last[longer]
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], longer[order]

    def _add(self, parent: np.ndarray, last: np.ndarray, count: np.ndarray) -> None:
        self.parent = np.concatenate([self.parent, parent.astype(np.int32)])
        self.last = np.concatenate([self.last, last.astype(np.int32)])
        self.count = np.concatenate([self.count, count])
        self._index()

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), UNKNOWN)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.nodes[at].astype(np.int64), UNKNOWN)

    def grow(self, found: pa.Table) -> None:
        """Add frequent single words (lang, word) and longer phrases (key) with their counts ``n``."""
        longer = pc.is_valid(found.column("key"))
        singles, found = found.filter(pc.invert(longer)), found.filter(longer)
        base = len(self)
        for n, (lang, word) in enumerate(zip(singles.column("lang").to_pylist(), singles.column("word").to_pylist())):
            self.first.setdefault(lang, {})[word] = base + n
        keys, single = found.column("key").to_numpy(), np.arange(base, base + singles.num_rows)
        self._add(
            np.concatenate([np.full(len(single), -1), keys >> SHIFT]), np.concatenate([single, keys & ((1 << SHIFT) - 1)]),
            np.concatenate([singles.column("n").to_numpy(), found.column("n").to_numpy()]),
        )

    def grow_longer(self, found: list[bytes], times: np.ndarray) -> None:
        """Add frequent phrases given by the nodes of their words; the first part of each is known or among them."""
        size = np.array([len(f) // 4 for f in found], np.int64)
        for longest in range(2, int(size.max(initial=0)) + 1):
            at = np.flatnonzero(size == longest)
            nodes = np.frombuffer(b"".join(found[i] for i in at), "<i4").reshape(-1, longest).astype(np.int64)
            parent = nodes[:, 0]
            for n in range(1, longest - 1):
                parent = self.find(parent << SHIFT | nodes[:, n])
            self._add(parent, nodes[:, -1], times[at])

    def keep(self, kept: np.ndarray) -> None:
        """Only the nodes of the mask; parts of a kept phrase are kept, since they are as frequent."""
        number = np.cumsum(kept, dtype=np.int32) - 1
        self.first = {
            lang: {w: int(number[n]) for w, n in known.items() if kept[n]} for lang, known in self.first.items()
        }
        parent, last = self.parent[kept], self.last[kept]
        self.parent = np.where(parent >= 0, number[parent], np.int32(-1))
        self.last, self.count = number[last], self.count[kept]
        self._index()

    def phrases(self, spark: SparkSession) -> DataFrame:
        """``lang``, ``phrase``, ``words`` (how many) and ``f`` of every node, spelled out by the tasks."""
        singles = np.concatenate([np.fromiter(of.values(), np.int64, len(of)) for of in [*self.first.values(), {}]])
        place = np.empty(len(self), np.int32)  # of a single word's node in the three lists
        place[singles] = np.arange(len(singles))
        own = pa.array([w for of in self.first.values() for w in of], pa.large_binary())
        langs, sizes = list(self.first), [len(of) for of in self.first.values()]
        handed = spark.sparkContext.broadcast((self.parent, self.last, self.count, place, own, langs, np.repeat(np.arange(len(langs)), sizes)))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parent, last, count, place, own, langs, of = handed.value
            for batch in slices(batches, 1 << 14):
                at = node = batch.column("id").to_numpy()
                words = np.ones(len(at), np.int32)
                text = own.take(pa.array(place[last[node]]))
                while True:
                    longer = parent[node] >= 0
                    if not longer.any():
                        break
                    words += longer
                    node = np.where(longer, parent[node], node)
                    before = pc.binary_join_element_wise(own.take(pa.array(place[last[node]])), text, pa.scalar(b" ", pa.large_binary()))
                    text = pc.if_else(pa.array(longer), before, text)
                lang = pa.array(langs, pa.string()).take(pa.array(of[place[node]]))
                yield pa.RecordBatch.from_arrays(
                    [lang, text.cast(pa.binary()).cast(pa.string()), pa.array(words), pa.array(count[at])], ["lang", "phrase", "words", "f"]
                )

        return spark.range(len(self)).mapInArrow(step, "lang string, phrase string, words int, f bigint")


class _Held:
    """Counts of border phrases and unknown words that a task holds."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0
        self.words: dict[str | None, Counter] = {}

    def add(self, keys: np.ndarray) -> None:
        found, times = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.times.append(times)
        self.size += len(found)

    def rows(self) -> pa.RecordBatch:
        keys = np.concatenate([np.empty(0, np.int64), *self.keys])
        found, place = np.unique(keys, return_inverse=True)
        times = np.bincount(place, np.concatenate([np.empty(0, np.int64), *self.times]), len(found)).astype(np.int64)
        lang = [name for name, of in self.words.items() for _ in of]
        word = [w for of in self.words.values() for w in of]
        n = [c for of in self.words.values() for c in of.values()]
        self.__init__()
        return _rows(found, times, lang, word, n)

    def full(self) -> bool:
        return self.size + sum(map(len, self.words.values())) > HELD


def _rows(keys: np.ndarray, times: np.ndarray, lang: list[str | None], word: list[bytes | None], n: list[int]) -> pa.RecordBatch:
    none = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array([None] * none + lang, pa.string()), pa.array([None] * none + word, pa.binary()),
         pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(len(n), pa.int64())]),
         pa.concat_arrays([pa.array(times, pa.int64()), pa.array(n, pa.int64())])],
        ["lang", "word", "key", "n"],
    )


ROWS = "lang string, word binary, key bigint, n bigint"
_HERE: dict[str, Trie] = {}


def _pass(texts: DataFrame, trie: Trie, new_from: int, first: bool, longest: int, leap: bool = False) -> DataFrame:
    """One pass over ``texts`` (lang, text): rows (lang, word, key, n), of which many may have the same key.

    ``key`` of a border phrase is its first part's node and last word's node. In the first pass unknown words are counted too, known nodes
    (key -1 - node), and all words of a language (no word, no key). Later passes look only at phrases with a part from ``new_from`` on;
    with ``leap`` at all phrases that contain one and whose parts may be frequent, which are named by their words' nodes (no language).
    """
    spark = texts.sparkSession
    handed = spark.sparkContext.broadcast((trie.first, trie.keys, trie.nodes, len(trie)))
    here = uuid.uuid4().hex

    def known() -> Trie:
        if here not in _HERE:
            _HERE.clear()
            own = Trie()
            own.first, own.keys, own.nodes, own.size = handed.value
            for of in own.first.values():
                of[b"\n"], of[b""] = BREAK, NOTHING
            _HERE[here] = own
        return _HERE[here]

    def around_new(trie: Trie, word: np.ndarray, held: _Held) -> None:
        """Count what is unknown around new phrases: where a part is neither known nor holds a new one, no longer phrase is frequent."""
        node, may, new = word, word >= 0, word >= new_from
        for size in range(2, longest + 1):
            may, new = may[:-1] & may[1:], new[:-1] | new[1:]
            at = np.flatnonzero((node[:-1] >= 0) & may)
            met = np.full(len(may), UNKNOWN)
            met[at] = trie.find(node[at] << SHIFT | word[at + size - 1])
            node, new = met, new | (met >= new_from)
            may &= (node >= 0) | new
            at = np.flatnonzero(may & (node < 0))
            if len(at):
                phrases = word[at[:, None] + np.arange(size)].astype("<i4").tobytes()
                held.words.setdefault(None, Counter()).update(phrases[i:i + 4 * size] for i in range(0, len(phrases), 4 * size))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = known(), _Held()
        seen, totals = np.zeros(len(trie) if first else 0, np.int64), Counter()
        for batch in slices(batches, 128):
            parts = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                of = trie.first.setdefault(lang, {b"\n": BREAK, b"": NOTHING})
                tokens = words(text.as_py())
                found = np.fromiter(map(of.get, tokens, repeat(UNKNOWN)), np.int64, len(tokens))
                if first:
                    missed = np.flatnonzero(found == UNKNOWN).tolist()
                    if missed:
                        held.words.setdefault(lang, Counter()).update(map(tokens.__getitem__, missed))
                    totals[lang] += int((found >= UNKNOWN).sum())
                parts += [found[found != NOTHING], [BREAK]]
            word = np.concatenate(parts) if parts else np.empty(0, np.int64)
            node = word
            if first:
                np.add.at(seen, node[node >= 0], 1)  # its work is that of the words, not of the nodes
            if leap:
                around_new(trie, word, held)
                if held.full():
                    yield held.rows()
                continue
            for size in range(2, longest + 1):
                here_too, beside = node[:-1], node[1:]
                at = np.flatnonzero((here_too >= 0) & (beside >= 0))
                keys = here_too[at] << SHIFT | word[at + size - 1]
                met = trie.find(keys)
                border = met < 0
                if not first:
                    border &= (here_too[at] >= new_from) | (beside[at] >= new_from)
                if border.any():
                    held.add(keys[border])
                node = np.full(len(here_too), UNKNOWN)
                node[at] = met
                if first:
                    np.add.at(seen, met[met >= 0], 1)
            if held.full():
                yield held.rows()
        yield held.rows()
        if first:
            for begin in range(0, len(seen), SENT):
                at = begin + np.flatnonzero(seen[begin:begin + SENT])
                yield _rows(-1 - at, seen[at], [], [], [])
            yield _rows(seen[:0], seen[:0], list(totals), [None] * len(totals), list(totals.values()))

    return texts.coalesce(max(TASKS, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(step, ROWS)


def _summed(rows: DataFrame, least: int) -> DataFrame:
    """Sums by key; what is not frequent goes, but for the totals of languages."""
    sums = rows.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    return sums.filter((F.col("n") >= least) | (F.col("key").isNull() & F.col("word").isNull()))


class TooMany(Exception):
    """The frequent phrases are more than a task should hold."""


def _close(texts: DataFrame, trie: Trie, support: int, longest: int, nodes: int, leap: bool) -> dict[str, int]:
    """Make ``trie`` hold exactly the phrases of ``texts`` that occur ``support`` times or more; the number of words by language.

    Without ``leap`` every pass after the first adds phrases longer by a word, with it one adds all.
    """
    totals: dict[str, int] = {}
    first, new_from = True, 0
    while True:
        found = cut_lineage(_summed(_pass(texts, trie, new_from, first, longest, leap and not first), support))
        if found.count() + len(trie) > 2 * nodes:
            raise TooMany
        rows = found.toArrow()
        if first:
            is_total = pc.and_(pc.is_null(rows.column("key")), pc.is_null(rows.column("word")))
            sums = rows.filter(is_total)
            totals = dict(zip(sums.column("lang").to_pylist(), sums.column("n").to_pylist()))
            is_known = pc.fill_null(pc.less(rows.column("key"), 0), False)
            met, rows = rows.filter(is_known), rows.filter(pc.invert(pc.or_(is_total, is_known)))
            trie.count = np.zeros(len(trie), np.int64)
            trie.count[-1 - met.column("key").to_numpy()] = met.column("n").to_numpy()
        if first:
            # Border keys name nodes, so they are added before the nodes are numbered anew.
            old = len(trie)
            trie.grow(rows)
            kept = trie.count >= support
            new_from = int(kept[:old].sum())
            trie.keep(kept)
        elif leap:
            trie.grow_longer(rows.column("word").to_pylist(), rows.column("n").to_numpy())
            new_from = len(trie)
        else:
            new_from = len(trie)
            trie.grow(rows)
        first = False
        if len(trie) > nodes:
            raise TooMany
        if len(trie) == new_from:
            return totals


def count_by_shuffle(texts: DataFrame, support: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """The same two tables as ``frequent_phrases`` from all phrases, without a limit on how many are frequent."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            lang, piece = [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for part in text.as_py().translate(FOLDED).split(b"\n"):
                    own = [w.decode() for w in part.split(b" ") if w]
                    if own:
                        lang.append(name)
                        piece.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(piece, pa.list_(pa.string()))], ["lang", "w"])

    pieces = texts.mapInArrow(step, "lang string, w array<string>")
    totals = pieces.groupBy("lang").agg(F.sum(F.size("w")).alias("n"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w")))
    every = pieces.select("lang", "w", F.explode(sizes).alias("words")).select(
        "lang", "words",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("words") + 1), lambda i: F.array_join(F.slice("w", i, F.col("words")), " "))).alias("phrase"),
    )
    counts = every.groupBy("lang", "phrase", "words").agg(F.count("*").alias("f")).filter(F.col("f") >= support)
    return cut_lineage(counts.select("lang", "phrase", "words", "f")), totals


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, share: int = SHARE, lowered: float = LOWERED, nodes: int = NODES,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that occur ``support`` times or more (lang, phrase, words, f), and all words by language (lang, n)."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).cast("binary").alias("text")
    texts = docs.select(*wanted)
    trie = Trie()
    try:
        # By id and text: of equal texts with different ids a share is taken, not all or none.
        sample = docs.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(share)) == 0).select(*wanted)
        _close(sample, trie, max(2, int(support * lowered / share)), longest, nodes, leap=False)
        totals = _close(texts, trie, support, longest, nodes, leap=True)
    except TooMany:
        return count_by_shuffle(texts, support, longest)
    return (
        trie.phrases(spark),
        spark.createDataFrame(list(totals.items()), "lang string, n bigint"),
    )


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, **options) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the first ``top`` phrases of each language.

    A phrase's score is that of its weakest cut, floor(1000 * a * n / (l * r)); phrases that lie inside a longer one as frequent go.
    """
    return scored(*frequent_phrases(docs, support, longest, **options), top)


def scored(known: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The result of ``collocations`` from the two tables of ``frequent_phrases``."""
    known = cut_lineage(known)
    w = F.split("phrase", " ")
    candidates = known.filter("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), w.alias("w"))

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail")
    )
    # Common words head many phrases: both lookups are safe for hot keys.
    for name, out in (("head", "l"), ("tail", "r")):
        cuts = lookup(cuts, known.select("lang", F.col("phrase").alias(name), F.col("f").alias(out)), ["lang", name], ["phrase"])
    exact = cuts.join(sized(totals), "lang").withColumn(
        "score", F.expr("(1000BD * cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    )
    weakest = exact.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")
    )
    inside = candidates.filter("words > 2").select(
        "lang", "w", "a", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    ).select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start")).groupBy(
        "lang", part(F.col("start"), F.col("size")).alias("phrase")
    ).agg(F.max("a").alias("longer"))
    left = weakest.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < cut.a").select("lang", "phrase", "cut.*")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    dealt = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = first_per_key(dealt, ["lang", "part"], top, order, "place")
    ranked = first_per_key(few, ["lang"], top, order, "rank")
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
