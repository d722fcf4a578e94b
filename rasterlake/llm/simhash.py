"""Near-duplicates by SimHash fingerprints and a segment-popcount embedding.

A fingerprint of 64 or 128 bits is mapped to its popcounts per segment of 2 bits. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints. If two fingerprints differ in at most d bits and are cut into (d + 1) / 3 parts, rounded
up, one part differs in at most 2 bits, so its count vectors are at most 2 apart and meet in a grid cell at most 1 away from both. Every
fingerprint is put into these cells of each part, and the members of a cell are compared exactly. Only distinct fingerprints take part,
so copies cost nothing; a cell gives a star for each connected group of its members and never all pairs.

Cells that hold very many fingerprints (found by a Misra-Gries summary, counted exactly, a bounded number) are cut into chunks and
compared chunk against chunk in separate groups, so no link is lost and no task gets the whole cell.

A rule with ``of_set`` links texts by the exact Jaccard similarity of their sets of shingles, at least ``SIMILARITY``. Candidates are
pairs of fingerprints within the rule's distance, which is far above the one expected at ``SIMILARITY``. Those at most ``GRID`` bits apart
meet in the grid cells. Cells for the whole distance would be so wide that nearly all meet in them, so the pairs beyond ``GRID`` meet at
keys: two sets that are similar share one of the smallest fifth of either one's hashes, so no pair is missed there. The sets of each
component of candidates are then compared exactly, large components chunk against chunk.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any other; documents with a
null id belong to their component but never name it, unless all its ids are null; repeated rows get equal results, and one of them
stays in ``drop_near_copies``; other columns pass through under any name; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, remove, shared_dir, write_and_read
from .common import sized, slices, small_batches, text_or_empty, without

HASH_BLOCK = 1 << 16
FEW = 8  # groups up to this size are compared row against row for a whole batch at once
MATRIX = 1024  # groups up to this size are compared as one matrix
HOT_CELLS = 1000
HOT_SIZE = 20_000
SIMILARITY = (4, 5)  # 0.8
GRID = 11  # bits that the cells of a rule of sets cover: four parts of 32 bits
COMPARED = 4 << 20  # bytes of sets compared in one group


class Rule(NamedTuple):
    """What a fingerprint is made of and how far linked ones may be apart."""

    shingle: int
    words: int  # of 64 bits
    distance: int
    of_set: bool = False  # repeated shingles count once, and candidates are verified by the sets

    def digest(self) -> Callable[[memoryview], bytes]:
        return (lambda x: xxhash.xxh64_digest(x, 42)) if self.words == 1 else (lambda x: xxhash.xxh3_128_digest(x, 42))

    def parts(self) -> list[tuple[int, int, int]]:
        """Word, first bit and bits of each part; parts have whole segments and lie within a word."""
        per_word = -(-(-(-(self.distance + 1) // 3)) // self.words)
        borders = [2 * round(32 * p / per_word) for p in range(per_word + 1)]
        return [(w, a, b - a) for w in range(self.words) for a, b in zip(borders, borders[1:])]


# Five words. Sets with a Jaccard similarity of 0.8 are expected 19.4 of 128 bits apart, with a deviation of 4.1; 32 bits leave 3 of those.
SIMILAR = Rule(shingle=5, words=2, distance=32, of_set=True)


def shingle_hashes(data: bytes, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the text's shingles and their hashes as rows of bytes, block by block; A-Z are read as a-z and words end at white space."""
    words = data.lower().split()
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - rule.shingle + 1)
    starts, ends = starts[:n], ends[min(rule.shingle, len(words)) - 1:]
    digest = rule.digest()
    for at in range(0, n, HASH_BLOCK):
        pairs = zip(starts[at:at + HASH_BLOCK].tolist(), ends[at:at + HASH_BLOCK].tolist())
        yield n, np.frombuffer(b"".join([digest(joined[s:e]) for s, e in pairs]), np.uint8).reshape(-1, 8 * rule.words)


def shingle_set(data: bytes, rule: Rule) -> np.ndarray:
    """The different hashes of a text's shingles in order, as rows of bytes."""
    found = [hashes for _, hashes in shingle_hashes(data, rule)]
    if not found:
        return np.zeros((0, 8 * rule.words), np.uint8)
    whole = np.concatenate(found)
    return whole[np.unique(first_word(whole), return_index=True)[1]]


def first_word(hashes: np.ndarray) -> np.ndarray:
    """The first 64 bits of each hash, by which the sets are ordered and compared."""
    return np.ascontiguousarray(hashes[:, :8]).view(">u8").ravel().astype(np.uint64)


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """So many of the smallest hashes of a set that any set as similar as SIMILARITY shares one of them; an empty set has the key 0."""
    own = np.unique(first_word(hashes))
    part, whole = SIMILARITY
    return own[:len(own) - -(-part * len(own) // whole) + 1] if len(own) else np.zeros(1, np.uint64)


def fingerprint(data: bytes, rule: Rule) -> bytes:
    """SimHash of the word shingles of a UTF-8 text, high bits first."""
    return of_set(shingle_set(data, rule), rule) if rule.of_set else _majority(shingle_hashes(data, rule), rule)


def of_set(hashes: np.ndarray, rule: Rule) -> bytes:
    return _majority(((len(hashes), hashes[at:at + HASH_BLOCK]) for at in range(0, len(hashes), HASH_BLOCK)), rule)


def _majority(blocks: Iterable[tuple[int, np.ndarray]], rule: Rule) -> bytes:
    counts, n = np.zeros(64 * rule.words, np.int64), 0
    for n, hashes in blocks:
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def names(rule: Rule, stem: str = "fp") -> list[str]:
    return [f"{stem}{w}" for w in range(rule.words)]


def text_hash(text_col: str) -> Column:
    """Tells rows with the same id apart."""
    return F.xxhash64(text_or_empty(text_col))


def fingerprints(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, the words of the fingerprint as signed longs, ``fp0``, ..., and the keys a rule of sets needs."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), text_or_empty(text_col).cast("binary").alias("data")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = names(rule)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("data").to_pylist()
            sets = [shingle_set(x, rule) for x in texts] if rule.of_set else []
            found = [of_set(x, rule) for x in sets] if rule.of_set else [fingerprint(x, rule) for x in texts]
            found = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, rule.words)
            own = [batch.column("doc_id"), batch.column("text_hash")]
            more = [_lists([keys_of(x).view(np.int64) for x in sets])] if rule.of_set else []
            yield pa.RecordBatch.from_arrays(
                [*own, *[pa.array(found[:, w]) for w in range(rule.words)], *more], ["doc_id", "text_hash", *columns, *["keys"] * len(more)]
            )

    schema = [f"doc_id {kind}, text_hash bigint", *[f"{c} bigint" for c in columns], *["keys array<bigint>"] * rule.of_set]
    return rows.mapInArrow(step, ", ".join(schema))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _columns(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in columns], axis=1).view(np.uint64)


def _in_cells(distinct: DataFrame, rule: Rule) -> DataFrame:
    """``key`` of each grid cell within 1 of a fingerprint's counts, for each part, with the fingerprint.

    The counts (0, 1 or 2) of a part are fields of 2 bits in one number, which is how they come out of the usual bit trick.
    """
    columns = names(rule)
    odd = np.uint64(0x5555555555555555)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            fps = _columns(batch, columns)
            for number, (word, first, bits) in enumerate(rule.parts()):
                part = fps[:, word] >> np.uint64(first) & np.uint64((1 << bits) - 1)
                cell = (part & odd) + (part >> np.uint64(1) & odd)
                keys, rows = [cell], [np.arange(len(cell))]
                for at in range(0, bits, 2):
                    count = cell >> np.uint64(at) & np.uint64(3)
                    for able, moved in ((count < 2, cell + np.uint64(1 << at)), (count > 0, cell - np.uint64(1 << at))):
                        rows.append(np.flatnonzero(able))
                        keys.append(moved[rows[-1]])
                key = (np.concatenate(keys) | np.uint64(number << 48)).view(np.int64)
                own = fps[np.concatenate(rows)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *[pa.array(own[:, w]) for w in range(rule.words)]], ["key", *columns]
                )

    return distinct.select(*columns).mapInArrow(step, ", ".join(["key bigint", *[f"{c} bigint" for c in columns]]))


def _near(a: np.ndarray, b: np.ndarray, distance: int, above: int = -1) -> np.ndarray:
    """Which rows of ``a`` and ``b``, broadcast against each other, are at most ``distance`` and more than ``above`` bits apart."""
    bits = np.bitwise_count(a[..., 0] ^ b[..., 0])
    for word in range(1, a.shape[-1]):
        bits = bits + np.bitwise_count(a[..., word] ^ b[..., word])
    return (bits <= distance) & (bits > above)


def _links(fps: np.ndarray, distance: int, above: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """For each member that has a linked one, but the first of its connected group: a pair of it and that first one."""
    n = len(fps)
    if n <= MATRIX:
        near = _near(fps[:, None], fps[None, :], distance, above)
        np.fill_diagonal(near, True)
        if np.count_nonzero(near) == n:
            return fps[:0], fps[:0]
        label = np.arange(n)
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(n)
        return fps[moved], fps[label[moved]]
    linked = np.zeros(n, dtype=bool)  # nearly all members of a large cell have no link at all
    for at in range(0, n, MATRIX):
        block = fps[at:at + MATRIX]
        for other in range(at, n, MATRIX):
            near = _near(block[:, None], fps[None, other:other + MATRIX], distance, above)
            if other == at:
                np.fill_diagonal(near, False)
            if near.any():
                linked[at:at + MATRIX] |= near.any(axis=1)
                linked[other:other + MATRIX] |= near.any(axis=0)
    left, heads, rest = [], [], fps[linked]
    while len(rest):  # grow one group at a time; what it reaches leaves the rest
        head, front, rest = rest[:1], rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), dtype=bool)
            for f in front[:256]:
                reached |= _near(rest, f[None, :], distance, above)
            left.append(rest[reached])
            heads.append(np.repeat(head, int(reached.sum()), axis=0))
            front = np.concatenate((front[256:], rest[reached]))
            rest = rest[~reached]
    return np.concatenate(left or [fps[:0]]), np.concatenate(heads or [fps[:0]])


def _verify(batches: Iterator[pa.RecordBatch], rule: Rule, above: int = -1) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key and chunk; gives links (a0, ..., b0, ...) between the members of a group."""
    columns, ends = names(rule), [*names(rule, "a"), *names(rule, "b")]
    held: list[np.ndarray] = []  # the group at the border of two batches
    held_key = None

    def out(a, b):
        if len(a):
            pairs = np.unique(np.concatenate((a, b), axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(len(ends))], ends)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, chunk, fps = batch.column("key").to_numpy(), batch.column("chunk").to_numpy(), _columns(batch, columns)
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))
        starts = np.append(np.flatnonzero(new), n)
        begin = 0
        if held:
            if (key[0], chunk[0]) == held_key:
                held.append(fps[:starts[1]])
                begin = 1
                if len(starts) == 2:
                    continue
            yield from out(*_links(np.concatenate(held), rule.distance, above))
        last = starts[-2]
        held, held_key = [fps[last:]], (key[last], chunk[last])
        sizes, where = np.diff(starts)[begin:-1], starts[begin:-2]
        for big in np.flatnonzero(sizes > FEW):
            yield from out(*_links(fps[where[big]:where[big] + sizes[big]], rule.distance, above))
        left, right = [], []
        for step in range(1, FEW):
            few = (sizes > step) & (sizes <= FEW)
            rows, size = where[few], sizes[few]
            for offset in range(FEW - step):
                i = rows[size > offset + step] + offset
                near = _near(fps[i], fps[i + step], rule.distance, above)
                left.append(fps[i + step][near])
                right.append(fps[i][near])
        yield from out(np.concatenate(left), np.concatenate(right))
    if held:
        yield from out(*_links(np.concatenate(held), rule.distance, above))


def vertex(columns: list[str]) -> Column:
    """A fingerprint's hex digits."""
    return F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in columns])


def links(distinct: DataFrame, rule: Rule, hot_size: int = HOT_SIZE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, in hex, whose closure is that of all pairs at most ``rule.distance`` bits apart."""
    return _linked(_in_cells(distinct, rule), rule, hot_size)


def _pairs_of_chunks(mine: Column, chunks: Column) -> Column:
    """The groups of all pairs of chunks that include ``mine``; one group where ``chunks`` is null."""
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda other: F.least(mine, other) * chunks + F.greatest(mine, other))
    return F.explode(F.when(chunks.isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("chunk")


def _linked(placed: DataFrame, rule: Rule, hot_size: int, above: int = -1) -> DataFrame:
    """Links between fingerprints of a ``key`` that are more than ``above`` bits apart."""
    proposed = placed.agg(F.expr(f"approx_top_k(key, {HOT_CELLS}, 65536)").alias("top")).select(F.explode("top.item").alias("key"))
    proposed = F.broadcast(cut_lineage(proposed))
    hot = (
        placed.join(proposed, "key", "left_semi")
        .groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_size)
        .select("key", F.ceil(F.col("n") / (hot_size / 2)).cast("int").alias("chunks"))
    )
    # A member of chunk c of a hot cell joins the groups of all pairs of chunks that include c.
    cut = placed.join(F.broadcast(cut_lineage(hot)), "key", "left")
    mine = F.pmod(F.xxhash64(*names(rule)), F.col("chunks")).cast("int")
    groups = cut.select("key", *names(rule), _pairs_of_chunks(mine, F.col("chunks")))
    schema = ", ".join(f"{c} bigint" for c in [*names(rule, "a"), *names(rule, "b")])
    found = groups.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(lambda x: _verify(x, rule, above), schema)
    return found.distinct().select(vertex(names(rule, "a")).alias("a"), vertex(names(rule, "b")).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): ``fp`` and ``root``, its smallest member, by alternating large and small stars.

    Stars need a logarithmic number of rounds in the length of a chain. Every round is written to the shared folder as a table, which goes
    when the next one is there. Minima are partial aggregates and written too, so that Spark can split the joins with them where a star's
    centre is hot.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}"
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = write_and_read(now, f"{folder}/0")
    before = None
    for number in count(1):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            found = cut_lineage(now.select(F.col("u").alias("fp"), F.col("v").alias("root")))
            remove(spark, folder)
            return found
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = write_and_read(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/{number}")
        remove(spark, f"{folder}/{number - 1}")


def set_links(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each set that has a similar one, but the first of its connected group: its place and that of the first one."""
    part, whole = SIMILARITY
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by_token = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]  # the sets of each token, token after token
    counts = np.bincount(ids, minlength=len(tokens))
    begins = np.cumsum(counts) - counts
    starts = np.cumsum(sizes) - sizes
    rest = np.ones(len(sets), bool)
    left, heads = [], []
    for head in range(len(sets)):
        if not rest[head]:
            continue
        rest[head], front = False, [head]
        while front and rest.any():
            f = front.pop()
            mine = ids[starts[f]:starts[f] + sizes[f]]
            mine = mine[counts[mine] > 1]
            lists = [by_token[a:b] for a, b in zip(begins[mine].tolist(), (begins[mine] + counts[mine]).tolist())]
            common = np.bincount(np.concatenate(lists or [by_token[:0]]), minlength=len(sets))
            near = np.flatnonzero(rest & (whole * common >= part * (sizes + sizes[f] - common)))
            rest[near] = False
            front += near.tolist()
            left += near.tolist()
            heads += [head] * len(near)
    return left, heads


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by root and chunk; gives links (a, b) between the similar units of a group."""
    held, held_key = [], None

    def out():
        left, heads = set_links([np.frombuffer(x, np.uint64) for _, x in held]) if len(held) > 1 else ([], [])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in left]), pa.array([held[i][0] for i in heads])], ["a", "b"])

    for batch in batches:
        for root, chunk, unit, data in zip(*[batch.column(c).to_pylist() for c in ("root", "chunk", "unit", "shingles")]):
            if (root, chunk) != held_key:
                yield from out()
                held, held_key = [], (root, chunk)
            held.append((unit, data))
    yield from out()


def similar_texts(docs: DataFrame, distinct: DataFrame, rule: Rule, text_col: str, hot_size: int, compared: int = COMPARED) -> DataFrame:
    """Links (a, b) between texts whose closure is that of all candidates with similar sets of shingles."""
    in_cells = _in_cells(distinct.select(*names(rule)).distinct(), rule._replace(distance=GRID))
    at_keys = distinct.select(F.explode("keys").alias("key"), *names(rule))
    near = components(_linked(in_cells, rule, hot_size).unionByName(_linked(at_keys, rule, hot_size, GRID)))
    units = distinct.select(vertex([*names(rule), "text_hash"]).alias("unit"), vertex(names(rule)).alias("fp"), "text_hash")
    units = cut_lineage(units.join(near, "fp", "left").select("unit", "text_hash", F.coalesce("root", "fp").alias("root")))
    large = sized(units.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"))
    members = sized(units.join(large, "root").select("unit", "text_hash", "root"))
    texts = docs.select(text_hash(text_col).alias("text_hash"), text_or_empty(text_col).cast("binary").alias("data"))
    texts = texts.join(members, "text_hash").select("unit", "root", "data")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [first_word(shingle_set(x, rule)).tobytes() for x in batch.column("data").to_pylist()]
            own = [batch.column(c) for c in ("unit", "root")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sets, pa.binary())], ["unit", "root", "shingles"])

    sets = texts.mapInArrow(step, "unit string, root string, shingles binary").dropDuplicates(["unit"])
    sets = cut_lineage(sets)
    cut = sets.groupBy("root").agg(F.sum(F.length("shingles")).alias("bytes")).filter(F.col("bytes") > compared)
    cut = sized(cut.select("root", F.ceil(F.col("bytes") / (compared / 2)).cast("int").alias("chunks")))
    mine = F.pmod(F.xxhash64("unit"), F.col("chunks")).cast("int")
    groups = sets.join(cut, "root", "left").select("root", "unit", "shingles", _pairs_of_chunks(mine, F.col("chunks")))
    return groups.repartition("root", "chunk").sortWithinPartitions("root", "chunk").mapInArrow(_compare, "a string, b string")


def near_copies(
    docs: DataFrame, rule: Rule = SIMILAR, id_col: str = "doc_id", text_col: str = "text", hot_size: int = HOT_SIZE
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex digits), ``component_id`` (smallest id of its component), ``text_hash``."""
    rows = cut_lineage(fingerprints(docs, rule, id_col, text_col))
    unit = [*names(rule), "text_hash"] if rule.of_set else names(rule)
    keys = [F.first("keys").alias("keys")] * rule.of_set
    distinct = cut_lineage(rows.groupBy(*unit).agg(F.min("doc_id").alias("first_id"), *keys))
    linked = similar_texts(docs, distinct, rule, text_col, hot_size) if rule.of_set else links(distinct, rule, hot_size)
    placed = distinct.select(vertex(unit).alias("fp"), "first_id").join(components(linked), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    of_root = cut_lineage(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = placed.join(of_root, "root").select(F.col("fp").alias("unit"), "component_id")
    own = rows.select("doc_id", "text_hash", vertex(unit).alias("unit"), vertex(names(rule)).alias("fingerprint"))
    return own.join(named, "unit").select("doc_id", "fingerprint", "component_id", "text_hash")


def drop_near_copies(docs: DataFrame, rule: Rule = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each component leaves one, that with the smallest id, with all their columns."""
    marked = near_copies(docs, rule, id_col, text_col)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = cut_lineage(marked.select("doc_id", "text_hash", stays.alias("kept")))
    return without(docs, {"doc_id": F.col(id_col), "text_hash": text_hash(text_col)}, kept)
