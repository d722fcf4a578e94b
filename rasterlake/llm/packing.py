"""Packing documents into sequences of a fixed number of tokens by best fit and a local search that swaps documents between bins.

Texts become token ids in Python tasks; what goes on is one small row per piece. A document longer than a sequence is cut so that all its
pieces but the first fill a sequence each, and those are settled at once. All other pieces are dealt into blocks of a bounded number of
rows. In a block best fit in decreasing order gives the first bins. Then the emptiest bin gives to the fuller ones: it moves a document
over, exchanges one for one, two of its own for one, or one of its own for two, whichever brings the other bin nearest to full. Every such
step raises the sum of squared fills, and bins that end up empty are gone. Full bins are settled; bins with room, and no other row, go to
the next round as they are, where other bins share their block. The rounds end with a block that holds all that is left, or with a round
that frees less than one in a hundred of the open bins.

Token ids are those of the ``tokenizers`` library for byte-level merge files, made by the faster ``tiktoken`` from the same file when the
file's ids follow the order of its merges (checked); other files are encoded by ``tokenizers`` itself. The two agree on every code point.

Defined cases: a null text counts as empty and has the end id only; documents with equal or null ids are packed each by itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices, small_batches, text_or_empty
from .token_counts import byte_signs

LENGTH = 2048
END = 0
BLOCK = 8192
PATIENCE = 64  # partners, and after that givers, in a row without any exchange
LEAST_FREED = 0.01  # share of the open bins that a round must free for another one to follow


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text, without special tokens around it; special strings inside it are one id, as the library has it by default."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, ahead = spec["model"], spec["pre_tokenizer"] or {}
    back = {sign: byte for byte, sign in enumerate(byte_signs())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = {token: i for token, i in model["vocab"].items() if token not in special}
    pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    merged = [plain.get("".join(pair), -1) for pair in pairs]
    simple = (
        model["type"] == "BPE" and ahead.get("type") == "ByteLevel" and ahead.get("use_regex") and not ahead.get("add_prefix_space")
        and spec["normalizer"] is None and all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        and len(special) <= 1 and all(c in back for token in plain for c in token)
        and min(merged, default=0) >= 256 and merged == sorted(set(merged)) and len(plain) == 256 + len(merged)
    )
    if not simple:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda text: library.encode(text, add_special_tokens=False).ids
    ranks = {bytes(back[c] for c in token): i for token, i in plain.items()}
    encode = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    mark, mark_id = next(iter(special.items()), ("\0", None))

    def ids(text: str) -> list[int]:
        if mark_id is None or mark not in text:
            return encode(text)
        out: list[int] = []
        for n, part in enumerate(text.split(mark)):
            if n:
                out.append(mark_id)
            out += encode(part)
        return out

    return ids


def cuts(total: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: only the first may be shorter than ``length``."""
    at = total % length or min(total, length)
    yield 0, at
    while at < total:
        yield at, length
        at += length


def pieces_of(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            at, piece, start, size, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = array("I", encode(text.as_py()))
                ids.append(end)
                raw = memoryview(np.frombuffer(ids, np.uint32).astype("<u4", copy=False)).cast("B")
                for n, (a, width) in enumerate(cuts(len(ids), length)):
                    at.append(row)
                    piece.append(n)
                    start.append(a)
                    size.append(width)
                    crc.append(zlib.crc32(raw[4 * a:4 * (a + width)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(v, pa.int64()) for v in (start, size, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(step, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins (row numbers): the largest piece first, each into the bin it fits best."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for row in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[row])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
            bins[number].append(row)
        else:
            room, number = length, len(bins)
            bins.append([row])
        if room > size:
            insort(rooms, (room - size, number))
    return bins


class _Bin:
    """A bin's pieces by size, with the sums of all pairs at hand for the search."""

    def __init__(self, rows: list[int], sizes: np.ndarray):
        self.set(rows, sizes)

    def set(self, rows: list[int], sizes: np.ndarray) -> None:
        order = np.argsort(sizes[rows], kind="stable")
        self.rows = np.asarray(rows, np.int64)[order]
        self.sizes = sizes[self.rows]
        self.fill = int(self.sizes.sum())
        self._pairs = None

    @property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of two pieces in ascending order, and which two."""
        if self._pairs is None:
            a, b = np.triu_indices(len(self.sizes), 1)
            sums = self.sizes[a] + self.sizes[b]
            order = np.argsort(sums, kind="stable")
            self._pairs = sums[order], a[order], b[order]
        return self._pairs


def _largest_gain(gives: np.ndarray, takes: np.ndarray, room: int) -> tuple[int, int, int]:
    """Of two ascending arrays the places whose difference is the largest in 1..room, with it; 0 if there is none."""
    if not len(gives) or not len(takes):
        return 0, 0, 0
    at = np.searchsorted(gives, takes + room, side="right") - 1
    gain = np.where(at >= 0, gives[np.maximum(at, 0)] - takes, 0)
    best = int(gain.argmax())
    return max(int(gain[best]), 0), int(at[best]), best


def _exchange(giver: _Bin, taker: _Bin, length: int) -> tuple[list[int], list[int]] | None:
    """Rows that go over and rows that come back, for which the taker gets nearest to full; None if nothing fits."""
    room = length - taker.fill
    none = np.zeros(1, np.int64)
    best, chosen = 0, None
    for two_go, two_come in ((False, None), (False, False), (True, False), (False, True)):
        gives = giver.pairs[0] if two_go else giver.sizes
        takes = none if two_come is None else taker.pairs[0] if two_come else taker.sizes
        gain, g, t = _largest_gain(gives, takes, room)
        if gain > best:
            best, chosen = gain, (two_go, two_come, g, t)
            if best == room:
                break
    if chosen is None:
        return None
    two_go, two_come, g, t = chosen
    go = [giver.pairs[1][g], giver.pairs[2][g]] if two_go else [g]
    come = [] if two_come is None else [taker.pairs[1][t], taker.pairs[2][t]] if two_come else [t]
    return [int(giver.rows[i]) for i in go], [int(taker.rows[i]) for i in come]


def improve(bins: list[list[int]], sizes: np.ndarray, length: int, patience: int = PATIENCE) -> list[list[int]]:
    """The bins after the local search; it ends early once no fewer bins can hold the pieces.

    A step that shifts d tokens from a bin of fill a to one of fill b >= a raises the sum of squares by 2 * d * (b - a + d). A giver is
    left when ``patience`` bins in a row found nothing to exchange with it, the search when as many givers in a row found no partner.
    """
    full, rest = [], []
    for rows in bins:
        own = _Bin(rows, sizes)
        (full if own.fill >= length else rest).append(own)
    fewest = -(-sum(b.fill for b in rest) // length)
    rest.sort(key=lambda b: b.fill)
    idle, turn = 0, 0
    while len(rest) - turn > 1 and len(rest) > fewest and idle < patience:
        giver = rest[turn]
        gave, missed = False, 0
        for taker in rest[turn + 1:]:
            if taker.fill >= length or taker.fill < giver.fill:
                continue
            step = _exchange(giver, taker, length)
            if step is None:
                missed += 1
                if missed >= patience:
                    break
                continue
            gave, missed = True, 0
            go, come = set(step[0]), set(step[1])
            taker.set([r for r in taker.rows.tolist() if r not in come] + step[0], sizes)
            giver.set([r for r in giver.rows.tolist() if r not in go] + step[1], sizes)
            if not len(giver.rows):
                break
        idle = 0 if gave else idle + 1
        if not len(giver.rows):
            del rest[turn]
        elif not gave:
            turn += 1
        full += [b for b in rest if b.fill >= length]
        rest = [b for b in rest if b.fill < length]
    return [b.rows.tolist() for b in full + rest]


def _pack_block(length: int):
    def pack(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        items = table.column("item").to_numpy()
        before = table.column("sequence_id").to_numpy(zero_copy_only=False)
        if (before >= 0).all():
            order = np.argsort(before, kind="stable")
            bins = [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(before[order])) + 1)]
        else:
            bins = best_fit(sizes, length)
        sequence, offset, is_open = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.empty(len(sizes), bool)
        for rows in improve(bins, sizes, length):
            rows = sorted(rows, key=items.__getitem__)
            ends = np.cumsum(sizes[rows])
            sequence[rows] = items[rows[0]]  # the least item: no other bin has it
            offset[rows] = ends - sizes[rows]
            is_open[rows] = ends[-1] < length
        table = table.drop_columns(["block", "sequence_id", "offset", "open"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("open", is_open)):
            table = table.append_column(name, pa.array(values))
        return table

    return pack


def pack(pieces: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, the place in that sequence; bins are numbered by their least row number."""
    numbered = cut_lineage(pieces.withColumn("item", F.monotonically_increasing_id()))
    none = F.lit(-1).cast("long")
    start = numbered.withColumns({"sequence_id": none, "offset": F.lit(0).cast("long"), "open": F.lit(True)})
    whole = F.col("length") >= length
    settled = [start.filter(whole).withColumns({"sequence_id": F.col("item"), "open": F.lit(False)})]
    rest = start.filter(~whole)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in start.schema)
    n = rest.count()
    left = None
    while n:
        blocks = -(-n // block)
        key = F.col("item") if left is None else F.col("sequence_id")
        dealt = rest.withColumn("block", F.pmod(F.xxhash64(key, F.lit(blocks)), F.lit(blocks)))
        done = cut_lineage(dealt.groupBy("block").applyInArrow(_pack_block(length), schema))
        settled.append(done.filter(~F.col("open")))
        rest = done.filter("open")
        n, bins = rest.agg(F.count("*"), F.countDistinct("sequence_id")).head()
        if blocks == 1 or left is not None and left - bins < LEAST_FREED * left:
            break
        left = bins
    out = functools.reduce(DataFrame.unionByName, [*settled, rest])
    return out.drop("item", "open")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    return pack(pieces_of(docs, path, length, end, id_col, text_col), length)
