"""Exact top-k search by inner product, without random access.

Candidates are packed into blocks of a bounded number of vectors, queries likewise, and every pair of a query block and a candidate
block is one unit of work. Within a block each dimension is a list of the candidates sorted by their component. For a query the lists are
read in order of decreasing contribution, from the top where its own component is positive and from the bottom where it is negative, all
to the same depth, for all queries of the block at once. What has been read gives each candidate a lower bound (unread components at the
list's end) and an upper bound (unread components at the list's frontier). A query is settled once few candidates can still reach its
k-th best lower bound, or all lists are read; the final scores of those candidates decide. The best k of every block are merged by
query.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id; rows are
told apart by a number of their own, so rows with the same id are all candidates, of each other too, and each is a query by itself; a query
meets candidates of its own length only; equal scores go to the smaller id; queries with fewer than k candidates get all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hotkeys import first_per_key
from ..session import cut_lineage

CANDIDATES = 8192
QUERIES = 512
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4)
FEW = 256  # candidates left at which a query's scores are worked out


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def search_block(
    ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int, rows: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of blocks: query numbers, candidate ids and scores of each query's best k.

    ``rows`` (the ids by default) number the candidates; a query doesn't meet the one with its own number."""
    rows = ids if rows is None else rows
    n, size = x.shape
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * size
    kind = np.float64 if largest < 2**52 else np.int64  # both add up without rounding
    x, q = x.astype(kind), q.astype(kind)
    by_value = np.argsort(x, axis=0, kind="stable")
    place = np.empty_like(by_value)
    np.put_along_axis(place, by_value, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(x, by_value, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)  # read from the top, from the bottom
    ends = up @ ordered[0] + down @ ordered[-1]
    live = np.arange(len(q))
    read = np.zeros((len(q), n), kind)  # contributions read so far, less the ends of their lists
    by_row = np.argsort(rows)
    own = by_row[np.minimum(np.searchsorted(rows, query_rows, sorter=by_row), n - 1)]
    own = np.where(rows[own] == query_rows, own, -1)
    lost = np.finfo(np.float64).min if kind is np.float64 else np.iinfo(np.int64).min // 2
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    before = 0
    for depth in (*[int(np.ceil(n * d)) for d in DEPTHS], n):
        if not len(live) or depth == before:
            continue
        top_new = (place >= n - depth) & (place < n - before)
        low_new = (place >= before) & (place < depth)
        read += up[live] @ np.where(top_new, x - ordered[0], 0).T + down[live] @ np.where(low_new, x - ordered[-1], 0).T
        before = depth
        lower = read + ends[live, None]
        mine = own[live]
        has_own = np.flatnonzero(mine >= 0)
        lower[has_own, mine[has_own]] = lost
        if n > k:
            bar = np.partition(lower, n - k, axis=1)[:, n - k]
        else:
            bar = np.full(len(live), lost)
        if depth < n:
            top_gap, low_gap = ordered[n - depth] - ordered[0], ordered[depth - 1] - ordered[-1]
            upper = lower + (up[live] * top_gap) @ (place < n - depth).T.astype(kind) + (down[live] * low_gap) @ (place >= depth).T.astype(kind)
        else:
            upper = lower
        can = upper >= bar[:, None]
        can[has_own, mine[has_own]] = False
        settled = (can.sum(axis=1) <= FEW) | (depth == n)
        for row in np.flatnonzero(settled):
            left = np.flatnonzero(can[row])
            if depth == n and len(left) > k:  # ties only
                scores = lower[row, left]
            else:
                scores = x[left] @ q[live[row]]
            best = np.lexsort((ids[left], -scores))[:k]
            out.append((np.full(len(best), live[row]), ids[left[best]], scores[best].astype(np.int64)))
        live, read = live[~settled], read[~settled]
    if not out:
        return np.empty(0, np.int64), ids[:0], np.empty(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*out))


def _blocks(vectors: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """Packed blocks: ``name`` (block number), ``dims``, ``ids`` and ``data``; and how many numbers there are."""
    count = max(1, -(-vectors.count() // rows))
    kind = vectors.withColumns({name: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"), "dims": F.size("v")})

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "row"])
        data = np.array(group["v"].to_list(), dtype=np.int64)
        small = np.int16 if np.abs(data).max() < 2**15 else np.int64
        return pd.DataFrame({
            name: [group[name].iat[0]], "dims": [data.shape[1]], "wide": [small is np.int64],
            "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "rows": [group["row"].to_numpy(np.int64).tobytes()],
            "data": [data.astype(small).tobytes()],
        })

    packed = kind.groupBy(name, "dims").applyInPandas(pack, f"{name} int, dims int, wide boolean, ids binary, rows binary, data binary")
    return cut_lineage(packed), count


def search(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    candidates: int = CANDIDATES, queries: int = QUERIES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` for every usable row for which ``is_query`` (an expression of the id column
    ``vec_id``) holds, against every other usable row. Components are taken as they are and must be whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<bigint>").alias("v"))
    rows = cut_lineage(rows.filter("vec_id is not null").withColumn("row", F.monotonically_increasing_id()))
    right, n_right = _blocks(rows, candidates, "cb")
    left, n_left = _blocks(rows.filter(is_query), queries, "qb")
    left = left.select("qb", "dims", *[F.col(c).alias(f"q_{c}") for c in ("wide", "ids", "rows", "data")])
    # Both sides name the pair, so pairs are spread evenly over the tasks.
    pairs = left.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))).join(
        right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))), ["qb", "cb", "dims"]
    )

    def unpack(ids: bytes, data: bytes, wide: bool, dims: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64 if wide else np.int16).reshape(-1, dims)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                ids, x = unpack(pair.ids, pair.data, pair.wide, pair.dims)
                query_ids, q = unpack(pair.q_ids, pair.q_data, pair.q_wide, pair.dims)
                rows, query_rows = np.frombuffer(pair.rows, np.int64), np.frombuffer(pair.q_rows, np.int64)
                at, found, scores = search_block(ids, x, query_rows, q, k, rows)
                yield pd.DataFrame({"query_row": query_rows[at], "query_id": query_ids[at], "vec_id": found, "score": scores})

    found = pairs.mapInPandas(step, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    return first_per_key(found, ["query_row"], k, [F.col("score").desc(), "vec_id"], "rank").select("query_id", "rank", "vec_id", "score")
