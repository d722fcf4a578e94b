"""Greedy thinning of an ordered key: keep the first value, then the next one at least a step further.

Which value is kept depends on the one kept before, so a plain fold would walk a whole key in one task. Here
each key is cut into pieces of fixed width. A piece's effect is a small table, since what was kept before it can
only shift its start by less than one step. The tables are chained per key, and then every piece is
thinned on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sortedruns import group_starts, map_sorted, whole_groups

PIECE_STEPS = 4096


def _last_kept(values: np.ndarray, step: int) -> np.ndarray:
    """For every start index the last value kept when thinning begins there."""
    following = np.searchsorted(values, values + step)
    end = np.where(following < len(values), following, np.arange(len(values)))
    while True:  # each round doubles the number of steps taken
        further = end[end]
        if (further == end).all():
            return values[end]
        end = further


def _kept(values: np.ndarray, step: int, start: float) -> list[int]:
    """Row numbers kept when nothing below ``start`` may be kept."""
    following = np.searchsorted(values, values + step)
    i, kept = int(np.searchsorted(values, start)), []
    while i < len(values):
        kept.append(i)
        i = int(following[i])
    return kept


def thin(df: DataFrame, keys: Sequence[str], value: str, step: str, piece_steps: int = PIECE_STEPS) -> DataFrame:
    """Distinct (keys, value) rows that are kept; ``value`` and ``step`` are whole numbers, step fixed per key."""
    keys = list(keys)
    piece_keys = [*keys, "_piece"]
    points = (
        df.groupBy(*keys, F.col(value).cast("long").alias("_v"))
        .agg(F.max(F.greatest(F.lit(1).cast("long"), F.col(step).cast("long"))).alias("_step"))
        .withColumn("_piece", F.floor(F.col("_v") / (F.col("_step") * piece_steps)))
    )
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema)

    def cut(pdf: pd.DataFrame, names: Sequence[str]) -> Iterator[tuple[int, int]]:
        starts = group_starts(pdf, names)
        yield from zip(starts, [*starts[1:], len(pdf)])

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, piece_keys):
            rows, lasts = [], []
            v, step_of, piece_of = (pdf[c].to_numpy() for c in ("_v", "_step", "_piece"))
            for a, b in cut(pdf, piece_keys):
                size = int(step_of[a])
                reach = int(piece_of[a]) * size * piece_steps + size
                n = min(b - a, int(np.searchsorted(v[a:b], reach)) + 1)
                rows.append(np.arange(a, a + n))
                lasts.append(_last_kept(v[a:b], size)[:n])
            out = pdf.iloc[np.concatenate(rows)][[*piece_keys, "_step", "_v"]].rename(columns={"_v": "_first"})
            yield out.assign(_last=np.concatenate(lasts))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free_from = None, None
        for pdf in whole_groups(batches, piece_keys):
            first, last, size = (pdf[c].to_numpy() for c in ("_first", "_last", "_step"))
            names = [pdf[k].to_numpy() for k in keys]
            rows, entry = [], []
            for a, b in cut(pdf, piece_keys):
                key = tuple(n[a] for n in names)
                if key != current:
                    current, free_from = key, None
                rows.append(a)
                entry.append(free_from)
                at = a if free_from is None else a + int(np.searchsorted(first[a:b], free_from))
                if at < b:
                    free_from = int(last[at]) + int(size[at])
            yield pdf.iloc[rows][piece_keys].assign(_from=pd.array(entry, dtype="Int64"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, piece_keys):
            v, size, start = pdf["_v"].to_numpy(), pdf["_step"].to_numpy(), pdf["_from"]
            floor = start.fillna(np.iinfo("int64").min).to_numpy(dtype="int64")
            rows = [a + i for a, b in cut(pdf, piece_keys) for i in _kept(v[a:b], int(size[a]), int(floor[a]))]
            yield pdf.iloc[rows][[*keys, "_v"]].rename(columns={"_v": value})

    tables = map_sorted(points, piece_keys, ["_v"], effects, f"{key_ddl}, _piece bigint, _step bigint, _first bigint, _last bigint")
    entries = map_sorted(tables, keys, ["_piece", "_first"], chain, f"{key_ddl}, _piece bigint, _from bigint")
    started = points.join(entries, piece_keys)
    return map_sorted(started, piece_keys, ["_v"], keep, f"{key_ddl}, `{value}` bigint")
