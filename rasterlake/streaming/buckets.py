"""State of many keys in one group: a bucket of keys is handed to Python at once, and its state travels with it as one Arrow table.

A group by itself costs milliseconds however few rows it has, so a group for each key makes the time that of the keys. Here the groups are
buckets of keys, by hash; a key's rows and state are only ever in its own bucket. The number of buckets is part of the state: a query that
starts again from its checkpoint needs the same one. A bucket's rows of one micro-batch and its state have to fit into a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

BUCKETS = 2048
PIECE = 10_000
NEVER = np.iinfo(np.int64).max


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def wake_at(state: GroupState, millis: int) -> None:
    """Call the bucket again once the watermark has passed the given event time; one that lies behind is as good as now."""
    state.setTimeoutTimestamp(max(millis, state.getCurrentWatermarkMs(), 1))


def in_buckets(rows: DataFrame, name: str, step: Callable, output: str, state: str, mode: str, buckets: int = BUCKETS) -> DataFrame:
    """``step`` for each bucket of the values of the string column ``name``; ``rows`` have a watermark on ``ts``."""
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(name), F.lit(buckets)))
    return placed.groupBy("_bucket").applyInPandasWithState(step, output, state, mode, GroupStateTimeout.EventTimeTimeout)


class KeyState:
    """The state of one key of a bucket, as the fold of a key sees it."""

    def __init__(self, watermark: int, value: tuple | None, timed_out: bool = False):
        self.watermark, self.value, self.hasTimedOut, self.timeout = watermark, value, timed_out, NEVER

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value: tuple) -> None:
        self.value = value

    def remove(self) -> None:
        self.value = None

    def setTimeoutTimestamp(self, millis: int) -> None:
        self.timeout = millis

    def getCurrentWatermarkMs(self) -> int:
        return self.watermark


def _by_key(rows: pd.DataFrame) -> Iterator[tuple[str | None, Iterator[pd.DataFrame]]]:
    """The rows of each key, in pieces."""
    codes, keys = pd.factorize(rows["_key"], use_na_sentinel=False)
    order = np.argsort(codes, kind="stable")
    rows, ends = rows.take(order), np.cumsum(np.bincount(codes, minlength=len(keys))).tolist()
    for key, begin, end in zip(keys, [0, *ends], ends):
        yield key if isinstance(key, str) else None, (rows.iloc[at:min(at + PIECE, end)] for at in range(begin, end, PIECE))


def _plain(value):
    return None if pd.isna(value) else value.item() if isinstance(value, np.generic) else value


def fold_keys(rows: DataFrame, key: str, fold: Callable, output: str, state: str, mode: str, buckets: int = BUCKETS) -> DataFrame:
    """``fold(key, pieces, state)`` of each value of the whole-number column ``key``, as ``applyInPandasWithState`` would call it with event times.

    A key whose time is up is called without rows after the others, unless it had rows.
    """
    fields = to_arrow_schema(StructType.fromDDL(state))
    schema = pa.schema([("key", pa.string()), ("until", pa.int64()), *fields])

    def step(_, batches: Iterator[pd.DataFrame], bucket: GroupState) -> Iterator[pd.DataFrame]:
        watermark = bucket.getCurrentWatermarkMs()
        held = {}
        if bucket.exists:
            own = [c.to_pylist() for c in unpack(bucket.get[0]).columns]
            held = dict(zip(own[0], zip(own[1], zip(*own[2:]))))
        out = []

        def call(name: str | None, pieces: Iterator[pd.DataFrame], timed_out: bool) -> None:
            one = KeyState(watermark, held.pop(name)[1] if name in held else None, timed_out)
            out.extend(f for f in fold((None if name is None else int(name),), pieces, one) if len(f))
            if one.exists:
                held[name] = one.timeout, tuple(_plain(v) for v in one.value)

        if not bucket.hasTimedOut:
            # Of the texts few are different; as codes they take a byte or two a row.
            pieces = [p.astype({c: "category" for c in p.columns if p[c].dtype == object and c != "_key"}) for p in batches]
            texts = [c for c in pieces[0].columns if pieces[0][c].dtype == "category"]
            for c in texts if len(pieces) > 1 else []:
                every = pd.api.types.union_categoricals([p[c] for p in pieces]).categories
                pieces = [p.assign(**{c: p[c].cat.set_categories(every)}) for p in pieces]
            for name, mine in _by_key(pd.concat(pieces, ignore_index=True)):
                call(name, mine, False)
        for name in [k for k, (until, _) in held.items() if until < watermark]:
            call(name, iter(()), True)
        if held:
            columns = [list(held), [until for until, _ in held.values()], *map(list, zip(*[v for _, v in held.values()]))]
            bucket.update((pack(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)),))
            wake_at(bucket, min(columns[1]))
        elif bucket.exists:
            bucket.remove()
        if out:
            yield pd.concat(out, ignore_index=True)

    named = rows.withColumn("_key", F.col(key).cast("string"))
    return in_buckets(named, "_key", step, output, "held binary", mode, buckets)
