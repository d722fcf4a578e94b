"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# A side is broadcast only when its counted rows and then its measured bytes stay below these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 40_000_000
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Texts are long: hand at most BATCH_ROWS of them to Python at a time, unless the session asks for fewer."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows written to the shared folder; with a broadcast hint if they are few and small, else for a shuffle join.

    At most ``limit`` rows, whose values as text have at most BROADCAST_BYTES bytes in all.
    """
    kept = cut_lineage(df)
    if kept.count() > limit:
        return kept
    wide = kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(kept) if (wide or 0) <= BROADCAST_BYTES else kept


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front while a column of that name is there (names match without case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def without(docs: DataFrame, key: dict[str, Column], decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (the columns of ``key`` and ``kept``) keep, one for each key.

    ``key`` says how the key columns are made from a row. The texts stay where they are read as long as the dropped keys are few enough
    to broadcast (they are counted); beyond that they are shuffled by the key, which is nearly unique. Keys may be null.
    """
    own = {k: free_name(docs.columns, k) for k in key}
    renamed = decisions.select(*[F.col(k).alias(own[k]) for k in key], "kept")
    dropped = sized(renamed.filter(~F.col("kept")).select(*own.values()).distinct())
    counts = renamed.filter("kept").groupBy(*own.values()).agg(F.count("*").alias("n_of_key"))
    repeated = sized(counts.filter("n_of_key > 1").select(*own.values()))

    def against(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        on = F.lit(True)
        for k in own.values():
            on = on & left[k].eqNullSafe(right[k])
        return left.join(right, on, how)

    kept = against(docs.withColumns({own[k]: v for k, v in key.items()}), dropped, "left_anti")
    if not repeated.isEmpty():
        twice = against(kept, repeated, "left_semi").dropDuplicates(list(own.values()))
        kept = against(kept, repeated, "left_anti").unionByName(twice)
    return kept.select(*docs.columns)
