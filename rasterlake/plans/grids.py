"""Ranges and grids made by generators, spread over tasks before they grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def levels(low: Column, high: Column) -> Column:
    """All whole numbers from ``low`` to ``high``; none when the range is empty or an end is null."""
    none = F.array().cast("array<int>")
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(none)


def with_range(df: DataFrame, name: str, count: Column, keys: Sequence[str]) -> DataFrame:
    """Repeat each row for ``name`` = 0 .. count - 1.

    The range is cut into blocks, which are dealt out by ``keys`` before they are made, so one row never grows to its whole range in
    one task.
    """
    last = (count - 1).cast("int")
    blocks = df.withColumn("_last", last).withColumn("_block", F.explode(levels(F.lit(0), F.floor(F.col("_last") / BLOCK))))
    begin = F.col("_block") * BLOCK
    inside = F.sequence(begin, F.least(begin + (BLOCK - 1), F.col("_last")))
    return blocks.repartition(*keys, "_block").withColumn(name, F.explode(inside)).drop("_block", "_last")


def with_square(df: DataFrame, down: str, across: str, side: Column, keys: Sequence[str]) -> DataFrame:
    """Repeat each row for every cell of a square; its rows are dealt out before their cells are made."""
    rows = with_range(df.withColumn("_side", side.cast("int")), down, F.col("_side"), keys)
    cells = F.sequence(F.lit(0), F.col("_side") - 1)
    return rows.repartition(*keys, down).withColumn(across, F.explode(cells)).drop("_side")
