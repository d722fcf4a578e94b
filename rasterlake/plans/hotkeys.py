"""Plan shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE of them.
HOT_SHARE = 1000
HOT_FLOOR = 100_000
SALTS = 4096


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    weight: str = "_n",
    hot_floor: int = HOT_FLOOR,
) -> DataFrame:
    """Left join of ``rows`` with one value row per key, safe for hot keys.

    ``per_key`` carries in ``weight`` how many of the rows each key has (never more). The hot keys, at most
    HOT_SHARE of them whatever the data size, are broadcast. All other keys meet their rows in a shuffle join, in which the rows
    already served (and rows with a null key) are spread by a salt over ``spread`` instead of piling up. Both
    sides and the total use the same aggregate, so its shuffle runs once and the rows are not counted by themselves.
    """
    keys = list(keys)
    values = [c for c in per_key.columns if c not in keys and c != weight]
    total = per_key.select(F.sum(weight)).scalar()
    is_hot = (F.col(weight) > hot_floor) & (F.col(weight) > total / HOT_SHARE)

    hot = per_key.filter(is_hot).select(*keys, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    # Always -1, but not a literal: the optimiser would take a literal out of the join keys, and with it the salt.
    unsalted = F.when(F.col(weight) >= 0, -1).otherwise(-2)
    cold = per_key.filter(~is_hot).select(
        *keys, unsalted.alias("_salt"), *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    served = F.col("_hot").isNotNull()
    for key in keys:
        served = served | F.col(key).isNull()
    salt = F.when(served, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    return joined.select(
        *rows.columns, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values]
    )


def lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str], hot_floor: int = HOT_FLOOR
) -> DataFrame:
    """Left join with a table that has unique keys, for use before a grouping on the same keys.

    A plain join would leave the rows partitioned by the keys and the grouping would reuse that, hot key and
    all. The key counts this needs come from one partial aggregate over the key columns alone.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return attach(rows, counts.join(table, list(keys), "left"), keys, spread, hot_floor=hot_floor)


def _all_before(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Inclusive running sum per key without sorting a whole key in one task.

    ``chunk`` cuts each key's rows into pieces in the same order as ``order``. Rows are sorted within their
    piece only; the pieces' totals, one row per piece, give the offsets.
    """
    keys = list(keys)
    pieces = df.withColumn("_chunk", chunk).withColumn("_value", value)
    totals = pieces.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    offsets = totals.withColumn(
        "_offset", F.sum("_total").over(_all_before(keys, ["_chunk"])) - F.col("_total")
    ).drop("_total")
    inner = pieces.withColumn("_inner", F.sum("_value").over(_all_before([*keys, "_chunk"], order)))
    return (
        inner.join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_inner") + F.col("_offset"))
        .drop("_chunk", "_value", "_inner", "_offset")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], k: int, order: Sequence, out: str = "rn") -> DataFrame:
    """The first k rows of every key, numbered.

    Spark turns the rank filter into a group limit that runs before the shuffle too, so that at most k rows
    per key leave each task, however large the key is (k must stay below
    ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default).
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)


def previous_value(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Value of the row before, per key in ``order``, sorting only within the pieces given by ``chunk``."""
    keys = list(keys)
    pieces = df.withColumn("_chunk", chunk)
    ends = pieces.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    carried = ends.withColumn(
        "_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk"))
    ).drop("_end")
    piece = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inner = pieces.withColumn("_in_piece", F.lag(F.struct(value)).over(piece))
    return (
        inner.join(carried, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_in_piece", "_carried")[value])
        .drop("_chunk", "_in_piece", "_carried")
    )
