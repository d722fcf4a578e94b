"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

Training time runs from 0 to 1. Each source has a schedule, a piecewise linear intensity over time, which is integrated and scaled so
that its whole demand is the source's target. The source's documents stand in a fixed pseudo-random order and form a stream of words
that repeats when it ends; inverting the cumulative demand at a document's place in the stream gives its training position. Copies of
documents are sorted by position over ranges.

A hot source is cut into pieces of about 2 * sqrt(all rows) documents; running sums are made within pieces and the pieces' totals give
the offsets, so no task sorts a whole source.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source, the last one; rows repeated with
the same id, text and source are taken or left together; an empty table gives an empty result; other columns pass through
``mix_documents`` under any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.hotkeys import running_sum
from ..session import cut_lineage
from .common import free_name, sized, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = 3  # weights 1, 2, 3, 1, ...
MAX_PASSES = 3
# (time, intensity) by weight: lighter sources come more early on, heavier ones late.
SCHEDULES: dict[int, Sequence[tuple[float, float]]] = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}


def order_key(id_col: str, text_col: str) -> Column:
    """60 bits of the digest of id and text: a fixed pseudo-random order."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(text_col)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id``, ``source``, ``h``, ``size`` and ``copies``; rows that are the same in all three columns become one."""
    return (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            order_key(id_col, text_col).alias("h"),
            F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        )
        .groupBy("doc_id", "source", "h", "size")
        .agg(F.count("*").alias("copies"))
    )


def source_targets(sizes: DataFrame, passes: int = MAX_PASSES) -> DataFrame:
    """``source``, ``s`` (its rank), ``weight``, ``source_size``, ``target`` and ``n``, the documents of all sources.

    A target is min(passes * size, level * weight). With sources by (size / weight), each prefix taken as full gives a level for the
    rest; the level sought is the largest of them.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("docs")
    )
    ranked = per_source.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    every = Window.partitionBy()
    full = ranked.withColumns({
        "weight": (F.col("s") - 1) % CYCLE + 1,
        "cap": F.col("source_size") * passes,
        "n": F.sum("docs").over(every),
        "total": F.sum("source_size").over(every),
    })
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = full.withColumn("level", (F.col("total") - before) / left)
    return levels.withColumn("level", F.max("level").over(every)).select(
        "source", "s", "weight", "source_size", "n",
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def _segments(schedules: dict[int, Sequence[tuple[float, float]]]) -> Column:
    """By weight: the schedule's pieces (t0, t1, w0, w1) with the cumulative share of the demand at both ends (c0, c1)."""
    out = None
    for weight, knots in schedules.items():
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        pieces, done = [], 0.0
        for (a, b), area in zip(zip(knots, knots[1:]), areas):
            share = area / sum(areas)
            values = {"t0": a[0], "t1": b[0], "w0": a[1] / sum(areas), "w1": b[1] / sum(areas), "c0": done, "c1": done + share}
            pieces.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
            done += share
        column = F.array(*pieces)
        out = F.when(F.col("weight") == weight, column) if out is None else out.when(F.col("weight") == weight, column)
    return out


def _time_of(share: Column, segments: Column) -> Column:
    """The time at which a schedule has asked for ``share`` of its demand: within a piece, the root of a quadratic."""
    inside = F.filter(segments, lambda p: p["c0"] <= share)
    p = F.element_at(inside, -1)
    rest = F.greatest(share - p["c0"], F.lit(0.0))
    slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
    root = 2 * rest / (p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * rest, F.lit(0.0))))
    return F.least(p["t0"] + F.coalesce(root, F.lit(0.0)), p["t1"])


def plan_passes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    passes: int = MAX_PASSES,
    schedules: dict[int, Sequence[tuple[float, float]]] | None = None,
) -> DataFrame:
    """One row per document: id, h, size, its source's size and target, ``passes`` it takes part in, and the position of each.

    Pass k of a document starts at its offset in the stream plus k times the source's size; it is taken when its middle lies within
    the target, so a source misses its target by half a document at most.
    """
    sizes = cut_lineage(document_sizes(docs, id_col, text_col, source_col))
    sources = sized(source_targets(sizes, passes).withColumn("segments", _segments(schedules or SCHEDULES)))
    known = sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    # Pieces of equal hash width, so many that none holds more than about 2 * sqrt(n) documents, whatever its source.
    pieces = F.sqrt("n") / 2
    piece = F.floor(F.col("h") / F.lit(float(1 << 60)) * pieces)
    placed = running_sum(known, ["s"], piece, ["h", "doc_id", "size"], F.col("size") * F.col("copies"), "end")
    whole = F.col("size") * F.col("copies")
    middle = F.col("end") - whole / 2
    taken = F.when(
        whole > 0, F.least(F.greatest(F.floor((F.col("target") - middle) / F.col("source_size")) + 1, F.lit(0)), F.lit(passes))
    ).otherwise(0)
    return placed.withColumns({"passes": taken.cast("int"), "middle": middle}).select(
        "doc_id", "source", "h", "size", "copies", "source_size", "target", "passes",
        F.transform(
            F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")),
            lambda k: F.round(_time_of((F.col("middle") + k * F.col("source_size")) / F.col("target"), F.col("segments")), 9),
        ).alias("positions"),
    )


def occurrences(plan: DataFrame) -> DataFrame:
    """One row per copy that the mix takes: ``doc_id``, ``h``, ``source``, ``size``, ``pass``, ``position``."""
    return plan.select("doc_id", "h", "source", "size", F.posexplode("positions").alias("pass", "position"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position, with the same columns."""
    h, the_id, the_h, the_source, position, nth = (
        free_name(docs.columns, n) for n in ("h", "mix_id", "mix_h", "mix_source", "mix_position", "mix_pass")
    )
    chosen = occurrences(cut_lineage(plan_passes(docs, id_col, text_col, source_col, **options))).select(
        F.col("doc_id").alias(the_id), F.col("h").alias(the_h), F.col("source").alias(the_source),
        F.col("position").alias(position), F.col("pass").alias(nth),
    )
    rows = docs.withColumn(h, order_key(id_col, text_col))
    same = (
        (F.col(h) == F.col(the_h))
        & F.col(id_col).eqNullSafe(F.col(the_id))
        & F.col(source_col).eqNullSafe(F.col(the_source))
    )
    return rows.join(chosen, same).sort(position, h, nth).select(*docs.columns)
