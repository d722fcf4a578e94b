"""Archive directory: tiles in Hilbert order, equal contents stored once, equal neighbours as runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import div, shift, tiles_at
from ..plans.hotkeys import attach, running_sum
from ..session import cut_lineage

PIECE = 4096  # consecutive tile ids that are sorted together
TILE_TYPES = {"png": 2, "jpeg": 3, "webp": 4}  # fixed values of the archive format
NO_COMPRESSION, GZIP = 1, 2  # fixed values of the archive format


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Position of a tile on the Hilbert curves of all levels, one after the other."""
    before = div(tiles_at(z) - 1, 3)
    bits = F.filter(F.sequence(F.lit(1), F.lit(30)), lambda i: i <= z)
    sides = F.transform(bits, lambda i: shift(1, z - i))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        rx = (acc["x"].bitwiseAND(s) > 0).cast("long")
        ry = (acc["y"].bitwiseAND(s) > 0).cast("long")
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, s - 1 - acc["x"]).otherwise(acc["x"])
        fy = F.when(flip, s - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(
            F.when(ry == 0, fy).otherwise(fx).alias("x"),
            F.when(ry == 0, fx).otherwise(fy).alias("y"),
            (acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)).alias("d"),
        )

    return before + F.aggregate(sides, start, step)["d"]


def entries(tiles: DataFrame) -> DataFrame:
    """Tiles (raster_id, z, tx, ty, content) as (raster_id, tile_id, length, digest); the bytes are left behind."""
    return tiles.select(
        "raster_id", "z",
        tile_id(F.col("z"), F.col("tx"), F.col("ty")).alias("tile_id"),
        F.octet_length("content").cast("long").alias("length"),
        F.sha2(F.col("content").cast("binary"), 256).alias("digest"),
    )


def contents(listed: DataFrame) -> DataFrame:
    """Distinct contents with their byte offset, in order of first use."""
    first = listed.groupBy("raster_id", "digest").agg(F.min("tile_id").alias("first_id"), F.max("length").alias("length"))
    piece = div(F.col("first_id"), PIECE)
    summed = running_sum(first, ["raster_id"], piece, ["first_id"], F.col("length"), "_end")
    return summed.withColumn("offset", F.col("_end") - F.col("length")).drop("_end")


def directory(tiles: DataFrame) -> DataFrame:
    """Directory rows: tile_id, run_length, offset, length.

    A run is a stretch of consecutive ids with equal content. Its start is a tile whose predecessor is missing
    or different, found by one equi join on the id; runs are numbered by an ordered sum over pieces of ids, so
    a raster with millions of tiles is never sorted in one task.
    """
    # The listing is small next to the tiles and is used three times: keep it, so that tiles are read once.
    listed = cut_lineage(entries(tiles))
    before = listed.select("raster_id", (F.col("tile_id") + 1).alias("tile_id"), F.col("digest").alias("_before"))
    marked = listed.join(before, ["raster_id", "tile_id"], "left")
    start = F.when(F.col("_before") == F.col("digest"), 0).otherwise(1)
    piece = div(F.col("tile_id"), PIECE)
    runs = running_sum(marked, ["raster_id"], piece, ["tile_id"], start, "_run")
    rows = runs.groupBy("raster_id", "_run").agg(
        F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"),
        F.min("length").alias("length"), F.min("digest").alias("digest"),
    )
    placed = contents(listed).select("raster_id", "digest", "offset")
    return rows.join(placed, ["raster_id", "digest"]).select("raster_id", "tile_id", "run_length", "offset", "length")


def header(tiles: DataFrame, fmt: str = "png") -> DataFrame:
    """One row per raster: zoom range, counts, bytes and the codes of the archive header."""
    listed = entries(tiles)
    counts = listed.groupBy("raster_id").agg(
        F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count("*").alias("addressed_tiles")
    )
    distinct = listed.groupBy("raster_id", "digest").agg(F.max("length").alias("length")).groupBy("raster_id").agg(
        F.count("*").alias("tile_contents"), F.sum("length").alias("data_bytes")
    )
    return counts.join(distinct, "raster_id").select(
        "*", F.lit(TILE_TYPES[fmt]).alias("tile_type"), F.lit(NO_COMPRESSION).alias("tile_compression"),
        F.lit(GZIP).alias("internal_compression"),
    )


def lookup(wanted: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles for requested (raster_id, z, tx, ty); a missing tile gives a null content."""
    return wanted.join(tiles, ["raster_id", "z", "tx", "ty"], "left")


def directory_lookup(wanted: DataFrame, runs: DataFrame, piece: int = PIECE) -> DataFrame:
    """Requests (request_id, raster_id, tile_id) with the byte range of their tile, null for a tile that is not there.

    The run of an id is the last one that begins at or before it, if it reaches that far. Runs are cut at the borders of pieces of ids, so
    run and id meet in the same piece, and one pass in order of ids carries the newest run along; no pair of a run and an id is tried. Each
    id is sought once, and its range handed to all its requests in a way that spreads a tile that very many ask for.
    """
    low = div(F.col("tile_id"), piece)
    high = div(F.col("tile_id") + F.col("run_length") - 1, piece)
    found = F.struct("offset", "length", (F.col("tile_id") + F.col("run_length")).alias("end"))
    heads = runs.select("raster_id", "tile_id", found.alias("run"), F.explode(F.sequence(low, high)).alias("piece")).select(
        "raster_id", "piece", F.greatest("tile_id", F.col("piece") * piece).alias("tile_id"), "run", F.lit(False).alias("asked")
    )
    counts = wanted.groupBy("raster_id", "tile_id").agg(F.count("*").alias("_n"))
    asked = counts.select(
        "raster_id", div(F.col("tile_id"), piece).alias("piece"), "tile_id", F.lit(None).cast(heads.schema["run"].dataType).alias("run"),
        F.lit(True).alias("asked"), "_n",
    )
    both = heads.withColumn("_n", F.lit(0).cast("long")).unionByName(asked)
    in_order = Window.partitionBy("raster_id", "piece").orderBy("tile_id", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("run", F.last("run", ignorenulls=True).over(in_order)).filter("asked")
    inside = F.col("tile_id") < F.col("run.end")
    ranges = met.select("raster_id", "tile_id", *[F.when(inside, F.col(f"run.{c}")).alias(c) for c in ("offset", "length")], "_n")
    return attach(wanted, ranges, ["raster_id", "tile_id"], ["request_id"])


def visible_window(tiles: DataFrame, z: int, x_low: int, x_high: int, y_low: int, y_high: int) -> DataFrame:
    """Tiles in view: partition pruning on z, pushed-down ranges on tx and ty."""
    return tiles.filter(
        (F.col("z") == z) & F.col("tx").between(x_low, x_high) & F.col("ty").between(y_low, y_high)
    )


def byte_range(content: Column, first: Column, count: Column) -> Column:
    return F.substring(content, first + 1, count)


def per_level(tiles: DataFrame) -> DataFrame:
    """Tiles and bytes per raster and level."""
    return entries(tiles).groupBy("raster_id", "z").agg(F.count("*").alias("tiles"), F.sum("length").alias("bytes"))
