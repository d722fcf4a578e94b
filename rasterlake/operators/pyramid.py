"""The 4-to-1 tile pyramid on tile pixels (raster_id, z, tx, ty, ox, oy, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.color import CHANNELS, Background
from ..functions.geo import div
from ..session import cut_lineage
from . import raster

TILE = ("raster_id", "z", "tx", "ty")


def _axis_taps(tile: Column, offset: Column, tile_size: int) -> Column:
    """Outputs of the parent tile that one child row or column reaches, with weights in eighths (3 or 1).

    The further one lies outside the parent at its borders and has to be filtered out.
    """
    pos = (tile % 2) * tile_size + offset
    near = div(pos, 2).cast("int")
    far = F.when(pos % 2 == 0, near - 1).otherwise(near + 1)
    return F.array(
        F.struct(near.alias("o"), F.lit(3).alias("w")),
        F.struct(far.alias("o"), F.lit(1).alias("w")),
    )


def _axis_total(o: Column, tile_size: int) -> Column:
    """All taps of an output sum to 8, less the tap that would lie outside the parent tile."""
    return F.lit(8) - F.when(o == 0, 1).otherwise(0) - F.when(o == tile_size - 1, 1).otherwise(0)


def merge(level: DataFrame, tile_size: int) -> DataFrame:
    """One level up: 2x2 tiles become one with the triangle filter; neighbouring parents do not bleed."""
    if "_line" in level.columns:
        return raster.in_forms(level, lambda rows, line: _merged(rows, tile_size, line))
    return _merged(level, tile_size, [])


def _merged(level: DataFrame, tile_size: int, line: list[str]) -> DataFrame:
    # Children meet by parent tile before they are scattered to its pixels, so only child pixels are moved.
    parent = [div(F.col("tx"), 2).cast("int").alias("_px"), div(F.col("ty"), 2).cast("int").alias("_py")]
    family = level.select("*", *parent)
    family = family if line else family.repartition("raster_id", "_px", "_py")
    spread = (
        family.withColumn("_x", F.explode(_axis_taps(F.col("tx"), F.col("ox"), tile_size)))
        .filter(F.col("_x.o").between(0, tile_size - 1))
        .withColumn("_y", F.explode(_axis_taps(F.col("ty"), F.col("oy"), tile_size)))
        .filter(F.col("_y.o").between(0, tile_size - 1))
        .withColumn("_w", F.col("_x.w") * F.col("_y.w"))
    )
    sums = (
        spread.groupBy("raster_id", *line, "z", "_px", "_py", F.col("_x.o").alias("ox"), F.col("_y.o").alias("oy"))
        .agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in CHANNELS])
        .select("raster_id", *line, (F.col("z") - 1).alias("z"), F.col("_px").alias("tx"), F.col("_py").alias("ty"), "ox", "oy", *CHANNELS)
    )
    total = _axis_total(F.col("ox"), tile_size) * _axis_total(F.col("oy"), tile_size)
    return sums.select(
        *TILE, *line, "ox", "oy", *[div(F.col(c) * 2 + total, total * 2).cast("int").alias(c) for c in CHANNELS]
    )


def build(tiles: DataFrame, tile_size: int, top: int, bottom: int = 0, cut_every: int = 4) -> DataFrame:
    """All levels from the finished tiles at each raster's own highest zoom down to ``bottom``.

    ``top`` bounds the zooms in ``tiles``; rasters may begin at different ones, each step takes all of them one level
    down. A level is a quarter of the one above and is rounded to whole numbers before the next. The loop runs at
    most thirteen times, and every few steps the lineage is cut.
    """
    current = tiles.select(*TILE, *[c for c in tiles.columns if c == "_line"], "ox", "oy", *CHANNELS)
    levels = [current]
    for step in range(1, top - bottom + 1):
        current = merge(current.filter(F.col("z") > bottom), tile_size)
        if step % cut_every == 0 and step < top - bottom:
            current = cut_lineage(current)
        levels.append(current)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter(F.col("z") >= bottom)


def strip_pyramid(px: DataFrame, tile_size: int, top: int, projection: str = "flat", held: bool = False) -> DataFrame:
    """Window method: highest zoom cut from the source, lower zooms merged. ``held`` keeps ``_line`` (see ``raster.by_line``)."""
    return build(raster.extract_windows(px, tile_size, F.lit(top), projection, held), tile_size, top)


def naive_pyramid(
    px: DataFrame, tile_size: int, zmin: Column | int, zmax: Column | int, projection: str = "flat",
    bg: Background = Background(), held: bool = False,
) -> DataFrame:
    """Every level rendered from the source, all zooms in one job with z as a grouping key."""
    levels = raster.at_zooms(px, tile_size, zmin, zmax, "y" if projection == "mercator" else "x")
    return raster.crop_tiles(raster.canvas(levels, projection, bg, held), tile_size)


def tile_content(tiles: DataFrame) -> DataFrame:
    """Pack each tile's pixels into one text of hex colours in row order; a tile has at most size^2 pixels."""
    hexed = F.concat(*[F.lpad(F.lower(F.hex(c)), 2, "0") for c in CHANNELS])
    cell = F.struct("oy", "ox", hexed.alias("v"))
    return (
        tiles.groupBy(*TILE)
        .agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        .select(*TILE, F.array_join(
            F.transform("cells", lambda c: F.concat(c["oy"].cast("string"), F.lit(","), c["ox"].cast("string"), F.lit(":"), c["v"])),
            ";").alias("content"))
    )


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tile sets side by side: tiles on either side, pixels that differ, largest difference.

    Pixels meet by tile and place, those of one side negated, a pixel missing on one side being clear there; every side is read once and
    none is written. Sides that keep ``_line`` (``held``) have to be of the same pixels, tile size and highest zoom; their small rasters meet
    without a shuffle, all others with one. Positions within a tile are unique.
    """
    if "_line" in left.columns and "_line" in right.columns:
        return raster.in_forms(_sides(left, right, ["_line"]), _gaps).drop("_line")
    return _gaps(_sides(left, right, []), [])


def _sides(left: DataFrame, right: DataFrame, line: list[str]) -> DataFrame:
    def signed(side: DataFrame, sign: int) -> DataFrame:
        return side.select(*TILE, *line, "ox", "oy", F.lit(sign).alias("_side"), *[(F.col(c) * sign).alias(c) for c in CHANNELS])

    return signed(left, 1).unionByName(signed(right, -1))


def _gaps(both: DataFrame, line: list[str]) -> DataFrame:
    places = [*TILE, *line]
    # Spread by tile at once: grouping by pixel first would move every pixel, and then the pixels of a tile again.
    met = both if line else both.repartition(*TILE)
    pixels = met.groupBy(*places, "ox", "oy").agg(
        F.max("_side").alias("_most"), F.min("_side").alias("_least"), *[F.sum(c).alias(c) for c in CHANNELS]
    )
    gap = F.greatest(*[F.abs(F.col(c)) for c in CHANNELS]).cast("int")
    tiles = pixels.withColumn("gap", gap).groupBy(*places).agg(
        (F.max("_most") > 0).cast("int").alias("in_left"), (F.min("_least") < 0).cast("int").alias("in_right"),
        F.count_if(F.col("gap") > 0).alias("n"), F.max("gap").alias("most"),
    )
    # Pixels of a tile without a name are never counted.
    named = F.col("raster_id").isNotNull() & F.col("z").isNotNull() & F.col("tx").isNotNull() & F.col("ty").isNotNull()
    return tiles.select(
        *places, "in_left", "in_right", F.when(named, F.col("n")).otherwise(F.lit(0).cast("long")).alias("pixels_differ"),
        F.coalesce(F.when(named, F.col("most")), F.lit(0)).alias("largest_gap"), (F.col("n") == 0).alias("identical"),
    )
