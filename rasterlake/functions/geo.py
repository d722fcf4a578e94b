"""Zoom, grid, Mercator and georeference arithmetic as column expressions.

Integer results stay integer all the way (shifts and ``div``), because ``ceil(log2(x))`` is wrong at
exact powers of two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grids import levels, with_square

# Fixed values that results depend on.
MERCATOR_LIMIT = 1.4844222297453324  # atan(sinh(pi)), radians
LARGE_IMAGE_BYTES = 256 * 1024 * 1024
MAX_SERVICE_ZOOM = 12
PRESCALE_TOLERANCE = 0.001

ColumnLike = Column | int | float


def as_col(value: ColumnLike) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def div(a: ColumnLike, b: ColumnLike) -> Column:
    """Integer division (truncates towards zero)."""
    return F.call_function("div", as_col(a).cast("long"), as_col(b).cast("long"))


def nearest(x: Column) -> Column:
    """Nearest whole number of a double, halves up. ``round`` goes through decimals, which is far too slow per pixel."""
    return F.floor(x + 0.5)


def shift(value: ColumnLike, bits: ColumnLike) -> Column:
    return F.call_function("shiftleft", as_col(value).cast("long"), as_col(bits).cast("int"))


def grid_size(z: ColumnLike) -> Column:
    return shift(1, z)


def tiles_at(z: ColumnLike) -> Column:
    return shift(1, as_col(z) * 2)


def total_tiles(zmin: ColumnLike, zmax: ColumnLike) -> Column:
    """Sum of 4^z over the range in closed form, zero for an empty range."""
    total = div(tiles_at(as_col(zmax) + 1) - tiles_at(zmin), 3)
    return F.when(as_col(zmax) >= as_col(zmin), total).otherwise(F.lit(0).cast("long"))


def max_zoom(width: ColumnLike, height: ColumnLike, tile_size: ColumnLike) -> Column:
    """Smallest z with tile_size * 2^z >= max(width, height)."""
    longest = F.greatest(as_col(width), as_col(height)).cast("long")
    too_small = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda z: shift(tile_size, z) < longest)
    return F.size(too_small)


def canvas_size(z: ColumnLike, tile_size: ColumnLike) -> Column:
    return shift(tile_size, z)


def fit(dim: ColumnLike, width: ColumnLike, height: ColumnLike, z: ColumnLike, tile_size: ColumnLike) -> Column:
    """One axis of the image fitted into the canvas of zoom z, aspect kept, at least one pixel."""
    longest = F.greatest(as_col(width), as_col(height)).cast("long")
    fitted = div(as_col(dim).cast("long") * canvas_size(z, tile_size), longest)
    return F.greatest(F.lit(1).cast("long"), fitted).cast("int")


def prescale(dim: ColumnLike, scale: ColumnLike) -> Column:
    """Dimension after the optional pre-scale; a scale within the tolerance of one is skipped."""
    s = as_col(scale).cast("double")
    skip = s.isNull() | (F.abs(s - 1.0) <= PRESCALE_TOLERANCE)
    scaled = F.greatest(F.lit(1), (as_col(dim) * s).cast("int"))
    return F.when(skip, as_col(dim).cast("int")).otherwise(scaled)


def mercator_y(t: ColumnLike) -> Column:
    """Normalised canvas y to normalised source y of an equirectangular image."""
    latitude = F.atan(F.sinh(math.pi * (1.0 - 2.0 * as_col(t))))
    return (MERCATOR_LIMIT - latitude) / (2.0 * MERCATOR_LIMIT)


def mercator_t(y: ColumnLike) -> Column:
    """Inverse of ``mercator_y``, for finding candidate rows; inputs are clamped to 0..1."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_col(y)))
    latitude = MERCATOR_LIMIT * (1.0 - 2.0 * inside)
    return (1.0 - F.asinh(F.tan(latitude)) / math.pi) / 2.0


def row_range(row: ColumnLike, grid: ColumnLike) -> tuple[Column, Column]:
    """Normalised source range of one tile row under Mercator."""
    g = as_col(grid).cast("double")
    return mercator_y(as_col(row) / g), mercator_y((as_col(row) + 1) / g)


def decoded_bytes(width: ColumnLike, height: ColumnLike) -> Column:
    return as_col(width).cast("long") * as_col(height).cast("long") * 4


def strategy(is_png: Column, width: ColumnLike, height: ColumnLike) -> Column:
    """Which physical form suits an image: unknown dimensions count as small."""
    large = F.coalesce(decoded_bytes(width, height) > LARGE_IMAGE_BYTES, F.lit(False))
    return F.when(large & is_png, "row_streaming").when(large, "strip").otherwise("naive")


def tile_grid(df: DataFrame, zmin: ColumnLike, zmax: ColumnLike) -> DataFrame:
    """One row per (input row, z, tx, ty) for all zooms of the row's own range; made by generators, column by column."""
    zooms = df.withColumn("z", F.explode(levels(as_col(zmin), as_col(zmax))))
    return with_square(zooms, "tx", "ty", grid_size(F.col("z")), [*df.columns, "z"])


# --- georeference -----------------------------------------------------------------------------

# Directory keys that carry a coordinate system code, and the code of plain degrees.
EPSG_KEYS = (2048, 3072)
EPSG_DEGREES = 4326


def epsg(keys: Column) -> Column:
    """First usable coordinate-system code of a geo key directory, else null."""
    entries = F.least(F.get(keys, F.lit(3)), div(F.size(keys) - 4, 4).cast("int"))
    index = F.filter(F.sequence(F.lit(1), F.greatest(entries, F.lit(1))), lambda i: i <= entries)

    def value(i: Column, offset: int) -> Column:
        return F.get(keys, (i * 4 + offset).cast("int"))

    usable = F.filter(index, lambda i: value(i, 0).isin(*EPSG_KEYS) & (value(i, 1) == 0) & (value(i, 3) > 0))
    return F.get(F.transform(usable, lambda i: value(i, 3)), F.lit(0)).cast("int")


def bounds(width: ColumnLike, height: ColumnLike, scale: Column, tie: Column) -> Column:
    """North-up [west, south, east, north] from pixel scale and tie point, else null."""
    sx, sy = F.get(scale, F.lit(0)), F.get(scale, F.lit(1))
    west = F.get(tie, F.lit(3)) - F.get(tie, F.lit(0)) * sx
    north = F.get(tie, F.lit(4)) + F.get(tie, F.lit(1)) * sy
    usable = (F.size(scale) >= 2) & (F.size(tie) >= 6) & (sx > 0) & (sy > 0)
    box = F.array(west, north - as_col(height) * sy, west + as_col(width) * sx, north)
    return F.when(usable, box)


def is_georeferenced(scale: Column, tie: Column, keys: Column) -> Column:
    return scale.isNotNull() | tie.isNotNull() | keys.isNotNull()


def pixel_scale(scale: Column) -> Column:
    return F.when(F.size(scale) >= 2, F.slice(scale, 1, 2))


def is_global(code: Column, box: Column) -> Column:
    """True for a whole-world raster in degrees; null inputs give false."""
    west, south, east, north = (F.get(box, F.lit(i)) for i in range(4))
    covers = (west <= -179.0) & (east >= 179.0) & (south <= -89.0) & (north >= 89.0)
    return F.coalesce((code == EPSG_DEGREES) & covers, F.lit(False))


def infer_projection(explicit: Column, code: Column, box: Column) -> Column:
    return F.coalesce(explicit, F.when(is_global(code, box), "mercator").otherwise("flat"))


def units_per_pixel(mode: Column, value: Column, tile_size: ColumnLike, z: ColumnLike, zmax: ColumnLike) -> Column:
    """Length of one pixel at zoom z from the stored scale (a convenience on the stored record)."""
    zoom_out = shift(1, as_col(zmax) - as_col(z)).cast("double")
    at_max = F.when(mode == "pixels_per_unit", 1.0 / value).when(mode == "units_per_tile", value / as_col(tile_size))
    return at_max * zoom_out
