"""One job over rasters of all sizes that takes a physical form for each by its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import encode, raster

ROUTES = ("block", "row")


def route(limit: int = geo.LARGE_IMAGE_BYTES) -> Column:
    """``row`` for rasters whose decoded size is above the limit, else ``block``."""
    return F.when(geo.decoded_bytes(F.col("width"), F.col("height")) > limit, ROUTES[1]).otherwise(ROUTES[0])


def routed_windows(
    px: DataFrame, tile_size: int, zmax: Column | int, projection: str = "flat", limit: int = geo.LARGE_IMAGE_BYTES
) -> DataFrame:
    """Tiles of the highest zoom as blocks.

    Small rasters bring each tile's window together in one shuffle and are resampled as blocks. Large ones stay rows until a tile is
    packed: each pixel is spread by arithmetic on its own line, then on its own column, so no task holds a window. Both forms give the
    same bytes. The sizes are columns of the pixels, so both filters reach the scan.
    """
    small, large = (px.filter(route(limit) == name) for name in ROUTES)
    by_row = encode.pack_blocks(raster.extract_windows(large, tile_size, zmax, projection), tile_size)
    return encode.window_blocks(small, tile_size, zmax, projection).unionByName(by_row)


def routed_pyramid(
    px: DataFrame, tile_size: int, zmax: Column | int, top: int, projection: str = "flat", limit: int = geo.LARGE_IMAGE_BYTES
) -> DataFrame:
    """All levels of all rasters; ``top`` is the highest zoom of any."""
    return encode.build_blocks(routed_windows(px, tile_size, zmax, projection, limit), tile_size, top)
