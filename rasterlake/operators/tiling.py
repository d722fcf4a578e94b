"""Cutting images into tiles from one set of options."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.color import CHANNELS, Background
from . import encode, pyramid, raster


@dataclass(frozen=True)
class TileConfig:
    """Options of a run; the zoom range is worked out per image when not given."""

    tile_size: int = 256
    min_zoom: int = 0
    max_zoom: int | None = None
    projection: str = "flat"
    scale: float | None = None
    background: Background = Background()
    method: str = "naive"  # or "window": highest zoom from the source, the rest merged

    def top(self) -> Column:
        if self.max_zoom is not None:
            return F.lit(self.max_zoom)
        return geo.max_zoom(F.col("width"), F.col("height"), self.tile_size)


def cut_images(px: DataFrame, config: TileConfig) -> DataFrame:
    """Pixels of any number of images to all their tiles: every tile of every level, also where the image has no pixel.

    Each tile has one row without offsets (ox and oy null) that gives the colour of all its pixels without a row: the background, or
    clear. So a blank tile costs one row.
    """
    if config.scale is not None:
        px, config = raster.prescale(px, config.scale), replace(config, scale=None)
    ground = raster.ground_tiles(raster.image_sizes(px), config.min_zoom, config.top(), config.background)
    return cut_pixels(px, config).unionByName(ground)


def cut_pixels(px: DataFrame, config: TileConfig) -> DataFrame:
    """The tiles' pixels that come from the images.

    Scale and background apply with both methods, and isometric images always use the naive one, which is the only
    one that can turn them.
    """
    if config.scale is not None:
        px = raster.prescale(px, config.scale)
    if config.method == "naive" or config.projection == "isometric":
        return pyramid.naive_pyramid(
            px, config.tile_size, config.min_zoom, config.top(), config.projection, config.background
        )
    # The deepest level of any image is one number; it bounds the loop over levels.
    top = config.max_zoom
    if top is None:
        top = raster.image_sizes(px).agg(F.max(config.top()).alias("top")).first()["top"] or 0
    tiles = raster.extract_windows(px, config.tile_size, config.top(), config.projection)
    levels = pyramid.build(tiles, config.tile_size, top, config.min_zoom)
    out = raster.over_canvas(levels, config.background)
    return out.select(*pyramid.TILE, "ox", "oy", *CHANNELS)


def encode_images(px: DataFrame, config: TileConfig) -> DataFrame:
    """All the way to PNG files, one row per tile of the complete grid."""
    blocks = encode.pack_blocks(cut_images(px, config), config.tile_size, config.background)
    return encode.encode_png(blocks, config.tile_size, config.background)
