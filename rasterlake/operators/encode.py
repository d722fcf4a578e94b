"""Tile blocks: one row per tile with its RGBA bytes, for the jobs that need dense tiles.

A grouped row is one tile (at most size^2 pixels) or one parent with its four children, so it is bounded whatever
the raster size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, geo
from ..functions.color import CHANNELS, Background
from ..session import cut_lineage
from . import raster

TILE = ("raster_id", "z", "tx", "ty")
BLOCK_DDL = "raster_id bigint, z int, tx int, ty int, rgba binary"
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
FAST = 1  # zlib level
UNPACK_ROWS = 1 << 18
WINDOW_TILES = 4  # a tile's source window is taken as a block up to so many tile sides


def pack_blocks(tiles: DataFrame, tile_size: int, bg: Background = Background()) -> DataFrame:
    """Tile pixels to blocks; pixels that are not there take the background. A tile that has a row without offsets only is blank and has
    no bytes (null).

    The sorted pixels of a tile are written as hex with the gaps between them filled, all in column expressions.
    """
    blank = "".join(f"{v:02X}" for v in (bg.r, bg.g, bg.b, bg.a))
    colour = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in CHANNELS])
    cell = F.struct((F.col("oy") * tile_size + F.col("ox")).cast("int").alias("p"), colour.alias("c"))
    cells = F.col("_cells")

    def filled(c: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(cells, i - 1)["p"])
        return F.concat(F.repeat(F.lit(blank), c["p"] - before - 1), c["c"])

    tail = F.repeat(F.lit(blank), F.lit(tile_size * tile_size - 1) - F.get(cells, F.size(cells) - 1)["p"])
    text = F.concat(F.array_join(F.transform(cells, filled), ""), tail)
    return (
        tiles.groupBy(*TILE)
        .agg(F.sort_array(F.collect_list(F.when(F.col("ox").isNotNull(), cell))).alias("_cells"))
        .select(*TILE, F.when(F.size("_cells") > 0, F.unhex(text)).alias("rgba"))
    )


def unpack_blocks(blocks: DataFrame, tile_size: int) -> DataFrame:
    """Blocks back to tile pixels; blank blocks (null) have none. The rows of a few blocks are made at a time."""
    cells = tile_size * tile_size
    at_once = max(1, UNPACK_ROWS // cells)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), at_once):
                part = pdf.iloc[at : at + at_once]
                levels = np.frombuffer(b"".join(part["rgba"]), np.uint8).reshape(-1, 4).astype(np.int32)
                place = np.tile(np.arange(cells, dtype=np.int32), len(part))
                keys = {k: np.repeat(part[k].to_numpy(), cells) for k in TILE}
                yield pd.DataFrame(
                    keys | {"ox": place % tile_size, "oy": place // tile_size} | {c: levels[:, k] for k, c in enumerate(CHANNELS)}
                )

    rows = ", ".join(f"{c} int" for c in ("z", "tx", "ty", "ox", "oy", *CHANNELS))
    return blocks.select(*TILE, "rgba").filter("rgba is not null").mapInPandas(unpack, f"raster_id bigint, {rows}")


def _halve(double: np.ndarray, axis: int) -> np.ndarray:
    """Exact ratio-2 triangle filter along one axis: taps 1,3,3,1 less the ones outside. Returns sums."""
    pad = [(0, 0)] * double.ndim
    pad[axis] = (1, 1)
    padded = np.moveaxis(np.pad(double, pad), axis, 0)
    sums = padded[0:-2:2] + 3 * padded[1:-1:2] + 3 * padded[2::2] + padded[3::2]
    return np.moveaxis(sums, 0, axis)


def _totals(n: int) -> np.ndarray:
    t = np.full(n, 8)
    t[0] -= 1
    t[-1] -= 1
    return t


def merge_blocks(blocks: DataFrame, tile_size: int) -> DataFrame:
    """Block form of the pyramid merge: four children side by side in one row, numpy over batches of parents.

    Spark sizes the batches by bytes, so large tiles come a few at a time.
    """
    shape = (-1, tile_size, tile_size, 4)
    nothing = bytes(tile_size * tile_size * 4)
    t = _totals(tile_size)
    total = (t[:, None] * t[None, :])[None, :, :, None]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            double = np.zeros((len(pdf), 2 * tile_size, 2 * tile_size, 4), dtype=np.int32)
            for q in range(4):
                y, x = (q // 2) * tile_size, (q % 2) * tile_size
                child = b"".join(nothing if c is None else c for c in pdf[f"_q{q}"])
                double[:, y : y + tile_size, x : x + tile_size] = np.frombuffer(child, np.uint8).reshape(shape)
            sums = _halve(_halve(double, 1), 2)
            merged = ((2 * sums + total) // (2 * total)).astype(np.uint8)
            yield pdf[list(TILE)].assign(rgba=[m.tobytes() for m in merged])

    quadrant = (F.col("ty") % 2) * 2 + F.col("tx") % 2
    parents = blocks.groupBy(
        "raster_id", (F.col("z") - 1).alias("z"), F.floor(F.col("tx") / 2).cast("int").alias("tx"),
        F.floor(F.col("ty") / 2).cast("int").alias("ty"),
    ).agg(*[F.max(F.when(quadrant == q, F.col("rgba"))).alias(f"_q{q}") for q in range(4)])
    return parents.mapInPandas(merge, BLOCK_DDL)


def _weights(n: int, n2: int) -> np.ndarray:
    """Fixed-point weights (n2 x n) of the cubic filter, the same numbers as the relational form."""
    ratio = n / n2
    s = max(1.0, ratio)
    t = np.abs((np.arange(n) + 0.5)[None, :] - ((np.arange(n2) + 0.5) * ratio)[:, None]) / s
    near = 1.5 * t * t * t - 2.5 * t * t + 1.0
    far = -0.5 * t * t * t + 2.5 * t * t - 4.0 * t + 2.0
    scaled = np.where(t < 1.0, near, np.where(t < 2.0, far, 0.0)) / s * float(raster.WEIGHT_ONE)
    return np.floor(scaled + 0.5)


def _resize(crop: np.ndarray, out_h: int, out_w: int, cache: dict) -> np.ndarray:
    """Exact integer resize of (h, w, 4): every partial sum stays below 2^53, so float matrices hold it exactly."""
    def table(n: int, n2: int) -> tuple[np.ndarray, np.ndarray]:
        if (n, n2) not in cache:
            w = _weights(n, n2)
            cache[n, n2] = w, w.sum(axis=1)
        return cache[n, n2]

    wy, dy = table(crop.shape[0], out_h)
    wx, dx = table(crop.shape[1], out_w)
    sums = np.einsum("hwc,xw->hxc", np.tensordot(wy, crop, (1, 0)), wx, optimize=True)
    total = (dy[:, None] * dx[None, :]).astype(np.int64)[:, :, None]
    level = np.floor_divide(2 * sums.astype(np.int64) + total, 2 * total)
    return np.clip(level, 0, 255).astype(np.uint8)


def window_blocks(px: DataFrame, tile_size: int, zmax: Column | int, projection: str = "flat") -> DataFrame:
    """Block form of ``raster.extract_windows``: one shuffle brings each tile's source window together.

    Pixels are moved once or twice instead of once per filter tap. At an image's highest zoom a window is hardly larger than the tile;
    images whose windows are wider than a few tiles take the relational form, which gives the same bytes, so grouped rows are bounded.
    """
    longest = F.greatest("width", "height")
    wide = longest > geo.grid_size(geo.as_col(zmax)) * (WINDOW_TILES * tile_size)
    return _gathered(px.filter(~wide), tile_size, zmax, projection).unionByName(
        pack_blocks(raster.extract_windows(px.filter(wide), tile_size, zmax, projection), tile_size)
    )


def _gathered(px: DataFrame, tile_size: int, zmax: Column | int, projection: str) -> DataFrame:
    sized = px.withColumn("z", geo.as_col(zmax).cast("int"))
    placed = raster.into_windows(raster.into_windows(sized, "y", tile_size, projection), "x", tile_size, projection)
    packed = color.pack(*[F.col(c) for c in CHANNELS])
    grouped = placed.groupBy(*TILE, "n_x", "out_x", "n_y", "out_y").agg(
        F.collect_list((F.col("y") * F.col("n_x") + F.col("x")).cast("long") * (1 << 32) + packed).alias("cells")
    )

    def resize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in batches:
            done = []
            for cells, nx, ox, ny, oy in zip(*(pdf[c] for c in ("cells", "n_x", "out_x", "n_y", "out_y"))):
                crop = np.zeros((ny * nx, 4))
                place, rgba = cells >> 32, cells & 0xFFFFFFFF
                crop[place] = (rgba[:, None] >> np.array([24, 16, 8, 0])) & 255
                block = np.zeros((tile_size, tile_size, 4), np.uint8)
                block[:oy, :ox] = _resize(crop.reshape(ny, nx, 4), oy, ox, cache)
                done.append(block.tobytes())
            yield pdf[list(TILE)].assign(rgba=done)

    return grouped.mapInPandas(resize, BLOCK_DDL)


def strip_blocks(px: DataFrame, tile_size: int, top: int, projection: str = "flat") -> DataFrame:
    """The window method in block form, all levels."""
    return build_blocks(window_blocks(px, tile_size, top, projection), tile_size, top)


def build_blocks(blocks: DataFrame, tile_size: int, top: int, bottom: int = 0, cut_every: int = 4) -> DataFrame:
    """All levels in block form; rasters may begin at different zooms up to ``top``."""
    current = blocks
    out = current
    for step in range(1, top - bottom + 1):
        current = merge_blocks(current.filter(F.col("z") > bottom), tile_size)
        if step % cut_every == 0 and step < top - bottom:
            current = cut_lineage(current)
        out = out.unionByName(current)
    return out.filter(F.col("z") >= bottom)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(rgba: bytes, size: int) -> bytes:
    """A square RGBA8 PNG with unfiltered rows."""
    rows = np.frombuffer(rgba, np.uint8).reshape(size, size * 4)
    raw = np.hstack([np.zeros((size, 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", size, size, 8, 6, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, FAST)) + _chunk(b"IEND", b"")


def encode_png(blocks: DataFrame, tile_size: int, bg: Background = Background()) -> DataFrame:
    """Blocks to PNG files, batch by batch; all blank blocks (null) share the file of the background."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = png_bytes(bytes((bg.r, bg.g, bg.b, bg.a)) * (tile_size * tile_size), tile_size)
        for pdf in batches:
            yield pdf[list(TILE)].assign(content=[blank if b is None else png_bytes(b, tile_size) for b in pdf["rgba"]])

    return blocks.select(*TILE, "rgba").mapInPandas(encode, "raster_id bigint, z int, tx int, ty int, content binary")
