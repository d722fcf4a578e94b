"""Pixels stored by line, so that a strip of tiles reads its own lines only.

Rows are sorted by raster and line across files and in them, with row groups of bounded size: the statistics of each row group then
cover few lines of one large raster, or a few small rasters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster

GROUP_ROWS = 1 << 20
BOXES = 64  # ranges of rasters whose bounds are pushed to the scan


def write_pixels(px: DataFrame, folder: str, group_rows: int = GROUP_ROWS) -> None:
    """The pixels in order, and one row per raster with its size."""
    order = (*raster.RASTER, "y")
    ordered = px.repartitionByRange(*order).sortWithinPartitions(*order, "x")
    ordered.write.option("parquet.block.row.count.limit", group_rows).parquet(f"{folder}/lines")
    raster.image_sizes(px.sparkSession.read.parquet(f"{folder}/lines")).write.parquet(f"{folder}/sizes")


def read_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/sizes")


def _bounds(wanted: DataFrame) -> Column:
    """A filter that holds for all wanted lines: the rasters cut into at most BOXES ranges of ids, each with its lowest and highest line.

    Only these few numbers come to the driver.
    """
    ends = wanted.agg(F.min("raster_id").alias("low"), F.max("raster_id").alias("high")).first()
    if ends["low"] is None:
        return F.lit(False)
    width = (ends["high"] - ends["low"]) // BOXES + 1
    boxes = wanted.groupBy(F.call_function("div", F.col("raster_id") - ends["low"], F.lit(width)).alias("box")).agg(
        F.min("raster_id").alias("first"), F.max("raster_id").alias("last"), F.min("row_low").alias("low"), F.max("row_high").alias("high")
    )
    inside = None
    for b in boxes.collect():
        one = F.col("raster_id").between(b["first"], b["last"]) & (F.col("y") >= b["low"]) & (F.col("y") < b["high"])
        inside = one if inside is None else inside | one
    return inside


def read_lines(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Pixels of the lines [row_low, row_high) of each raster; ``wanted`` has one row (raster_id, row_low, row_high) per raster."""
    lines = spark.read.parquet(f"{folder}/lines").filter(_bounds(wanted))
    met = lines.join(wanted.select("raster_id", "row_low", "row_high"), "raster_id")
    return met.filter((F.col("y") >= F.col("row_low")) & (F.col("y") < F.col("row_high"))).drop("row_low", "row_high")


def strip_tiles(spark: SparkSession, folder: str, tile_size: int, zmax: Column | int, projection: str, ty: int) -> DataFrame:
    """The tiles of one tile row of every stored raster at its highest zoom, from the lines they need; as ``raster.extract_windows``."""
    sizes = read_sizes(spark, folder).withColumn("z", geo.as_col(zmax).cast("int"))
    wanted = raster.source_rows(sizes, tile_size, projection).filter(F.col("ty") == ty)
    return raster.extract_windows(read_lines(spark, folder, wanted), tile_size, zmax, projection).filter(F.col("ty") == ty)
