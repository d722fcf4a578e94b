"""Stored objects and their sizes, from file metadata only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ARCHIVE_OBJECTS

KEY = r"tiles/([^/]+)/([^/]+)$"


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of all files under a folder; only the metadata columns are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("bytes"))


def tile_set_sizes(objects: DataFrame) -> DataFrame:
    """Bytes per tile set; a tile set with one of its two archives missing is not there."""
    parts = objects.select(
        F.regexp_extract("path", KEY, 1).alias("job_id"), F.regexp_extract("path", KEY, 2).alias("part"), "bytes"
    ).filter(F.col("part").isin(*ARCHIVE_OBJECTS))
    per_part = [F.sum(F.when(F.col("part") == p, F.col("bytes"))) for p in ARCHIVE_OBJECTS]
    total = per_part[0] + per_part[1]
    sized = parts.groupBy("job_id").agg(total.alias("size_bytes"))
    return sized.filter(F.col("size_bytes").isNotNull()).select(
        F.concat(F.lit("tiles/"), "job_id").alias("storage_path"), "size_bytes"
    )
