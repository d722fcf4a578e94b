"""Tile tables on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tile_path
from ..operators.archive import tile_id
from ..session import cut_lineage, qualified


def with_paths(tiles: DataFrame, fmt: str = "png") -> DataFrame:
    return tiles.withColumn("path", tile_path(F.col("z"), F.col("tx"), F.col("ty"), F.lit(fmt)))


def in_archive_order(tiles: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition by raster and curve position and sort within: neighbours end up in one file."""
    placed = tiles.withColumn("tile_id", tile_id(F.col("z"), F.col("tx"), F.col("ty")))
    keys = ("raster_id", "tile_id")
    spread = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def in_tile_order(tiles: DataFrame) -> DataFrame:
    """Rows of a raster's zooms from the top, each from left to right, across the files and in them."""
    keys = ("raster_id", "z", "ty", "tx")
    return tiles.repartitionByRange(*keys).sortWithinPartitions(*keys)


def with_positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """``ordered`` with the number of each row in the order it has, from 0, without moving rows: places in their partitions and how many
    rows the partitions before hold (one row per partition, broadcast)."""
    row = F.monotonically_increasing_id()
    kept = cut_lineage(ordered.withColumns({"_part": F.shiftright(row, 33), "_at": row.bitwiseAND(2**33 - 1)}))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def write_tiles(tiles: DataFrame, path: str, fmt: str = "png", mode: str = "errorifexists") -> None:
    """Write encoded tiles partitioned by zoom, in curve order. They are compressed already, so Parquet does not."""
    ordered = with_paths(in_archive_order(tiles), fmt)
    ordered.write.mode(mode).partitionBy("z").option("compression", "none").parquet(path)


def write_files(tiles: DataFrame, root: str, fmt: str = "png") -> None:
    """Write each tile to ``root/raster_id/z/x/y.ext`` from the tasks, on any file system that Arrow knows.

    A root without a scheme is in the session's own file system, which on a cluster is the one all executors share. A task that runs again writes the same files again.
    """
    root = qualified(tiles.sparkSession, root)

    def save(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for row in rows:
            target = f"{base}/{row['raster_id']}/{row['path']}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(target) as out:
                out.write(bytes(row["content"]))

    with_paths(tiles, fmt).select("raster_id", "path", "content").foreachPartition(save)


def watched(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """Count rows (and any further metrics) as they pass, without a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def tee(df: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """Feed several sinks from one computation of ``df``."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()
