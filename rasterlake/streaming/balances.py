"""Used bytes kept up to date from a stream of tile-set changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage
from .run import BATCH

SNAPSHOT = "upto"
EVERY = 32  # micro-batches from one snapshot to the next
SCHEMA = "user_id long, delta long"


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.sum("delta").alias("delta"))


def _deltas(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """What the given micro-batches added, at most EVERY of them."""
    paths = [f"{folder}/deltas/{BATCH}={i}" for i in ids]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def _snapshot(spark: SparkSession, folder: str, upto: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/snapshots/{SNAPSHOT}={upto}") if upto >= 0 else spark.createDataFrame([], SCHEMA)


def fold(changes: DataFrame, folder: str, every: int = EVERY):
    """A writer of the stream ``changes`` (op, user_id, old_bytes, new_bytes), to be started with a checkpoint location.

    A micro-batch is reduced to one row per user before anything is written, into a folder named by its number, so a batch that is replayed
    writes the same rows over the old ones and adds nothing. Every ``every`` batches a snapshot adds the last one and the batches since, also
    under its number; older folders are never read again and can be removed.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        storage.deltas(batch).write.mode("overwrite").parquet(f"{folder}/deltas/{BATCH}={number}")
        if (number + 1) % every == 0:
            since = _deltas(spark, folder, list(range(number + 1 - every, number + 1)))
            total = _sum(_snapshot(spark, folder, number - every).unionByName(since))
            total.write.mode("overwrite").parquet(f"{folder}/snapshots/{SNAPSHOT}={number}")

    return changes.writeStream.foreachBatch(save)


def written(spark: SparkSession, folder: str) -> int:
    """How many micro-batches are in the folder as a whole; they are numbered from 0 without gaps."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/deltas/{BATCH}=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return max((int(f.getPath().getParent().getName().split("=")[1]) + 1 for f in found or ()), default=0)


def balances(start: DataFrame, folder: str, every: int = EVERY) -> DataFrame:
    """The balance table (user_id, used_bytes) ``start`` after all written micro-batches, from one snapshot and fewer than ``every`` + 1 folders.

    The newest batches are always read by themselves, so a snapshot that is just being written is not looked at.
    """
    spark = start.sparkSession
    batches = written(spark, folder)
    upto = max(batches - 1, 0) // every * every - 1
    since = _deltas(spark, folder, list(range(upto + 1, batches)))
    return storage.apply_deltas(start, _sum(_snapshot(spark, folder, upto).unionByName(since)))


def drain(changes: DataFrame, start: DataFrame, folder: str, every: int = EVERY) -> DataFrame:
    """Take all that is there and return the balances after it."""
    fold(changes, folder, every).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return balances(start, folder, every)
