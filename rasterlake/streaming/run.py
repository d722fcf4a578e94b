"""Start a query, let it finish what is there, and read its output as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

BATCH = "batch_id"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_batches(stream: DataFrame, mode: str, folder: str):
    """Start writing every micro-batch to its own folder; a replayed batch overwrites itself, so output is exact once."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{BATCH}={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", rocks: bool = False) -> DataFrame:
    """Process all available input and return what was written, with the batch number.

    ``rocks`` keeps the state of this query in RocksDB; a query takes its settings when it starts, so the session's own come back then.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    before = spark.conf.get(PROVIDER, None)
    if rocks:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        query = write_batches(stream, mode, folder)
    finally:
        if rocks and before is None:
            spark.conf.unset(PROVIDER)
        elif rocks:
            spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    schema = stream.schema.add(BATCH, "long")
    return spark.read.schema(schema).parquet(f"{folder}/out")


def newest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Last written row per key of an update-mode output."""
    values = [c for c in written.columns if c not in (*keys, BATCH)]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_v"))
    return latest.select(*keys, "_v.*")


def read_stream(spark: SparkSession, folder: str, glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the parquet files of a folder that match ``glob``."""
    static = spark.read.option("pathGlobFilter", glob).parquet(folder)
    reader = spark.readStream.schema(static.schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
