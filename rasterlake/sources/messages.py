"""Job messages: JSON in and out, with unreadable messages kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import JOB_SCHEMA

CORRUPT = "_corrupt_record"


def parse_jobs(raw: DataFrame, body: str = "body") -> DataFrame:
    """Add ``job`` (struct) and ``valid``; a message that cannot be read or has no job id is not valid.

    Works on batch and streaming frames alike. Unknown fields are ignored, missing ones are null.
    """
    schema = T.StructType([*JOB_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(body), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return raw.withColumn("job", parsed).withColumn(
        "valid", F.col(f"job.{CORRUPT}").isNull() & F.col("job.job_id").isNotNull()
    )


def split_jobs(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(readable jobs, messages for the dead-letter table)."""
    parsed = parse_jobs(raw, body)
    dropped = parsed.filter(~F.col("valid")).drop("job", "valid")
    return parsed.filter("valid").drop("valid"), dropped


def to_message(jobs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``body``: the given fields as JSON, null fields left out."""
    return jobs.withColumn("body", F.to_json(F.struct(*fields)))
