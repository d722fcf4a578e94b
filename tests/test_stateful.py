"""Streams with several state values per key, over several micro-batches, against their table forms."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from rasterlake.operators import jobs as batch_jobs
from rasterlake.plans.job_queries import command_tables, commands_of, failures, now
from rasterlake.streaming import commands
from rasterlake.streaming.run import PROVIDER, read_stream, run_to_table


def add_file(df, folder):
    """One more file, later than the others by its time, since the source reads files in order of their times."""
    df.coalesce(1).write.mode("append").parquet(str(folder))
    files = sorted(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime)
    new = [f for f in files if os.path.getmtime(f) > 1_000_000_000]
    os.utime(new[-1], (1000 * len(files), 1000 * len(files)))


def several_files(df, folder, parts=3):
    """The rows in order of their ids, a file for each micro-batch."""
    ids = df.columns[0]
    ends = df.agg(F.max(ids)).first()[0] + 1
    for k in range(parts):
        low, high = ends * k // parts, ends * (k + 1) // parts
        add_file(df.filter((F.col(ids) >= low) & (F.col(ids) < high)), folder)
    return str(folder)


def stream(spark, folder):
    return read_stream(spark, folder, "*.parquet", files_per_batch=1)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_commands_over_batches(spark, tables, tmp_path):
    """Room and changed jobs pass from one micro-batch to the next: as if all commands had come at once."""
    folder = several_files(tables("events"), tmp_path / "events")
    given = command_tables(tables)
    before = spark.conf.get(PROVIDER, None)
    got = run_to_table(commands.apply_commands(commands_of(stream(spark, folder), "ts"), *given, now(), "400 days"), "commands", rocks=True)
    assert spark.conf.get(PROVIDER, None) == before
    want = batch_jobs.apply_commands(given[0], commands_of(tables("events")), *given[1:], now())
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert got.select("batch_id").distinct().count() >= 3
    assert want.filter("verdict = 'quota_exceeded'").count() and want.filter("verdict = 'queued'").count()


@pytest.fixture(scope="module")
def failed(spark, tables, tmp_path_factory):
    df = failures(tables).select("event_id", "job_id", "ts", "error")
    return df, several_files(df, tmp_path_factory.mktemp("failures") / "f", 4)


@pytest.mark.parametrize("fallback", [False, True])
def test_deliveries_over_batches(spark, failed, fallback):
    df, folder = failed
    written = run_to_table(commands.deliveries(stream(spark, folder), first_is_final=fallback, lateness="400 days"), "deliveries", rocks=True)
    got = commands.split_deliveries(written)
    want = batch_jobs.attempts(df, first_is_final=fallback).withColumn("message", F.col("job_id").cast("string"))
    columns = ("message", "event_id", "attempt", "next_status", "delay_seconds", "release_reservation")
    assert rows(got["attempt"], *columns) == rows(want, *columns)
    assert rows(got["dead"], "message", "event_id", "error") == rows(want.filter("next_status = 'failed'"), "message", "event_id", "error")
    assert got["redelivery"].count() == 0  # the clock is far behind


def test_redelivery_follows_the_clock(spark, tmp_path):
    folder = str(tmp_path / "f")
    for batch in ([(1, "m", 0, "x")], [(2, "m", 40, "x"), (3, "other", 200, "y")], [(4, "other", 5000, "y")], [(5, "other", 5001, "y")]):
        add_file(spark.createDataFrame(batch, "event_id long, job_id string, sec long, error string").select(
            "event_id", "job_id", F.timestamp_seconds(F.col("sec") + 1000).alias("ts"), "error"), folder)
    written = run_to_table(commands.deliveries(stream(spark, folder), lateness="1 minute"), "due", rocks=True)
    due = commands.split_deliveries(written)["redelivery"]
    assert rows(due, "message", "event_id", "attempt", "at_millis") == [("m", 1, 1, 1_030_000), ("m", 2, 2, 1_160_000), ("other", 3, 1, 1_230_000)]


def test_answers_for_losers_in_later_batches(spark, tables, tmp_path):
    intake = tables("job_updates").select("event_id", "user_id", "idempotency_key", "ts", F.lit(7).alias("bytes"))
    again = intake.filter(F.col("event_id") % 5 == 1).withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    folder = several_files(intake, tmp_path / "intake")
    add_file(again, folder)
    got = run_to_table(commands.answers(stream(spark, folder), "400 days"), "answers", rocks=True)
    want = batch_jobs.dedupe(intake.unionByName(again))
    columns = ("event_id", "user_id", "idempotency_key", "runs_as", "duplicate")
    assert rows(got, *columns) == rows(want, *columns)
    assert got.filter("duplicate AND given_back <> 7 OR NOT duplicate AND given_back <> 0").count() == 0
    assert got.filter("duplicate AND event_id >= 1000000").count() > 0


@pytest.mark.parametrize("buckets", [1, 7])
def test_many_messages_in_one_group(spark, failed, buckets):
    """The keys of a bucket keep apart: numbering, deliveries and null messages over several micro-batches."""
    df, folder = failed
    named = stream(spark, folder).withColumn("job_id", F.when(F.col("job_id") % 50 > 0, F.col("job_id")))
    written = run_to_table(commands.deliveries(named, lateness="400 days", buckets=buckets), "bucketed", rocks=True)
    want = batch_jobs.attempts(df.withColumn("job_id", F.when(F.col("job_id") % 50 > 0, F.col("job_id"))))
    want = want.withColumn("message", F.col("job_id").cast("string"))
    columns = ("message", "event_id", "attempt", "next_status", "delay_seconds", "release_reservation")
    assert rows(commands.split_deliveries(written)["attempt"], *columns) == rows(want, *columns)


def test_answers_of_one_bucket_are_forgotten_each_in_its_time(spark, tmp_path):
    hour = 3600
    batches = ([(1, 1, "a", 0), (2, 2, "a", 2 * hour)], [(3, 1, "a", 3 * hour)], [(4, 9, "z", 26 * hour)], [(5, 1, "a", 26 * hour), (6, 2, "a", 26 * hour)], [(7, 1, "a", 26 * hour), (8, None, None, 26 * hour)])
    for batch in batches:
        add_file(spark.createDataFrame(batch, "event_id long, user_id long, idempotency_key string, sec long").select(
            "event_id", "user_id", "idempotency_key", F.timestamp_seconds(F.col("sec") + 10 * hour).alias("ts"), F.lit(5).alias("bytes")), tmp_path / "f")
    got = run_to_table(commands.answers(stream(spark, str(tmp_path / "f")), "1 hour", buckets=1), "forgotten", rocks=True)
    assert rows(got, "event_id", "runs_as", "duplicate", "given_back") == [
        (1, 1, False, 0), (2, 2, False, 0), (3, 1, True, 5), (4, 4, False, 0), (5, 1, True, 5), (6, 2, True, 5), (7, 7, False, 0), (8, 8, False, 0)]
