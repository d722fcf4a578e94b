"""Streams over several files: state must carry from one micro-batch to the next."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import jobs as batch_jobs
from rasterlake.operators import ratelimit as batch_limits
from rasterlake.streaming import jobs, limits
from rasterlake.streaming.run import newest, read_stream, run_to_table


@pytest.fixture(scope="module")
def updates_folder(spark, tables, tmp_path_factory):
    """The job updates cut by time into several files, one micro-batch each."""
    folder = str(tmp_path_factory.mktemp("updates"))
    df = tables("job_updates")
    days = df.select(F.dayofmonth("ts").alias("d")).agg(F.max("d")).first()[0]
    for low in range(0, days + 1, 8):
        part = df.filter((F.dayofmonth("ts") > low) & (F.dayofmonth("ts") <= low + 8))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return read_stream(spark, folder, "*.parquet", files_per_batch=1)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_job_states_over_batches(spark, tables, updates_folder):
    got = newest(run_to_table(jobs.states(stream(spark, updates_folder), "400 days"), "states", "update"), ["job_id"])
    want = batch_jobs.fold(tables("job_updates"))
    columns = ("job_id", "status", "progress", "tiles_done", "applied", "ignored")
    assert rows(got, *columns) == rows(want, *columns)


def test_throttle_over_batches(spark, tables, updates_folder):
    ticks = stream(spark, updates_folder).select("job_id", "event_id", "ts")
    got = run_to_table(jobs.throttle(ticks, 86_400_000, "400 days"), "throttle")
    ends = tables("job_updates").groupBy("job_id").agg(F.max(F.struct("ts", "event_id")).alias("e")).select("job_id", F.col("e.event_id").alias("event_id"))
    want = batch_jobs.throttle(tables("job_updates"), 86_400_000)
    both = {tuple(r) for r in want.select("job_id", "event_id").collect()}
    streamed = {tuple(r) for r in got.select("job_id", "event_id").collect()}
    last = {tuple(r) for r in ends.collect()}
    assert streamed <= both and both - streamed <= last


def test_intake_over_batches(spark, tables, updates_folder):
    got = run_to_table(jobs.first_intake(stream(spark, updates_folder), "60 days"), "intake")
    want = batch_jobs.dedupe(tables("job_updates")).filter("NOT duplicate")
    per_key = lambda df: rows(df.groupBy("user_id", "idempotency_key").count(), "user_id", "idempotency_key", "count")
    assert per_key(got) == per_key(want)


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "req")

    def write(items):
        df = spark.createDataFrame(items, "event_id long, user_id long, sec long").withColumn("ts", F.timestamp_seconds("sec"))
        df = df.selectExpr("event_id", "user_id", "ts", "'p' AS peer_ip", "CAST(NULL AS STRING) AS forwarded_for", "CAST(NULL AS STRING) AS cf_ip", "'post_tiles' AS endpoint")
        df.coalesce(1).write.mode("append").parquet(folder)

    users = spark.createDataFrame([(1, "free")], "user_id long, plan string")
    write([(i, 1, 30) for i in range(12)])
    write([(100, 1, 7200)])
    write([(101, 1, 7201)])  # rows are judged by the watermark of the batch before, so one more batch goes by
    write([(200, 1, 31), (201, 1, 7202)])  # the first is two hours late
    written = run_to_table(limits.window_counts(stream(spark, folder), users), "late", "append")
    first = {r.window: (r.requests, r.allowed, r.rejected) for r in written.collect()}
    assert first[0] == (12, 10, 2)


def test_verdicts_over_batches(spark, tables, tmp_path):
    folder = str(tmp_path / "verdicts")
    requests = tables("requests")
    for k in range(3):
        requests.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    got = run_to_table(limits.verdicts(stream(spark, folder), tables("users"), "60 days"), "verdicts")
    want = batch_limits.window_counts(requests, tables("users"))
    streamed = got.groupBy("identity", "endpoint", "window").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))
    columns = ("identity", "endpoint", "window", "requests", "allowed")
    assert rows(streamed, *columns) == rows(want, *columns)


def test_quiet_jobs_are_reported(spark, tmp_path):
    folder = str(tmp_path / "quiet")

    def write(items):
        df = spark.createDataFrame(items, "job_id long, event_id long, sec long, status string").withColumn("ts", F.timestamp_seconds("sec"))
        df.drop("sec").coalesce(1).write.mode("append").parquet(folder)

    write([(1, 1, 1000, "processing"), (2, 2, 1000, "complete"), (3, 3, 1100, "processing")])
    write([(3, 4, 9000, "processing"), (4, 5, 9000, "queued")])
    got = run_to_table(jobs.stale(stream(spark, folder), "1 minute"), "quiet")
    reported = {(r.job_id, r.seen_ms) for r in got.collect()}
    assert (1, 1_000_000) in reported and not any(j in (2, 4) for j, _ in reported)


def test_many_shuffled_updates_of_one_job_in_one_batch(spark, tmp_path):
    """More rows of a key than one Arrow batch holds, newest first: the same as the fold of the table."""
    folder = str(tmp_path / "busy")
    n = 25_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("job_id"), F.col("id").alias("event_id"), F.lit(3).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        F.when(F.col("id") == 20_000, "failed").otherwise("processing").alias("status"), (F.col("id") % 100).cast("int").alias("progress"),
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("tiles_done"), F.lit(None).cast("long").alias("tiles_total"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("int").alias("retry_count"),
    )
    rows.orderBy(F.desc("event_id")).coalesce(1).write.parquet(folder)
    table = spark.read.parquet(folder)
    got = newest(run_to_table(jobs.states(stream(spark, folder)), "busy", "update"), ["job_id"])
    columns = ("job_id", "status", "progress", "tiles_done", "applied", "ignored")
    assert rows.count() == n and rows_of(got, columns) == rows_of(batch_jobs.fold(table), columns) == [(1, "failed", 0, 19_998, 20_001, 4_999)]
    ticks = table.select("job_id", "event_id", "ts")
    streamed = {r.event_id for r in run_to_table(jobs.throttle(stream(spark, folder).select("job_id", "event_id", "ts"), 60_000), "busy-ticks").collect()}
    assert streamed == {r.event_id for r in batch_jobs.throttle(ticks, 60_000).collect()} - {n - 1}
    latest = newest(run_to_table(jobs.latest_progress(stream(spark, folder)), "busy-latest", "update"), ["job_id"]).first()
    assert (latest.status, latest.tiles_done) == ("processing", n - 1)


def rows_of(df, columns):
    return rows(df, *columns)


class State:
    """A state as the functions of the streams see it."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, millis):
        self.timeout = millis

    def getCurrentWatermarkMs(self):
        return 0


def frame(**columns):
    import pandas as pd

    return pd.DataFrame({k: pd.to_datetime(v, unit="s") if k == "ts" else v for k, v in columns.items()})


def test_last_record_is_sent_when_a_job_falls_idle():
    state = State()
    ticks = frame(event_id=[1, 2, 3], at_millis=[0, 100, 300], step=[250, 250, 250])
    assert [list(f["event_id"]) for f in jobs._thin((7,), iter([ticks.iloc[1:], ticks.iloc[:1]]), state)] == [[1, 3]]
    assert list(jobs._thin((7,), iter([frame(event_id=[4], at_millis=[310], step=[250])]), state))[0].empty
    state.hasTimedOut = True
    assert [list(f["event_id"]) for f in jobs._thin((7,), iter([]), state)] == [[4]] and not state.exists


def test_late_rows_do_not_hide_the_newest_status():
    state = State()
    list(jobs._watch((1,), iter([frame(event_id=[5], ts=[1000], status=["complete"])]), state))
    list(jobs._watch((1,), iter([frame(event_id=[4], ts=[990], status=["processing"])]), state))
    assert state.get[0] == "complete"
    state.hasTimedOut = True
    assert list(jobs._watch((1,), iter([]), state)) == [] and not state.exists


def test_state_of_quiet_jobs_goes():
    for step, value in ((jobs._advance, ("complete", 100, 1, 1, 1, 0)), (jobs._newest, ("processing", 1, 1, 1))):
        state = State(value, timed_out=True)
        assert list(step((1,), iter([]), state)) == [] and not state.exists


class PlainState:
    """As much of the state handle as the folds use."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut = None, False, False

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, millis):
        pass

    def getCurrentWatermarkMs(self):
        return 0


def pieces_of_job(n, closing, seed):
    """Updates of one job in any order and in pieces, as a micro-batch hands them out; those from ``closing`` on may close it."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, n // 2 + 1, n)
    status = np.where((rng.random(n) < 0.01) & (at >= closing), "failed", "processing")
    tiles = pd.array(rng.integers(0, 1000, n), "Int64")
    tiles[rng.random(n) < 0.3] = pd.NA
    df = pd.DataFrame({
        "event_id": rng.permutation(n), "ts": pd.to_datetime(at, unit="s"), "status": status, "progress": rng.integers(-20, 130, n), "tiles_done": tiles,
    })
    return df, [df.iloc[i : i + 10_000] for i in range(0, n, 10_000)]


@pytest.mark.parametrize("closing", [0, 400, 10**9])
def test_states_of_pieces_in_any_order(closing):
    df, pieces = pieces_of_job(1000, closing, 1)
    pieces = [df.iloc[i : i + 37] for i in range(0, 1000, 37)]
    (row,) = pd.concat(jobs._advance((5,), iter(pieces), PlainState())).to_dict("records")
    status, done, applied = None, None, 0
    for r in df.sort_values(["ts", "event_id"]).to_dict("records"):
        if status in (None, "queued", "processing"):
            status, progress, applied = r["status"], min(100, max(0, r["progress"])), applied + 1
            done = done if pd.isna(r["tiles_done"]) else r["tiles_done"]
    assert (row["status"], row["progress"], row["tiles_done"], row["applied"], row["ignored"]) == (status, progress, done, applied, 1000 - applied)
    newest = df.sort_values(["ts", "event_id"]).iloc[-1]
    (last,) = pd.concat(jobs._newest((5,), iter(pieces), PlainState())).to_dict("records")
    assert (last["status"], last["ts_micros"]) == (newest["status"], newest["ts"].value // 1000)


def test_a_million_updates_of_one_job_take_little_memory():
    n = 1_000_000
    df, pieces = pieces_of_job(n, n // 3, 2)
    cut = df[df["status"] == "failed"].sort_values(["ts", "event_id"]).iloc[0]
    applied = int(((df["ts"] < cut["ts"]) | ((df["ts"] == cut["ts"]) & (df["event_id"] <= cut["event_id"]))).sum())
    tracemalloc.start()
    try:
        (row,) = pd.concat(jobs._advance((5,), iter(pieces), PlainState())).to_dict("records")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (row["status"], row["applied"], row["ignored"]) == ("failed", applied, n - applied)
    assert peak < 64 << 20  # 24 bytes a row, in plain numbers


def test_thinning_of_pieces_in_any_order():
    rng = np.random.default_rng(4)
    at = rng.integers(0, 5000, 4000)
    ticks = pd.DataFrame({"event_id": rng.permutation(4000), "at_millis": at, "step": 70})
    got = pd.concat(jobs._thin((1,), iter([ticks.iloc[i : i + 300] for i in range(0, 4000, 300)]), PlainState()))
    want, last = [], None
    for r in ticks.sort_values(["at_millis", "event_id"]).itertuples():
        if last is None or r.at_millis >= last + 70:
            last = r.at_millis
            want.append((r.event_id, r.at_millis))
    assert list(zip(got["event_id"], got["at_millis"])) == want


@pytest.mark.parametrize("buckets", [1, 5])
def test_quiet_jobs_of_one_bucket(spark, tmp_path, buckets):
    """Jobs of a bucket time out each in its own time, also in a micro-batch that has rows of others."""
    folder = str(tmp_path / "quiet")

    def write(items):
        df = spark.createDataFrame(items, "job_id long, event_id long, sec long, status string").withColumn("ts", F.timestamp_seconds("sec"))
        df.drop("sec").coalesce(1).write.mode("append").parquet(folder)

    jobs_at = [(j, j, 1000 + 10 * j, "processing" if j % 3 else "complete") for j in range(40)]
    write([*jobs_at, (None, 50, 1000, "processing")])
    write([(100, 100, 1600, "processing"), (7, 101, 1500, None)])
    write([(101, 102, 1700, "queued")])
    got = run_to_table(jobs.stale(stream(spark, folder), "1 minute", buckets=buckets), "quiet-bucket")
    want = {(j, 1000 * at) for j, _, at, status in jobs_at if status == "processing" and j != 7 and 1000 * at + 300_000 < 1_640_000}
    assert {(r.job_id, r.seen_ms) for r in got.collect()} == want | {(None, 1_000_000)}
