"""Streaming queries: each drains the event file and returns what was written.

They are checked against the batch rule in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import balances, commands, jobs, limits
from ..streaming.run import new_folder, newest, read_stream, run_to_table
from .fixtures import VIEWS, Registry, Tables
from .job_queries import COMMAND_SQL, FOLD_SQL, IDENTITY_SQL, command_tables, commands_of, now

REG = Registry()


def live(t: Tables, view: str) -> DataFrame:
    """A view over the stream of the event file."""
    events = read_stream(t.spark, t.sf_dir, "events.parquet")
    return t.spark.sql(VIEWS[view].replace("FROM events", "FROM {events}"), events=events)


@REG.query(
    "requests", "users",
    sql=IDENTITY_SQL + """
SELECT identity, endpoint, win AS "window", lim AS "limit", COUNT(*) AS requests, least(COUNT(*), lim) AS allowed, COUNT(*) - least(COUNT(*), lim) AS rejected FROM vd GROUP BY 1, 2, 3, 4""",
)
def stream_rate_limit_counts(t: Tables):
    written = run_to_table(limits.window_counts(live(t, "requests"), t("users")), "rate-counts", "update")
    return newest(written, ["identity", "endpoint", "window", "limit"])


@REG.query(
    "requests", "users",
    sql=IDENTITY_SQL + """
SELECT identity, endpoint, win AS "window", COUNT(*) AS requests, COUNT(*) FILTER (rn <= lim) AS allowed, MIN(CAST(greatest(0, lim - rn) AS INT)) AS remaining FROM vd GROUP BY 1, 2, 3""",
)
def stream_rate_limit_verdicts(t: Tables):
    written = run_to_table(limits.verdicts(live(t, "requests"), t("users")), "rate-verdicts")
    return written.groupBy("identity", "endpoint", "window").agg(
        F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"), F.min("remaining").alias("remaining")
    )


@REG.query("job_updates", sql=FOLD_SQL + "SELECT job_id, status, progress, tiles_done, epoch_us(updated_at) // 1000 AS updated_ms, applied, ignored FROM st")
def stream_job_states(t: Tables):
    return newest(run_to_table(jobs.states(live(t, "job_updates")), "job-states", "update"), ["job_id"])


@REG.query(
    "job_updates",
    sql="""
l AS (SELECT job_id, arg_max(status, event_id) AS status, epoch_us(MAX(ts)) // 1000 AS seen_ms FROM job_updates GROUP BY 1)
SELECT job_id, 'failed' AS status, 'worker stopped updating this job' AS error, seen_ms FROM l
WHERE status = 'processing' AND seen_ms + 300000 <= (SELECT epoch_us(MAX(ts)) // 1000 - 600000 FROM job_updates)""",
)
def stream_stale_jobs(t: Tables):
    return run_to_table(jobs.stale(live(t, "job_updates")), "stale-jobs").drop("batch_id")


@REG.query(
    "job_updates",
    sql="""
SELECT job_id, status, tiles_done, ts FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM job_updates) q WHERE rn = 1""",
)
def stream_latest_progress(t: Tables):
    return newest(run_to_table(jobs.latest_progress(live(t, "job_updates")), "latest-progress", "update"), ["job_id"])


@REG.query(
    "job_updates",
    sql="""
SELECT user_id, idempotency_key, CASE WHEN idempotency_key IS NULL THEN COUNT(*) ELSE 1 END AS accepted FROM job_updates GROUP BY 1, 2""",
)
def stream_idempotent_intake(t: Tables):
    accepted = run_to_table(jobs.first_intake(live(t, "job_updates")), "intake")
    return accepted.groupBy("user_id", "idempotency_key").agg(F.count("*").alias("accepted"))


@REG.query(
    "progress_ticks",
    sql="""
tk AS (SELECT job_id, epoch_us(ts) // 1000 AS at_millis, MIN(event_id) AS event_id FROM progress_ticks GROUP BY 1, 2),
nx AS (SELECT a.job_id, a.at_millis, (SELECT MIN(b.at_millis) FROM tk b WHERE b.job_id = a.job_id AND b.at_millis >= a.at_millis + 21600000) AS following FROM tk a),
walk AS (SELECT job_id, MIN(at_millis) AS at_millis FROM tk GROUP BY 1
         UNION ALL SELECT n.job_id, n.following FROM walk w JOIN nx n ON n.job_id = w.job_id AND n.at_millis = w.at_millis WHERE n.following IS NOT NULL),
ends AS (SELECT job_id, epoch_us(ts) // 1000 AS at_millis, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS rn FROM progress_ticks) q
         WHERE rn = 1 AND epoch_us(ts) // 1000 + 60000 <= (SELECT epoch_us(MAX(ts)) // 1000 - 600000 FROM progress_ticks))
SELECT tk.* FROM tk JOIN walk USING (job_id, at_millis) UNION SELECT * FROM ends""",
)
def stream_throttled_progress(t: Tables):
    """The last record of a job counts too, once the clock of the stream has passed its idle time."""
    return run_to_table(jobs.throttle(live(t, "progress_ticks"), 6 * 3600 * 1000), "throttle").drop("batch_id")


@REG.query(
    sql="SELECT event_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'jobs' END AS went_to, CASE WHEN event_type <> 'error' THEN concat('job-', CAST(user_id AS VARCHAR)) END AS job_id FROM events",
)
def stream_message_intake(t: Tables):
    events = read_stream(t.spark, t.sf_dir, "events.parquet")
    body = F.to_json(F.struct(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.lit(256).alias("tile_size")))
    raw = events.select("event_id", F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(body).alias("body"))
    folder = new_folder(t.spark, "messages")
    jobs.intake_messages(raw, folder).awaitTermination()
    good = t.spark.read.schema("event_id bigint, job_id string").parquet(f"{folder}/jobs")
    bad = t.spark.read.schema("event_id bigint, body string").parquet(f"{folder}/dead")
    return good.select("event_id", F.lit("jobs").alias("went_to"), "job_id").unionByName(
        bad.select("event_id", F.lit("dead").alias("went_to"), F.lit(None).cast("string").alias("job_id"))
    )


@REG.query("job_updates", sql=COMMAND_SQL)
def stream_commands(t: Tables):
    """The commands of ``cancel_and_retry`` as they come; room and changed jobs are kept in the state of their owner."""
    events = read_stream(t.spark, t.sf_dir, "events.parquet")
    asked = commands_of(events, "ts")
    return run_to_table(commands.apply_commands(asked, *command_tables(t), now()), "commands", rocks=True).drop("batch_id")


STREAM_FAIL_SQL = """
fl AS (SELECT CAST(job_id AS VARCHAR) AS message, event_id, epoch_us(ts) // 1000 AS ms, error, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt FROM job_updates WHERE error IS NOT NULL),
dl AS (SELECT *, CASE attempt WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 300 WHEN 4 THEN 600 END AS delay_seconds FROM fl WHERE attempt <= 5)"""


def delivered(t: Tables, first_is_final: bool = False):
    failed = live(t, "job_updates").filter(F.col("error").isNotNull())
    written = run_to_table(commands.deliveries(failed, first_is_final=first_is_final), "deliveries", rocks=True)
    return commands.split_deliveries(written)


@REG.query(
    "job_updates",
    sql=STREAM_FAIL_SQL + """
SELECT message, event_id, CAST(attempt AS INT) AS attempt, CASE WHEN attempt >= 5 THEN 'failed' ELSE 'queued' END AS next_status, delay_seconds, attempt >= 5 AS release_reservation FROM dl""",
)
def stream_attempts(t: Tables):
    return delivered(t)["attempt"]


@REG.query(
    "job_updates",
    sql=STREAM_FAIL_SQL + """
SELECT message, event_id, CAST(attempt AS INT) AS attempt, ms + delay_seconds * 1000 AS at_millis FROM dl
WHERE attempt < 5 AND ms + delay_seconds * 1000 <= (SELECT epoch_us(MAX(ts)) // 1000 - 600000 FROM job_updates WHERE error IS NOT NULL)""",
)
def stream_redeliveries(t: Tables):
    """Deliveries that fell due before the clock of the stream stopped."""
    return delivered(t)["redelivery"]


@REG.query("job_updates", sql=STREAM_FAIL_SQL + "SELECT message, event_id, error FROM dl WHERE attempt = 5")
def stream_dead_letters(t: Tables):
    return delivered(t)["dead"]


@REG.query("job_updates", sql=STREAM_FAIL_SQL + "SELECT message, event_id, error FROM dl WHERE attempt = 1")
def stream_fallback_dead_letters(t: Tables):
    """On the fallback queue the first failure is final."""
    return delivered(t, first_is_final=True)["dead"]


@REG.query(
    "job_updates",
    sql="""
SELECT event_id, user_id, idempotency_key, w AS runs_as, w <> event_id AS duplicate, CASE WHEN w <> event_id THEN COALESCE(tiles_done, 0) ELSE 0 END AS given_back FROM (
  SELECT *, CASE WHEN idempotency_key IS NULL THEN event_id ELSE first_value(event_id) OVER (PARTITION BY user_id, idempotency_key ORDER BY ts, event_id) END AS w FROM job_updates) q""",
)
def stream_intake_answers(t: Tables):
    intake = live(t, "job_updates").withColumn("bytes", F.col("tiles_done"))
    return run_to_table(commands.answers(intake), "answers", rocks=True).drop("batch_id")


@REG.query(
    "users", "tile_sets",
    sql="""
SELECT u.user_id, CAST(COALESCE(SUM(CASE tileset_id % 3 WHEN 0 THEN size_bytes WHEN 1 THEN size_bytes // 2 ELSE 0 END), 0) AS BIGINT) AS used_bytes
FROM users u LEFT JOIN tile_sets s ON s.user_id = u.user_id GROUP BY 1""",
)
def stream_storage_balance(t: Tables):
    """Every tile set is inserted; later one in three is halved and one in three deleted."""
    sets = t.spark.sql(VIEWS["tile_sets"].replace("FROM orders", "FROM {orders}"), orders=read_stream(t.spark, t.sf_dir, "orders.parquet"))
    size, kind = F.col("size_bytes"), F.col("tileset_id") % 3
    none = F.lit(0).cast("long")

    def change(op: str, old, new):
        return F.struct(F.lit(op).alias("op"), old.alias("old_bytes"), new.alias("new_bytes"))

    log = sets.select("user_id", F.explode(
        F.when(kind == 0, F.array(change("insert", none, size)))
        .when(kind == 1, F.array(change("insert", none, size), change("update", size, F.floor(size / 2))))
        .otherwise(F.array(change("insert", none, size), change("delete", size, none)))
    ).alias("c")).select("user_id", "c.*")
    start = t("users").select("user_id", none.alias("used_bytes"))
    return balances.drain(log, start, new_folder(t.spark, "balances"))
