"""Queries over jobs, progress, intake and request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, jobs, ratelimit
from .fixtures import Registry, Tables

REG = Registry()
NOW_SQL = "CAST('2024-01-28 00:00:00' AS TIMESTAMP)"


def now():
    return F.lit("2024-01-28 00:00:00").cast("timestamp")


FOLD_SQL = """
cl AS (SELECT job_id, MIN(event_id) AS close_id FROM job_updates WHERE status NOT IN ('queued', 'processing') GROUP BY 1),
ap AS (SELECT u.*, cl.close_id IS NULL OR event_id <= cl.close_id AS applied FROM job_updates u LEFT JOIN cl ON cl.job_id = u.job_id),
st AS (SELECT job_id, arg_min(user_id, event_id) AS user_id, arg_max(status, event_id) FILTER (applied) AS status,
              least(100, greatest(0, arg_max(progress, event_id) FILTER (applied))) AS progress,
              arg_max(tiles_done, event_id) FILTER (applied AND tiles_done IS NOT NULL) AS tiles_done,
              arg_max(tiles_total, event_id) FILTER (applied AND tiles_total IS NOT NULL) AS tiles_total,
              (arg_max(struct_pack(e := error), event_id) FILTER (applied)).e AS error,
              COALESCE(arg_max(retry_count, event_id) FILTER (applied AND retry_count IS NOT NULL), 0) AS retry_count,
              MIN(ts) AS created_at, MAX(ts) FILTER (applied) AS updated_at, MAX(ts) FILTER (applied AND status = 'complete') AS completed_at,
              COUNT(*) FILTER (applied) AS applied, COUNT(*) FILTER (NOT applied) AS ignored FROM ap GROUP BY 1)"""


@REG.query("job_updates", sql=FOLD_SQL + "SELECT * FROM st")
def job_states(t: Tables):
    return jobs.fold(t("job_updates"))


@REG.query("job_updates", sql=FOLD_SQL + "SELECT job_id, status FROM st WHERE status NOT IN ('queued', 'processing')")
def jobs_to_stop(t: Tables):
    return jobs.should_stop(jobs.fold(t("job_updates"))).select("job_id", "status")


@REG.query("job_updates", sql=FOLD_SQL + "SELECT status, COUNT(*) AS jobs FROM st GROUP BY 1")
def queue_depth(t: Tables):
    return jobs.queue_depth(jobs.fold(t("job_updates")))


@REG.query(
    "job_updates",
    sql=FOLD_SQL + f""", r AS (SELECT *, status = 'processing' AND updated_at < {NOW_SQL} - INTERVAL 300 SECONDS AS reaped FROM st)
SELECT job_id, reaped, CASE WHEN reaped THEN 'failed' ELSE status END AS status, CASE WHEN reaped THEN 'worker stopped updating this job' ELSE error END AS error,
       CASE WHEN reaped THEN {NOW_SQL} ELSE updated_at END AS updated_at FROM r""",
)
def reap_stale_jobs(t: Tables):
    return jobs.reap(jobs.fold(t("job_updates")), now()).select("job_id", "reaped", "status", "error", "updated_at")


def reserved_jobs(t: Tables):
    return jobs.fold(t("job_updates")).withColumn("reserved_bytes", F.col("job_id") * 1000)


def commands_of(events, *more: str):
    return events.select(
        *more,
        F.col("event_id").alias("command_id"), (F.col("user_id") * 6 + F.col("event_id") % 6).alias("job_id"),
        F.when(F.col("event_id") % 8 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type").isin("click", "view"), "cancel").otherwise("retry").alias("command"),
    )


def command_tables(t: Tables):
    """Jobs with their reservations, those whose source is stored, and the room of each user."""
    state = reserved_jobs(t)
    users = t("events").select("user_id").unionByName(t("events").select((F.col("user_id") + 1).alias("user_id"))).distinct()
    return state, state.filter(F.col("job_id") % 5 != 0), users.withColumn("room", F.col("user_id") * 9000)


# One command of a user after the other: a job's status is the stored one until a retry queues it or a cancel ends it.
COMMAND_SQL = FOLD_SQL + f""",
cm AS (SELECT event_id AS command_id, user_id * 6 + event_id % 6 AS job_id, CASE WHEN event_id % 8 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
              CASE WHEN event_type IN ('click', 'view') THEN 'cancel' ELSE 'retry' END AS command FROM events),
own AS (SELECT c.*, s.status, c.job_id * 1000 AS bytes, row_number() OVER (PARTITION BY c.user_id ORDER BY command_id) AS n FROM cm c JOIN st s ON s.job_id = c.job_id AND s.user_id = c.user_id),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, user_id * 9000 AS room, CAST([] AS BIGINT[]) AS queued, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS command_id, '' AS verdict, '' AS status
  FROM (SELECT DISTINCT user_id FROM own)
  UNION ALL
  SELECT user_id, n, CASE WHEN v = 'queued' THEN room - bytes ELSE room END, CASE WHEN v = 'queued' THEN list_append(queued, job_id) ELSE queued END,
         CASE WHEN v = 'cancelled' THEN list_append(gone, job_id) ELSE gone END, command_id, v, CASE WHEN v IN ('queued', 'cancelled') THEN v ELSE cur END
  FROM (SELECT *, CASE WHEN command = 'cancel' THEN CASE WHEN cur IN ('queued', 'processing') THEN 'cancelled' ELSE 'conflict' END
                       WHEN cur <> 'failed' THEN 'conflict' WHEN job_id % 5 = 0 THEN 'source_gone' WHEN bytes > room THEN 'quota_exceeded' ELSE 'queued' END AS v
        FROM (SELECT o.*, w.room, w.queued, w.gone,
                     CASE WHEN list_contains(w.gone, o.job_id) THEN 'cancelled' WHEN list_contains(w.queued, o.job_id) THEN 'queued' ELSE o.status END AS cur
              FROM walk w JOIN own o ON o.user_id = w.user_id AND o.n = w.n + 1) q) q2),
v AS (SELECT cm.command_id, cm.job_id, COALESCE(w.verdict, 'not_found') AS verdict, w.status FROM cm LEFT JOIN walk w ON w.command_id = cm.command_id)
SELECT command_id, job_id, verdict, status, CASE WHEN verdict IN ('cancelled', 'queued') THEN {NOW_SQL} END AS updated_at, CASE WHEN verdict = 'cancelled' THEN {NOW_SQL} END AS cancelled_at,
       CASE verdict WHEN 'cancelled' THEN TRUE WHEN 'queued' THEN FALSE END AS reservation_released FROM v"""


@REG.query("job_updates", sql=COMMAND_SQL)
def cancel_and_retry(t: Tables):
    """Commands of owners and strangers; a user's room holds one retried job, but not two."""
    state, uploads, room = command_tables(t)
    return jobs.apply_commands(state, commands_of(t("events")), uploads, room, now())


RETRIED_SQL = """
rt AS (SELECT job_id, ts, event_id FROM job_updates WHERE status = 'failed' AND event_id % 2 = 0),
ru AS (SELECT u.*, (SELECT COUNT(*) FROM rt WHERE rt.job_id = u.job_id AND (rt.ts < u.ts OR rt.ts = u.ts AND rt.event_id * 2 + 1 < u.event_id * 2)) AS run FROM job_updates u),
cl AS (SELECT job_id, run, MIN(event_id) AS close_id FROM ru WHERE status NOT IN ('queued', 'processing') GROUP BY 1, 2),
ap AS (SELECT ru.*, cl.close_id IS NULL OR event_id <= cl.close_id AS applied FROM ru LEFT JOIN cl ON cl.job_id = ru.job_id AND cl.run = ru.run),
st AS (SELECT job_id, MAX(run) AS run, arg_max(status, event_id) FILTER (applied) AS status, COUNT(*) FILTER (applied) AS applied, COUNT(*) FILTER (NOT applied) AS ignored FROM ap GROUP BY 1),
n AS (SELECT job_id, COUNT(*) AS n FROM rt GROUP BY 1)
SELECT st.job_id, CASE WHEN COALESCE(n, 0) > run THEN 'queued' ELSE status END AS status, applied, ignored FROM st LEFT JOIN n ON n.job_id = st.job_id"""


@REG.query("job_updates", sql=RETRIED_SQL)
def retried_job_states(t: Tables):
    """States with jobs reopened by retries, each just after a failure; ids are doubled so that a retry has one between two updates."""
    updates = t("job_updates").withColumn("event_id", F.col("event_id") * 2)
    retries = updates.filter((F.col("status") == "failed") & (F.col("event_id") % 4 == 0)).select("job_id", "ts", (F.col("event_id") + 1).alias("event_id"))
    return jobs.fold(updates, retries).select("job_id", "status", "applied", "ignored")


@REG.query(
    "job_updates",
    sql=f"""
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM job_updates) q WHERE rn = 1 AND ts > {NOW_SQL} - INTERVAL 432000 SECONDS),
v AS (SELECT w.job_id, l.*, COALESCE(l.status NOT IN ('complete', 'failed') AND epoch({NOW_SQL}) - floor(epoch(l.ts)) > 86400, FALSE) AS stale
      FROM (SELECT DISTINCT job_id FROM job_updates) w LEFT JOIN l ON l.job_id = w.job_id)
SELECT job_id, CASE WHEN ts IS NULL THEN 'unknown' WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN 'job timed out (worker may have crashed)' ELSE error END AS error,
       CASE WHEN NOT stale THEN tiles_done END AS tiles_done, COALESCE(status IN ('complete', 'failed') OR stale, FALSE) AS ends FROM v""",
)
def progress_view(t: Tables):
    updates = t("job_updates")
    latest = jobs.latest_progress(updates, now(), 5 * 86400)
    return jobs.progress_view(updates.select("job_id").distinct(), latest, now(), 86400)


FAIL_SQL = """
fl AS (SELECT job_id, event_id, ts, error, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt FROM job_updates WHERE error IS NOT NULL)"""


def failures(t: Tables):
    return t("job_updates").filter(F.col("error").isNotNull()).select("job_id", "event_id", "ts", "error")


@REG.query(
    "job_updates",
    sql=FAIL_SQL + """
SELECT job_id, event_id, CAST(attempt AS INT) AS attempt, CASE WHEN attempt >= 5 THEN 'failed' ELSE 'queued' END AS next_status,
       CASE attempt WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 300 WHEN 4 THEN 600 END AS delay_seconds, attempt >= 5 AS release_reservation FROM fl WHERE attempt <= 5""",
)
def delivery_attempts(t: Tables):
    return jobs.attempts(failures(t)).select("job_id", "event_id", "attempt", "next_status", "delay_seconds", "release_reservation")


@REG.query(
    "job_updates",
    sql="""
fl AS (SELECT job_id, event_id, concat(CAST(job_id AS VARCHAR), '#', CAST(event_id % 2 AS VARCHAR)) AS message, row_number() OVER (PARTITION BY job_id, event_id % 2 ORDER BY ts, event_id) AS attempt
       FROM job_updates WHERE error IS NOT NULL)
SELECT 'main' AS queue, message, event_id, CAST(attempt AS INT) AS attempt, CASE WHEN attempt >= 5 THEN 'failed' ELSE 'queued' END AS next_status FROM fl WHERE attempt <= 5
UNION ALL SELECT 'fallback', message, event_id, CAST(attempt AS INT), 'failed' FROM fl WHERE attempt = 1""",
)
def attempts_by_message(t: Tables):
    """Attempts counted per message, which a retry renews; on the fallback queue the first failure is final."""
    message = F.concat_ws("#", F.col("job_id").cast("string"), (F.col("event_id") % 2).cast("string"))
    failed = failures(t).withColumn("message", message)
    both = [("main", jobs.attempts(failed, "message")), ("fallback", jobs.attempts(failed, "message", first_is_final=True))]
    shown = [df.select(F.lit(queue).alias("queue"), "message", "event_id", "attempt", "next_status") for queue, df in both]
    return shown[0].unionByName(shown[1])


@REG.query("job_updates", sql=FAIL_SQL + f"SELECT job_id, event_id, error FROM fl WHERE attempt = 5 AND ts > {NOW_SQL} - INTERVAL 7 DAYS")
def dead_letters(t: Tables):
    return jobs.dead_letters(failures(t), now()).select("job_id", "event_id", "error")


@REG.query("job_updates", sql=f"SELECT event_id, job_id FROM job_updates WHERE ts > {NOW_SQL} - INTERVAL 24 HOURS")
def retained_messages(t: Tables):
    return jobs.queued_messages(t("job_updates"), now()).select("event_id", "job_id")


@REG.query(
    "job_updates",
    sql="""
SELECT event_id, user_id, idempotency_key, w AS runs_as, w <> event_id AS duplicate FROM (
  SELECT *, CASE WHEN idempotency_key IS NULL THEN event_id ELSE first_value(event_id) OVER (PARTITION BY user_id, idempotency_key ORDER BY ts, event_id) END AS w FROM job_updates) q""",
)
def idempotent_intake(t: Tables):
    return jobs.dedupe(t("job_updates"))


@REG.query(
    "job_updates",
    sql="SELECT event_id, CAST(least(99, COALESCE(tiles_done * 100 // nullif(tiles_total - 40, 0), 0)) AS INT) AS percent FROM job_updates WHERE tiles_done IS NOT NULL",
)
def progress_percent(t: Tables):
    known = t("job_updates").filter(F.col("tiles_done").isNotNull())
    return known.select("event_id", jobs.percent(F.col("tiles_done"), F.col("tiles_total") - 40).alias("percent"))


THROTTLE_SQL = """
tk AS (SELECT job_id, (epoch_us(ts) // 1000) AS at_millis, MIN(event_id) AS event_id FROM progress_ticks GROUP BY 1, 2),
nx AS (SELECT a.job_id, a.at_millis, (SELECT MIN(b.at_millis) FROM tk b WHERE b.job_id = a.job_id AND b.at_millis >= a.at_millis + 21600000) AS following FROM tk a),
walk AS (SELECT job_id, MIN(at_millis) AS at_millis FROM tk GROUP BY 1
         UNION ALL SELECT n.job_id, n.following FROM walk w JOIN nx n ON n.job_id = w.job_id AND n.at_millis = w.at_millis WHERE n.following IS NOT NULL),
ends AS (SELECT job_id, (epoch_us(MAX(ts)) // 1000) AS at_millis, arg_max(event_id, struct_pack(a := (epoch_us(ts) // 1000), b := event_id)) AS event_id FROM progress_ticks GROUP BY 1)
SELECT DISTINCT job_id, at_millis, event_id FROM (SELECT tk.* FROM tk JOIN walk USING (job_id, at_millis) UNION ALL SELECT * FROM ends) q"""


@REG.query("progress_ticks", sql=THROTTLE_SQL)
def throttle_progress(t: Tables):
    return jobs.throttle(t("progress_ticks"), 6 * 3600 * 1000)


TILE_TICKS_SQL = """
tk AS (SELECT job_id, tiles_done, MIN(zoom) AS zoom FROM progress_ticks GROUP BY 1, 2),
fl AS (SELECT *, CASE WHEN zoom IS DISTINCT FROM lag(zoom) OVER (PARTITION BY job_id ORDER BY tiles_done) THEN 1 ELSE 0 END AS ch FROM tk),
rn AS (SELECT *, SUM(ch) OVER (PARTITION BY job_id ORDER BY tiles_done) AS run FROM fl),
walk AS (SELECT job_id, run, MIN(tiles_done) AS tiles_done FROM rn GROUP BY 1, 2
         UNION ALL SELECT w.job_id, w.run, (SELECT MIN(b.tiles_done) FROM rn b WHERE b.job_id = w.job_id AND b.run = w.run AND b.tiles_done >= w.tiles_done + 20)
         FROM walk w WHERE EXISTS (SELECT 1 FROM rn b WHERE b.job_id = w.job_id AND b.run = w.run AND b.tiles_done >= w.tiles_done + 20))
SELECT DISTINCT job_id, tiles_done FROM (SELECT job_id, tiles_done FROM walk UNION ALL SELECT job_id, tiles_done FROM tk WHERE tiles_done = 4000) q"""


@REG.query("progress_ticks", sql=TILE_TICKS_SQL)
def throttle_by_tiles(t: Tables):
    return jobs.throttle_by_tiles(t("progress_ticks"), 4000)


@REG.query(
    "image_dims",
    sql="""
SELECT raster_id, CASE WHEN raster_id % 2 = 0 OR CAST(width AS BIGINT) * height * 4 > 268435456 THEN 'queued' ELSE 'immediate' END AS route FROM image_dims""",
)
def route_jobs(t: Tables):
    intake = t("image_dims").withColumn("plan", F.when(F.col("raster_id") % 2 == 0, "pro").otherwise("free")).withColumn(
        "decoded_bytes", F.col("width").cast("long") * F.col("height") * 4
    )
    return jobs.route(intake).select("raster_id", "route")


@REG.query(
    "job_updates",
    sql=FOLD_SQL + "SELECT job_id, CASE WHEN status = 'processing' THEN 'queued' ELSE status END AS status, CASE WHEN status <> 'processing' THEN progress END AS progress FROM st",
)
def cancel_batch(t: Tables):
    return jobs.batch_cancel(jobs.fold(t("job_updates"))).select("job_id", "status", "progress")


@REG.query(
    "job_updates",
    sql=FOLD_SQL + """, b AS (SELECT user_id, COUNT(*) FILTER (status = 'complete') AS succeeded, COUNT(*) FILTER (status = 'failed') AS failed FROM st GROUP BY 1)
SELECT user_id, succeeded, failed, CASE WHEN succeeded > 0 THEN 'processing_complete' ELSE 'processing_failed' END AS type,
       concat(CAST(succeeded AS VARCHAR), ' succeeded, ', CAST(failed AS VARCHAR), ' failed') AS message FROM b WHERE succeeded > 0 OR failed > 0""",
)
def batch_summary(t: Tables):
    return jobs.batch_summary(jobs.fold(t("job_updates")), "user_id")


@REG.query(
    "job_updates",
    sql=FOLD_SQL + f""", er AS (SELECT DISTINCT job_id FROM job_updates WHERE retry_count = 1),
m AS (SELECT st.*, er.job_id IS NOT NULL AND status IN ('queued', 'processing') AS broken FROM st LEFT JOIN er ON er.job_id = st.job_id)
SELECT job_id, CASE WHEN broken THEN 'failed' ELSE status END AS status, CASE WHEN broken THEN 'failed to upload source' ELSE error END AS error,
       CASE WHEN broken THEN {NOW_SQL} ELSE updated_at END AS updated_at, broken AS release_reservation FROM m""",
)
def intake_failures(t: Tables):
    updates = t("job_updates")
    errors = updates.filter(F.col("retry_count") == 1).select("job_id").distinct().withColumn("message", F.lit("failed to upload source"))
    return jobs.intake_failures(jobs.fold(updates), errors, now()).select("job_id", "status", "error", "updated_at", "release_reservation")


def classes_sql(column: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({column}), '{pattern}') THEN '{title}'" for title, pattern in text.ERROR_CLASSES)
    return f"CASE {whens} ELSE '{text.DEFAULT_ERROR_CLASS}' END"


@REG.query(
    sql=f"SELECT doc_id, {classes_sql('text')} AS error_class, NOT regexp_matches(lower(text), '{text.FINAL_ERRORS}') AS recoverable FROM documents",
)
def error_class_of_texts(t: Tables):
    return t("documents").select(
        "doc_id", text.error_class(F.col("text")).alias("error_class"), text.is_recoverable(F.col("text")).alias("recoverable")
    )


@REG.query(
    "job_updates",
    sql=FOLD_SQL + f"SELECT {classes_sql('error')} AS error_class, NOT regexp_matches(lower(error), '{text.FINAL_ERRORS}') AS recoverable, COUNT(*) AS jobs FROM st WHERE error IS NOT NULL GROUP BY 1, 2",
)
def error_class_counts(t: Tables):
    return jobs.error_classes(jobs.fold(t("job_updates")))


@REG.query(
    "job_updates",
    sql=FOLD_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id) AS rn, COUNT(*) OVER (PARTITION BY user_id) AS n FROM st)
SELECT user_id, job_id, CAST(rn AS INT) AS rn, n > 20 AS has_next FROM r WHERE rn <= 20""",
)
def job_page_per_user(t: Tables):
    return catalog.first_pages(jobs.fold(t("job_updates")), "job_id", catalog.JOB_PAGE).select("user_id", "job_id", "rn", "has_next")


@REG.query(
    "job_updates",
    sql=FOLD_SQL + "SELECT job_id, created_at FROM st WHERE user_id = 42 AND status = 'failed' ORDER BY created_at DESC, job_id LIMIT 20",
)
def list_failed_jobs(t: Tables):
    return jobs.list_jobs(jobs.fold(t("job_updates")), 42, "failed").select("job_id", "created_at")


@REG.query(
    "job_updates", "tile_sets",
    sql=FOLD_SQL + """
SELECT job_id, status FROM st WHERE status <> 'complete' OR NOT EXISTS (SELECT 1 FROM tile_sets t WHERE t.slug = concat('ts-', CAST(st.job_id AS VARCHAR)))""",
)
def unfinished_jobs(t: Tables):
    sets = t("tile_sets").withColumn("slug", F.substring("slug", 4, 40))
    return catalog.unfinished_jobs(jobs.fold(t("job_updates")), sets).select("job_id", "status")


@REG.query(
    "job_updates",
    sql=FOLD_SQL + """
SELECT e.event_id FROM (SELECT event_id, user_id, user_id * 6 + event_id % 6 AS job_id FROM events) e
WHERE EXISTS (SELECT 1 FROM st WHERE st.job_id = e.job_id AND st.user_id = e.user_id AND st.status = 'complete')""",
)
def completed_job_check(t: Tables):
    asked = t("events").select("event_id", "user_id", (F.col("user_id") * 6 + F.col("event_id") % 6).alias("job_id"))
    complete = jobs.fold(t("job_updates")).filter(F.col("status") == "complete")
    return asked.join(complete, ["job_id", "user_id"], "left_semi").select("event_id")


# --- messages -----------------------------------------------------------------------------------------------


@REG.query(
    "image_dims",
    sql="""
SELECT raster_id, raster_id % 6 <> 5 AS valid, CASE WHEN raster_id % 6 <> 5 THEN CAST(raster_id AS VARCHAR) END AS job_id, CASE WHEN raster_id % 6 <> 5 THEN tile_size END AS tile_size,
       CASE WHEN raster_id % 6 <> 5 THEN projection END AS projection FROM image_dims""",
)
def parse_job_messages(t: Tables):
    from ..sources.messages import parse_jobs

    body = F.to_json(F.struct(F.col("raster_id").cast("string").alias("job_id"), "tile_size", "projection", F.lit("x").alias("extra")))
    raw = t("image_dims").select("raster_id", F.when(F.col("raster_id") % 6 == 5, F.concat(F.lit("{broken "), body)).otherwise(body).alias("body"))
    return parse_jobs(raw).select("raster_id", "valid", "job.job_id", F.col("job.tile_size").cast("int").alias("tile_size"), "job.projection")


@REG.query(
    "image_dims",
    sql="""
SELECT raster_id, concat('{"job_id":"', CAST(raster_id AS VARCHAR), '","tile_size":', CAST(tile_size AS VARCHAR), CASE WHEN projection IS NULL THEN '' ELSE concat(',"projection":"', projection, '"') END, '}') AS body
FROM image_dims""",
)
def write_job_messages(t: Tables):
    from ..sources.messages import to_message

    jobs_in = t("image_dims").withColumn("job_id", F.col("raster_id").cast("string"))
    return to_message(jobs_in, ["job_id", "tile_size", "projection"]).select("raster_id", "body")


# --- request limits -------------------------------------------------------------------------------------------

IDENTITY_SQL = """
rq AS (SELECT r.*, CASE WHEN r.user_id IS NOT NULL THEN concat('user:', CAST(r.user_id AS VARCHAR))
              ELSE concat('ip:', COALESCE(trim(cf_ip), trim(string_split(forwarded_for, ',')[1]), peer_ip, 'unknown')) END AS identity,
              CASE WHEN r.user_id IS NOT NULL THEN COALESCE(u.plan, 'free') END AS plan FROM requests r LEFT JOIN users u ON u.user_id = r.user_id),
lm AS (SELECT *, CAST(CASE endpoint WHEN 'post_tiles' THEN CASE WHEN plan IS NULL THEN 5 WHEN plan = 'pro' THEN 60 ELSE 10 END
                          WHEN 'progress' THEN CASE WHEN plan IS NULL THEN 30 WHEN plan = 'pro' THEN 300 ELSE 60 END
                          WHEN 'download' THEN CASE WHEN plan IS NULL THEN 15 WHEN plan = 'pro' THEN 120 ELSE 30 END
                          ELSE CASE WHEN plan IS NULL THEN 10 WHEN plan = 'pro' THEN 120 ELSE 30 END END AS INT) AS lim,
              CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS win FROM rq),
vd AS (SELECT *, row_number() OVER (PARTITION BY identity, endpoint, win ORDER BY ts, event_id) AS rn FROM lm)"""


@REG.query(
    "requests", "users",
    sql=IDENTITY_SQL + """
SELECT event_id, identity, endpoint, win AS "window", lim AS "limit", rn <= lim AS allowed, CAST(greatest(0, lim - rn) AS INT) AS remaining, (win + 1) * 60 AS reset,
       CASE WHEN rn > lim THEN 60 - sec % 60 END AS retry_after FROM vd""",
)
def rate_limit_verdicts(t: Tables):
    return ratelimit.verdicts(t("requests"), t("users"))


@REG.query(
    "requests", "users",
    sql=IDENTITY_SQL + """
SELECT identity, endpoint, win AS "window", lim AS "limit", COUNT(*) AS requests, least(COUNT(*), lim) AS allowed, COUNT(*) - least(COUNT(*), lim) AS rejected FROM vd GROUP BY 1, 2, 3, 4""",
)
def rate_limit_counts(t: Tables):
    return ratelimit.window_counts(t("requests"), t("users"))


@REG.query(
    "requests", "users",
    sql=IDENTITY_SQL + """,
lt AS (SELECT identity, endpoint, arg_max(CAST(greatest(0, lim - rn) AS INT), event_id) AS remaining FROM vd GROUP BY 1, 2)
SELECT identity, arg_min(endpoint, struct_pack(a := remaining, b := endpoint)) AS endpoint, MIN(remaining) AS remaining, MIN(remaining) <= 3 AS approaching FROM lt GROUP BY 1""",
)
def lowest_allowance(t: Tables):
    return ratelimit.lowest_remaining(ratelimit.verdicts(t("requests"), t("users")))


@REG.query(
    "requests",
    sql="SELECT event_id, COALESCE(trim(cf_ip), trim(string_split(forwarded_for, ',')[1]), peer_ip, 'unknown') AS ip FROM requests",
)
def client_ip(t: Tables):
    return t("requests").select("event_id", text.client_ip(F.col("cf_ip"), F.col("forwarded_for"), F.col("peer_ip")).alias("ip"))
