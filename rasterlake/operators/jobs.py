"""Job life cycle on tables of updates, commands and progress records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.hotkeys import attach, first_per_key, lookup, previous_value, running_sum
from ..plans.thinning import thin
from ..session import cut_lineage
from . import catalog, storage

# States, times and retry delays.
STATUSES = ("queued", "processing", "complete", "failed", "cancelled")
OPEN = ("queued", "processing")
STALE_SECONDS = 300
STALE_ERROR = "worker stopped updating this job"
TIMED_OUT_ERROR = "job timed out (worker may have crashed)"
MAX_DELIVERIES = 5
RETRY_DELAYS = (30, 120, 300, 600)
PROGRESS_TTL_SECONDS = 3600
JOB_RETENTION_HOURS = 24
DEAD_LETTER_DAYS = 7
TICK_MILLIS = 250
TICK_SHARE = 200
LARGE_BYTES = 256 * 1024 * 1024

ORDER = ("ts", "event_id")


def is_open(status: Column) -> Column:
    return status.isin(*OPEN)


def clamp_progress(progress: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), progress))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, at most 99 until the job is complete, zero for an empty total."""
    share = F.call_function("div", done.cast("long") * 100, F.nullif(total.cast("long"), F.lit(0).cast("long")))
    return F.least(F.lit(99), F.coalesce(share, F.lit(0).cast("long"))).cast("int")


def _runs(updates: DataFrame, retries: DataFrame) -> DataFrame:
    """Add ``_run``: how many accepted retries of its job came before an update."""
    marks = retries.select("job_id", *ORDER, F.lit(1).alias("_mark"))
    both = updates.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    piece = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return running_sum(both, ["job_id"], piece, list(ORDER), F.col("_mark"), "_run").filter(F.col("_mark") == 0).drop("_mark")


def fold(updates: DataFrame, retries: DataFrame | None = None) -> DataFrame:
    """Final state of every job. Updates count only up to the first one that leaves the open states.

    An accepted retry (job_id, ts, event_id) opens its job again: the state is that of the last run, and queued when that has no update
    yet. Two partial aggregates: the first finds the closing update of each run, the second takes latest values up to it. In between, the
    closing point is attached in a way that keeps a very busy job spread over many tasks.
    """
    order = F.struct(*ORDER)
    if retries is not None:
        again = retries.groupBy("job_id").agg(F.count("*").alias("_retries"), F.max("ts").alias("_retried_at"))
        found = _fold_runs(_runs(updates, retries), order).join(again, "job_id", "left")
        waiting = F.coalesce(F.col("_retries") > F.col("_last_run"), F.lit(False))
        reset = {
            "status": F.when(waiting, "queued").otherwise(F.col("status")), "progress": F.when(waiting, 0).otherwise(F.col("progress")),
            "error": F.when(~waiting, F.col("error")), "completed_at": F.when(~waiting, F.col("completed_at")),
            "updated_at": F.when(waiting, F.greatest("updated_at", "_retried_at")).otherwise(F.col("updated_at")),
        }
        return found.withColumns(reset).drop("_retries", "_retried_at", "_last_run")
    return _fold_runs(updates.withColumn("_run", F.lit(0)), order).drop("_last_run")


def _fold_runs(updates: DataFrame, order: Column) -> DataFrame:
    keys = ["job_id", "_run"]
    closing = updates.groupBy(*keys).agg(F.min(F.when(~is_open(F.col("status")), order)).alias("_close"), F.count("*").alias("_n"))
    rows = attach(updates, closing, keys, ["event_id"])
    last = updates.groupBy("job_id").agg(F.max("_run").alias("_last_run"), F.count("*").alias("_n"))
    rows = attach(rows, last, ["job_id"], ["event_id"])
    applied = F.col("_close").isNull() | (order <= F.col("_close"))

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(applied, order))

    def latest_known(name: str) -> Column:
        return F.max_by(name, F.when(applied & F.col(name).isNotNull(), order))

    return rows.groupBy("job_id").agg(
        F.min_by("user_id", order).alias("user_id"),
        latest("status").alias("status"),
        clamp_progress(latest("progress")).alias("progress"),
        latest_known("tiles_done").alias("tiles_done"),
        latest_known("tiles_total").alias("tiles_total"),
        latest("error").alias("error"),
        F.coalesce(latest_known("retry_count"), F.lit(0)).alias("retry_count"),
        F.min("ts").alias("created_at"),
        F.max(F.when(applied, F.col("ts"))).alias("updated_at"),
        F.max(F.when(applied & (F.col("status") == "complete") & (F.col("_run") == F.col("_last_run")), F.col("ts"))).alias("completed_at"),
        F.max("_last_run").alias("_last_run"),
        F.count_if(applied).alias("applied"),
        F.count_if(~applied).alias("ignored"),
    )


def should_stop(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~is_open(F.col("status")))


def apply_commands(jobs: DataFrame, commands: DataFrame, uploads: DataFrame, room: DataFrame, as_of: Column) -> DataFrame:
    """Verdict of every cancel and retry command (command_id, job_id, user_id, command), as if they came in order of their ids.

    A command of somebody else finds nothing. The first cancel of an open job cancels it. The first retry of a failed job whose source is
    stored asks for its reservation, in command order with the user's other retries; if it fits the job is queued, and the first cancel
    after that cancels it. A command that is turned away changes nothing and blocks nobody. A retry that does not fit never fits later.
    ``uploads`` lists the jobs whose source is still stored; ``room`` the bytes each user has left; what cancels give back counts from
    the next call on. A job without a reservation needs no room.
    """
    stored = uploads.select("job_id").distinct().withColumn("_stored", F.lit(True))
    mine = jobs.select("job_id", F.col("user_id").alias("_owner"), "status", "reserved_bytes").join(stored, "job_id", "left")
    met = cut_lineage(
        lookup(commands, mine, ["job_id"], ["command_id"]).withColumn("_owned", F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False)))
    )
    cancel, retry = F.col("command") == "cancel", F.col("command") == "retry"
    failed = F.col("status") == "failed"
    owned = met.filter("_owned")

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("command_id")))

    facts = owned.groupBy("job_id").agg(
        F.min("user_id").alias("user_id"), F.min("reserved_bytes").alias("_bytes"), F.min("status").alias("_status"),
        first(cancel & is_open(F.col("status"))).alias("_cancel"), first(retry & failed & F.col("_stored")).alias("_retry"), F.count("*").alias("_n"),
    )
    # The order of ids stands for the time; a piece holds a thousand of them.
    asked = facts.filter("_retry IS NOT NULL AND _bytes IS NOT NULL").select(
        F.col("_retry").alias("request_id"), "user_id", F.col("_retry").alias("ts"), F.col("_bytes").alias("bytes")
    )
    limit = (1 << 62) - 1
    balance = room.select("user_id", (F.lit(limit) - F.col("room")).alias("used_bytes"))
    fits = storage.admit(asked, balance, limit, F.floor(F.col("ts") / 1000)).select(F.col("request_id").alias("_retry"), F.col("admitted").alias("_fits"))
    queued = F.col("_retry").isNotNull() & (F.col("_bytes").isNull() | F.coalesce("_fits", F.lit(False)))
    known = facts.join(fits, "_retry", "left").select("job_id", "_n", "_cancel", "_retry", queued.alias("_queued"))
    rows = attach(met, cut_lineage(known), ["job_id"], ["command_id"])
    again = rows.filter("_owned").groupBy("job_id").agg(
        first(cancel & F.col("_queued") & (F.col("command_id") > F.col("_retry"))).alias("_undo"), F.count("*").alias("_n")
    )
    rows = attach(rows, again, ["job_id"], ["command_id"])
    this = F.col("command_id")
    undo = F.col("_undo")
    # What the command finds: a queued job once its retry has gone through, and a cancelled one after the cancel that did it.
    cancelled_at = F.coalesce(F.col("_cancel"), undo)
    verdict = (
        F.when(~F.col("_owned"), "not_found")
        .when(cancel & (this == cancelled_at), "cancelled")
        .when(cancel | ~failed, "conflict")
        .when(F.col("_stored").isNull(), "source_gone")
        .when(~F.col("_queued"), "quota_exceeded")
        .when(this == F.col("_retry"), "queued")
        .otherwise("conflict")
    )
    found = (
        F.when(this >= cancelled_at, "cancelled").when(F.col("_queued") & (this >= F.col("_retry")), "queued").otherwise(F.col("status"))
    )
    changed = rows.withColumn("verdict", verdict)
    done = F.col("verdict").isin("cancelled", "queued")
    return changed.select(
        "command_id", "job_id", "verdict",
        F.when(F.col("_owned"), found).alias("status"),
        F.when(done, as_of).alias("updated_at"),
        F.when(F.col("verdict") == "cancelled", as_of).alias("cancelled_at"),
        F.when(F.col("verdict") == "cancelled", True).when(F.col("verdict") == "queued", False).alias("reservation_released"),
    )


def list_jobs(
    jobs: DataFrame, user_id: int, status: str | None = None, page: int | None = None, per_page: int | None = None
) -> DataFrame:
    """One page of a user's jobs, newest first; a status that is not one of the five is an error."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    mine = jobs.filter(F.col("user_id") == user_id)
    shown = mine if status is None else mine.filter(F.col("status") == status)
    return catalog.newest_first(shown, "job_id", *catalog.page_window(page, per_page, catalog.JOB_PAGE))


def reap(jobs: DataFrame, as_of: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Processing jobs without an update for too long become failed and give back their reservation."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {seconds} SECONDS"))
    reaped = F.col("reaped")
    return (
        jobs.withColumn("reaped", F.coalesce(stale, F.lit(False)))
        .withColumn("status", F.when(reaped, "failed").otherwise(F.col("status")))
        .withColumn("error", F.when(reaped, STALE_ERROR).otherwise(F.col("error")))
        .withColumn("updated_at", F.when(reaped, as_of).otherwise(F.col("updated_at")))
    )


def latest_progress(progress: DataFrame, as_of: Column, ttl_seconds: int = PROGRESS_TTL_SECONDS) -> DataFrame:
    """Latest record per job that has not expired."""
    values = [c for c in progress.columns if c not in ("job_id", "event_id")]
    newest = progress.groupBy("job_id").agg(F.max_by(F.struct(*values), F.struct(*ORDER)).alias("_r"))
    live = newest.select("job_id", "_r.*")
    return live.filter(F.col("ts") > as_of - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def progress_view(wanted: DataFrame, latest: DataFrame, as_of: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """What a watcher sees: the record without its owner, failed when stale, unknown when there is none."""
    ended = F.col("status").isin("complete", "failed")
    age = F.unix_seconds(as_of) - F.unix_seconds(F.col("ts"))
    stale = ~ended & (age > seconds) & (F.unix_seconds(F.col("ts")) > 0)
    met = wanted.select("job_id").join(latest.drop("user_id"), "job_id", "left")
    status = F.when(F.col("ts").isNull(), "unknown").when(stale, "failed").otherwise(F.col("status"))
    return met.select(
        "job_id", status.alias("status"),
        F.when(stale, TIMED_OUT_ERROR).otherwise(F.col("error")).alias("error"),
        F.when(~stale, F.col("tiles_done")).alias("tiles_done"),
        F.coalesce(ended | stale, F.lit(False)).alias("ends"),
    )


def attempts(failures: DataFrame, message: str = "job_id", first_is_final: bool = False) -> DataFrame:
    """Delivery attempts that ended in failure, numbered per message up to the last one allowed, with what follows each.

    A job that is retried gets a new message, whose count starts again; name its column in ``message``. A message is gone after its final
    attempt (the first one on the fallback queue, which does not deliver again), so later rows of a message can't happen and are left
    out; the number filter prunes before the shuffle.
    """
    allowed = 1 if first_is_final else MAX_DELIVERIES
    numbered = first_per_key(failures, [message], allowed, list(ORDER), out="attempt")
    final = F.col("attempt") >= allowed
    delay = F.element_at(F.array(*[F.lit(d) for d in RETRY_DELAYS]), F.least(F.col("attempt"), F.lit(len(RETRY_DELAYS))))
    return (
        numbered.withColumn("next_status", F.when(final, "failed").otherwise("queued"))
        .withColumn("delay_seconds", F.when(~final, delay))
        .withColumn("release_reservation", final)
    )


def dead_letters(failures: DataFrame, as_of: Column, days: int = DEAD_LETTER_DAYS, message: str = "job_id") -> DataFrame:
    """Messages given up after the last attempt, kept for seven days."""
    kept = F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS")
    return attempts(failures, message).filter((F.col("attempt") >= MAX_DELIVERIES) & kept)


def queued_messages(messages: DataFrame, as_of: Column, hours: int = JOB_RETENTION_HOURS) -> DataFrame:
    return messages.filter(F.col("ts") > as_of - F.expr(f"INTERVAL {hours} HOURS"))


def dedupe(intake: DataFrame) -> DataFrame:
    """First (user, idempotency key) wins: every row gets the id of the job that really runs.

    Rows without a key never collide.
    """
    keys = ["user_id", "idempotency_key"]
    winners = intake.filter(F.col("idempotency_key").isNotNull()).groupBy(*keys).agg(
        F.min_by("event_id", F.struct(*ORDER)).alias("_winner"), F.count("*").alias("_n")
    )
    met = attach(intake, winners, keys, ["event_id"])
    run_as = F.coalesce("_winner", "event_id")
    return met.select(
        "event_id", *keys, run_as.alias("runs_as"), (run_as != F.col("event_id")).alias("duplicate"),
    )


def route(intake: DataFrame) -> DataFrame:
    """Pro or large uploads are queued, the rest is processed at once."""
    queued = (F.col("plan") == "pro") | (F.col("decoded_bytes") > LARGE_BYTES)
    return intake.withColumn("route", F.when(queued, "queued").otherwise("immediate"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def batch_cancel(items: DataFrame) -> DataFrame:
    """Items in progress go back to queued without progress; finished ones stay."""
    running = F.col("status") == "processing"
    return items.withColumn("progress", F.when(~running, F.col("progress"))).withColumn(
        "status", F.when(running, "queued").otherwise(F.col("status"))
    )


def batch_summary(items: DataFrame, by: str) -> DataFrame:
    done = F.count_if(F.col("status") == "complete")
    failed = F.count_if(F.col("status") == "failed")
    return (
        items.groupBy(by)
        .agg(done.alias("succeeded"), failed.alias("failed"))
        .filter((F.col("succeeded") > 0) | (F.col("failed") > 0))
        .withColumn("type", F.when(F.col("succeeded") > 0, "processing_complete").otherwise("processing_failed"))
        .withColumn(
            "message",
            F.concat(F.col("succeeded").cast("string"), F.lit(" succeeded, "), F.col("failed").cast("string"), F.lit(" failed")),
        )
    )


def intake_failures(jobs: DataFrame, errors: DataFrame, as_of: Column) -> DataFrame:
    """Jobs whose upload or publication failed: failed with the message, reservation given back."""
    met = jobs.join(errors.select("job_id", F.col("message").alias("_message")), "job_id", "left")
    broken = F.col("_message").isNotNull() & is_open(F.col("status"))
    return (
        met.withColumn("error", F.when(broken, F.col("_message")).otherwise(F.col("error")))
        .withColumn("updated_at", F.when(broken, as_of).otherwise(F.col("updated_at")))
        .withColumn("release_reservation", broken)
        .withColumn("status", F.when(broken, "failed").otherwise(F.col("status")))
        .drop("_message")
    )


def error_classes(jobs: DataFrame) -> DataFrame:
    failed = jobs.filter(F.col("error").isNotNull())
    return failed.groupBy(
        text.error_class(F.col("error")).alias("error_class"), text.is_recoverable(F.col("error")).alias("recoverable")
    ).agg(F.count("*").alias("jobs"))


def throttle(ticks: DataFrame, millis: int = TICK_MILLIS) -> DataFrame:
    """Progress records worth passing on: first, last, and each one at least ``millis`` after the one before."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    timed = ticks.select("job_id", "event_id", at.alias("at_millis"), F.lit(millis).alias("_step"))
    kept = thin(timed, ["job_id"], "at_millis", "_step")
    firsts = timed.groupBy("job_id", "at_millis").agg(F.min("event_id").alias("event_id"))
    ends = timed.groupBy("job_id").agg(
        F.max(F.struct("at_millis", "event_id")).alias("_end")
    ).select("job_id", F.col("_end.at_millis").alias("at_millis"), F.col("_end.event_id").alias("event_id"))
    return firsts.join(kept, ["job_id", "at_millis"], "left_semi").unionByName(ends, allowMissingColumns=True).distinct()


def throttle_by_tiles(ticks: DataFrame, tiles_total: int) -> DataFrame:
    """Records to pass on by tile count: the last tile, every change of zoom, and each further 1/200 of the tiles."""
    step = max(1, tiles_total // TICK_SHARE)
    piece = F.floor(F.col("tiles_done") / 1024)
    once = ticks.groupBy("job_id", "tiles_done").agg(F.min("zoom").alias("zoom"))
    marked = previous_value(once, ["job_id"], piece, ["tiles_done"], "zoom", "_before")
    change = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("zoom")), 1).otherwise(0)
    runs = running_sum(marked, ["job_id"], piece, ["tiles_done"], change, "_run").withColumn("_step", F.lit(step))
    kept = thin(runs, ["job_id", "_run"], "tiles_done", "_step").select("job_id", "tiles_done")
    last = once.filter(F.col("tiles_done") == tiles_total).select("job_id", "tiles_done")
    return kept.unionByName(last).distinct()
