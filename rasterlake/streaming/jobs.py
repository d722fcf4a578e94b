"""Job life cycle on streams of updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import jobs
from ..sources.messages import split_jobs
from .buckets import BUCKETS, fold_keys

LATENESS = "10 minutes"
IDLE_MILLIS = 60_000
UNKNOWN = np.iinfo(np.int64).min
STATE = "status string, progress int, tiles_done bigint, updated_ms bigint, applied bigint, ignored bigint"
OUTPUT = "job_id bigint, " + STATE


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _newest_row(batches: Iterator[pd.DataFrame], *columns: str) -> tuple:
    """(microseconds, event id, *columns) of the last row in (ts, event_id) order; one row is remembered from piece to piece."""
    best = None
    for pdf in batches:
        times, events = _micros(pdf["ts"]), pdf["event_id"].to_numpy()
        at = np.lexsort((events, times))[-1]
        found = int(times[at]), int(events[at])
        if best is None or found > best[:2]:
            best = (*found, *[pdf[c].iat[at] for c in columns])
    return best


def _forget_at(state: GroupState, millis: int) -> None:
    """Time out when the watermark passes the given event time; it must lie ahead of the watermark."""
    state.setTimeoutTimestamp(max(millis, state.getCurrentWatermarkMs() + 1))


class _OpenRows:
    """What has to be known of the updates of an open job to apply them in order, though they come in pieces in any order.

    The first closing row and the newest row are single rows. How many rows come before the closing one, and the last known number of
    tiles there, are not known until all pieces have come, so times, ids and tiles are kept as plain numbers (24 bytes a row), and
    only of rows before the first closing row that is known so far.
    """

    def __init__(self) -> None:
        self.total, self.close, self.last = 0, None, None
        self.rows: list[np.ndarray] = []

    def add(self, pdf: pd.DataFrame) -> None:
        times, events = _micros(pdf["ts"]), pdf["event_id"].to_numpy(np.int64)
        order = np.lexsort((events, times))
        ends = order[~pdf["status"].isin(jobs.OPEN).to_numpy()[order]]
        self.total += len(pdf)
        row = lambda i: (int(times[i]), int(events[i]), pdf["status"].iat[i], int(pdf["progress"].iat[i]))
        newest = row(order[-1])
        self.last = newest if self.last is None or newest[:2] > self.last[:2] else self.last
        if len(ends) and (self.close is None or row(ends[0])[:2] < self.close[:2]):
            self.close = row(ends[0])
            self.rows = [self._before(r) for r in self.rows]
        known = pdf["tiles_done"].notna().to_numpy()
        tiles = np.where(known, pdf["tiles_done"].fillna(0).to_numpy(np.int64), UNKNOWN)
        self.rows.append(self._before(np.stack((times, events, tiles))))

    def _before(self, rows: np.ndarray) -> np.ndarray:
        if self.close is None:
            return rows
        at, event = self.close[:2]
        return rows[:, (rows[0] < at) | ((rows[0] == at) & (rows[1] <= event))]

    def result(self) -> tuple[tuple, int, int | None]:
        """The row that gives the state, how many rows count, and the last known number of tiles."""
        counted = sum(r.shape[1] for r in self.rows)
        newest = None
        for times, events, tiles in self.rows:
            known = np.flatnonzero(tiles != UNKNOWN)
            if len(known):
                at = known[np.lexsort((events[known], times[known]))[-1]]
                found = int(times[at]), int(events[at]), int(tiles[at])
                newest = found if newest is None or found > newest else newest
        return self.close or self.last, counted, newest[2] if newest else None


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Apply updates while the job is open; afterwards only count them. A job without updates for the retention time is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    status, progress, done, updated, applied, ignored = state.get if state.exists else (None, None, None, None, 0, 0)
    if status is not None and status not in jobs.OPEN:
        ignored += sum(map(len, batches))
    else:
        rows = _OpenRows()
        for pdf in batches:
            rows.add(pdf)
        (micros, _, status, share), counted, tiles = rows.result()
        progress, updated = min(100, max(0, share)), micros // 1000
        done = done if tiles is None else tiles
        applied += counted
        ignored += rows.total - counted
    state.update((status, progress, done, updated, applied, ignored))
    _forget_at(state, updated + jobs.JOB_RETENTION_HOURS * 3_600_000)
    yield pd.DataFrame(
        {"job_id": [key[0]], "status": [status], "progress": [progress], "tiles_done": pd.array([done], "Int64"),
         "updated_ms": [updated], "applied": [applied], "ignored": [ignored]}
    )


def states(updates: DataFrame, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """State of each job after every micro-batch in which it had updates (update mode)."""
    rows = updates.withWatermark("ts", lateness).select("job_id", "event_id", "ts", "status", "progress", "tiles_done")
    return fold_keys(rows, "job_id", _advance, OUTPUT, STATE, "update", buckets)


def _watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Remember the newest update; when the watermark is past its deadline a processing job has failed, and any job is forgotten.

    Rows older than the watermark never arrive, so a job that ended can't seem to be processing again.
    """
    if state.hasTimedOut:
        status, seen, _ = state.get
        state.remove()
        if status == "processing":
            yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "error": [jobs.STALE_ERROR], "seen_ms": [seen]})
        return
    status, seen, event = state.get if state.exists else (None, -1, -1)
    micros, newest, last = _newest_row(batches, "status")
    if (micros // 1000, newest) > (seen, event):
        status, seen, event = last, micros // 1000, newest
    state.update((status, seen, event))
    _forget_at(state, seen + jobs.STALE_SECONDS * 1000)


def stale(updates: DataFrame, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Jobs that went quiet while processing, reported once the event-time clock has passed their deadline."""
    rows = updates.withWatermark("ts", lateness).select("job_id", "event_id", "ts", "status")
    return fold_keys(
        rows, "job_id", _watch, "job_id bigint, status string, error string, seen_ms bigint", "status string, seen_ms bigint, event_id bigint",
        "append", buckets,
    )


def _newest(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest record of a job, forgotten when no other comes within the time progress is kept."""
    if state.hasTimedOut:
        state.remove()
        return
    micros, event, status, tiles = _newest_row(batches, "status", "tiles_done")
    seen = state.get if state.exists else None
    if seen is None or (micros, event) > (seen[2], seen[3]):
        seen = (status, None if pd.isna(tiles) else int(tiles), micros, event)
    state.update(seen)
    _forget_at(state, seen[2] // 1000 + jobs.PROGRESS_TTL_SECONDS * 1000)
    yield pd.DataFrame({
        "job_id": [key[0]], "status": [seen[0]], "tiles_done": pd.array([seen[1]], "Int64"), "ts_micros": [seen[2]],
    })


def latest_progress(updates: DataFrame, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Latest record per job (update mode). As in the table form a record expires after an hour."""
    rows = updates.withWatermark("ts", lateness).select("job_id", "event_id", "ts", "status", "tiles_done")
    newest = fold_keys(
        rows, "job_id", _newest, "job_id bigint, status string, tiles_done bigint, ts_micros bigint",
        "status string, tiles_done bigint, ts_micros bigint, event_id bigint", "update", buckets,
    )
    return newest.select("job_id", "status", "tiles_done", F.timestamp_micros("ts_micros").alias("ts"))


def first_intake(intake: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First row per (user, idempotency key) within the watermark; rows without a key all pass.

    Rows without a key get their own id as key, so that one stateful operator serves both.
    """
    key = F.coalesce(F.concat(F.lit("k:"), "idempotency_key"), F.concat(F.lit("row:"), F.col("event_id").cast("string")))
    return (
        intake.withColumn("_key", key)
        .withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["user_id", "_key"])
        .drop("_key")
    )


def _thin(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pass on a record when enough time has gone by since the last one passed on, and the last of all when no other comes."""
    last, held_at, held_id = state.get if state.exists else (None, None, None)
    if state.hasTimedOut:
        state.remove()
        if held_at is not None:
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [held_id], "at_millis": [held_at]})
        return
    step, pieces = 1, []
    for pdf in batches:  # 16 bytes a row are kept; of rows of one time, the first and the last
        step = int(pdf["step"].iat[0])
        times = pdf.groupby("at_millis")["event_id"].agg(["min", "max"])
        pieces += [np.stack((times.index.to_numpy(np.int64), times[c].to_numpy(np.int64))) for c in ("min", "max")]
    at, events = np.unique(np.concatenate(pieces, axis=1), axis=1)
    kept, place = [], 0
    while place < len(at):  # one step for each record that is passed on
        place = place if last is None else max(place, int(np.searchsorted(at, last + step)))
        if place == len(at):
            break
        last = int(at[place])
        kept.append(place)
        place += 1
    if not kept or kept[-1] != len(at) - 1:
        if held_at is None or at[-1] >= held_at:
            held_at, held_id = int(at[-1]), int(events[-1])
    elif held_at is None or last >= held_at:
        held_at = held_id = None
    state.update((last, held_at, held_id))
    _forget_at(state, int(at[-1]) + IDLE_MILLIS)
    yield pd.DataFrame({"job_id": key[0], "event_id": events[kept], "at_millis": at[kept]})


def throttle(ticks: DataFrame, millis: int = jobs.TICK_MILLIS, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Progress records with at least ``millis`` between them, per job, and the last one once the job has been idle for a while."""
    timed = ticks.withWatermark("ts", lateness).select(
        "job_id", "event_id", "ts", F.unix_millis("ts").alias("at_millis"), F.lit(millis).cast("long").alias("step")
    )
    return fold_keys(
        timed, "job_id", _thin, "job_id bigint, event_id bigint, at_millis bigint", "last bigint, held_at bigint, held_id bigint", "append", buckets
    )


def intake_messages(raw: DataFrame, folder: str):
    """Split job messages into readable jobs and dead letters, both written from one pass over each batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        good, bad = split_jobs(kept)
        good.select(*[c for c in batch.columns if c != "body"], "job.job_id").write.mode("overwrite").parquet(
            f"{folder}/jobs/batch_id={batch_id}"
        )
        bad.write.mode("overwrite").parquet(f"{folder}/dead/batch_id={batch_id}")
        kept.unpersist()

    return (
        raw.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    )
