"""Storage accounting: used bytes, reservations under a quota, and their release."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hotkeys import attach, lookup, running_sum
from ..session import cut_lineage

# Quota and the size estimate of an upload.
QUOTA_BYTES = 5 * 1024**3
ESTIMATE_FACTOR = 2
CRITICAL_PERCENT = 90.0

# A user with more requests than this is brought down to it by steps that sort within pieces only.
WALKED = 1_000_000


def used(users: DataFrame, tile_sets: DataFrame) -> DataFrame:
    """Used bytes of every user, zero without tile sets."""
    sums = tile_sets.groupBy("user_id").agg(F.sum("size_bytes").alias("_used"))
    return users.select("user_id", "plan").join(sums, "user_id", "left").select(
        "user_id", "plan", F.coalesce("_used", F.lit(0).cast("long")).alias("used_bytes")
    )


def deltas(changes: DataFrame) -> DataFrame:
    """What a log of tile-set changes (op, user_id, old_bytes, new_bytes) adds to each user's bytes: ``user_id``, ``delta``."""
    signed = (
        F.when(F.col("op") == "insert", F.col("new_bytes"))
        .when(F.col("op") == "delete", -F.col("old_bytes"))
        .otherwise(F.col("new_bytes") - F.col("old_bytes"))
    )
    return changes.groupBy("user_id").agg(F.sum(signed).alias("delta"))


def apply_deltas(balance: DataFrame, delta: DataFrame) -> DataFrame:
    """Add one row of ``delta`` per user to the used bytes."""
    return balance.join(delta.withColumnRenamed("delta", "_delta"), "user_id", "left").withColumn(
        "used_bytes", F.col("used_bytes") + F.coalesce("_delta", F.lit(0).cast("long"))
    ).drop("_delta")


def apply_changes(balance: DataFrame, changes: DataFrame) -> DataFrame:
    """Add a log of tile-set changes to the used bytes."""
    return apply_deltas(balance, deltas(changes))


def storage_view(balance: DataFrame, quota: int = QUOTA_BYTES) -> DataFrame:
    """What a user sees: pro users their use and the quota, free users zeros; percent and a warning flag."""
    pro = F.col("plan") == "pro"
    zero = F.lit(0).cast("long")
    shown = balance.select(
        "user_id", F.when(pro, F.col("used_bytes")).otherwise(zero).alias("storage_used"),
        F.when(pro, F.lit(quota).cast("long")).otherwise(zero).alias("storage_quota"),
    )
    percent = F.when(
        F.col("storage_quota") > 0, F.least(F.lit(100.0), F.col("storage_used") * 100.0 / F.col("storage_quota"))
    ).otherwise(F.lit(0.0))
    return shown.withColumn("percent", percent).withColumn("critical", F.col("percent") >= CRITICAL_PERCENT)


def estimate(body_bytes: Column) -> Column:
    return (body_bytes * ESTIMATE_FACTOR).cast("long")


DECIDED = ("request_id", "user_id", "bytes")
ASKED = ("request_id", "user_id", "ts", "bytes")


def _round(pending: DataFrame, piece: Column) -> DataFrame:
    """One step of admission for all users at once: ``admitted`` of the rows it decides, and ``room`` lessened for the others.

    Requests larger than the room are refused, and users whose other requests fit together are admitted whole. Otherwise a request of at
    most half the room is small. While more than half is left every small request is admitted, and a large one is admitted where it fits
    beside the small ones before it. The step ends for a user with the request that uses up half of the room, which is found from running
    sums; so the room of a user with pending requests halves at least.
    """
    # A user that is not there reserves nothing.
    never = F.col("room").isNull() | (F.col("bytes") > F.col("room"))
    small = F.col("bytes") * 2 <= F.col("room")
    able = pending.filter(~never)
    summed = running_sum(able, ["user_id"], piece, ["ts", "request_id"], F.when(small, F.col("bytes")).otherwise(0), "_sum")
    order = F.struct("ts", "request_id")
    ends = F.when(small, F.col("_sum") * 2 > F.col("room")).otherwise(F.col("_sum") + F.col("bytes") <= F.col("room"))
    taken = F.col("_sum") + F.when(small, 0).otherwise(F.col("bytes"))
    of_user = summed.groupBy("user_id").agg(
        F.min(F.when(ends, F.struct("ts", "request_id", taken.alias("taken")))).alias("_end"), F.sum("bytes").alias("_total"), F.count("*").alias("_n")
    )
    met = attach(summed, of_user, ["user_id"], ["request_id"])
    end = F.struct("_end.ts", "_end.request_id")
    whole = F.col("_total") <= F.col("room")
    waits = ~whole & F.col("_end").isNotNull() & (order > end)
    admitted = F.when(whole | small, True).otherwise(F.col("_end").isNotNull() & (order == end))
    judged = met.select(
        *ASKED, F.when(waits, F.col("room") - F.col("_end.taken")).alias("room"), F.when(~waits, admitted).alias("admitted")
    )
    refused = pending.filter(never).select(*ASKED, "room", F.lit(False).alias("admitted"))
    return cut_lineage(judged.unionByName(refused))


def _take(sizes: list[int], room: int) -> tuple[list[bool], int]:
    """Which of a user's requests fit, one after the other, and the room they leave."""
    taken = []
    for size in sizes:
        fits = size <= room
        if fits:
            room -= size
        taken.append(fits)
    return taken, room


def _walk(requests: DataFrame, room: DataFrame) -> DataFrame:
    """Admission in one shuffle: a user's room and then its requests pass by in order, and only the room is remembered."""
    rows = requests.withColumn("room", F.lit(None).cast("long"))
    heads = room.filter("room IS NOT NULL").select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c != "user_id" else F.col(c) for c in ASKED], "room")
    both = heads.unionByName(rows).withColumn("size", F.coalesce("bytes", F.lit((1 << 63) - 1)))
    # Dealt by a hash of the user: a union of two sides that are dealt by the user already would be left as it is, and its partitions,
    # once Spark has merged small ones on either side, need not match.
    dealt = both.repartition(F.xxhash64("user_id")).sortWithinPartitions("user_id", F.col("room").isNull(), "ts", "request_id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, left = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            users = batch.column("user_id").to_numpy(zero_copy_only=False)
            rooms, sizes = batch.column("room").to_pylist(), batch.column("size").to_numpy()
            borders = np.flatnonzero(users[1:] != users[:-1]) + 1
            admitted: list[bool] = []
            for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(users)]):
                if user is None or users[a] != user:
                    user, left = users[a], None
                while a < b and rooms[a] is not None:  # the head of a user
                    left = rooms[a]
                    admitted.append(False)
                    a += 1
                if left is None:
                    admitted += [False] * (b - a)
                elif a < b:
                    taken, left = _take(sizes[a:b].tolist(), left)
                    admitted += taken
            shown = pa.RecordBatch.from_arrays([*[batch.column(c) for c in DECIDED], pa.array(admitted, pa.bool_())], [*DECIDED, "admitted"])
            yield shown.filter(batch.column("room").is_null())

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in DECIDED)
    return dealt.mapInArrow(step, f"{kinds}, admitted boolean")


def admit(requests: DataFrame, balance: DataFrame, quota: int = QUOTA_BYTES, piece: Column | None = None, walked: int = WALKED) -> DataFrame:
    """Reserve storage in (ts, request_id) order: each admitted request leaves less room for the next.

    ``requests`` has request_id, user_id, ts, bytes; ``balance`` used_bytes and, optionally, reserved_bytes. All users are settled in one
    pass, but for those with more than ``walked`` requests. These go in steps, each of which halves the room of the users it leaves
    undecided, until so few of their requests are undecided that the pass takes them too; ``piece`` cuts their requests into pieces in
    time order (by minute of ``ts`` unless given), so that no task sorts such a user. A request without a user or a size is refused.
    """
    reserved = F.col("reserved_bytes") if "reserved_bytes" in balance.columns else F.lit(0)
    room = balance.select("user_id", (F.lit(quota) - F.col("used_bytes") - reserved).cast("long").alias("room"))
    asked = requests.select("request_id", "user_id", "ts", F.col("bytes").cast("long").alias("bytes"))
    refused = F.col("user_id").isNull() | F.col("bytes").isNull()
    nobody = asked.filter(refused).select(*DECIDED, F.lit(False).alias("admitted"))
    asked = asked.filter(~refused)

    def busy_of(pending: DataFrame) -> DataFrame:
        return pending.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > walked).select("user_id")

    busy = busy_of(asked)
    if busy.isEmpty():
        return _walk(asked, room).unionByName(nobody)
    busy = cut_lineage(busy)
    out = _walk(asked.join(busy, "user_id", "left_anti"), room.join(busy, "user_id", "left_anti")).unionByName(nobody)
    pending = lookup(asked.join(busy, "user_id", "left_semi"), room, ["user_id"], ["request_id"])
    if piece is None:
        piece = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    while True:
        judged = _round(pending, piece)
        out = out.unionByName(judged.filter("admitted IS NOT NULL").select(*DECIDED, "admitted"))
        pending = judged.filter("admitted IS NULL").drop("admitted")
        if busy_of(pending).isEmpty():
            left = pending.groupBy("user_id").agg(F.max("room").alias("room"))
            return out.unionByName(_walk(pending.select(*ASKED), left))


def release(balance: DataFrame, jobs: DataFrame) -> DataFrame:
    """Give back the reservation of each finished job once; a user's reserved bytes never fall below zero.

    ``jobs`` may repeat a job (job_id, user_id, reserved_bytes, reservation_released).
    """
    once = jobs.filter(~F.col("reservation_released")).groupBy("job_id").agg(
        F.min("user_id").alias("user_id"), F.max(F.coalesce("reserved_bytes", F.lit(0))).alias("_bytes")
    )
    per_user = once.filter(F.col("user_id").isNotNull() & (F.col("_bytes") > 0)).groupBy("user_id").agg(
        F.sum("_bytes").alias("_bytes")
    )
    return balance.join(per_user, "user_id", "left").withColumn(
        "reserved_bytes",
        F.greatest(F.lit(0).cast("long"), F.col("reserved_bytes") - F.coalesce("_bytes", F.lit(0).cast("long"))),
    ).drop("_bytes")


def reference_counts(tile_sets: DataFrame) -> DataFrame:
    """How many tile sets refer to each storage path, and their bytes."""
    return tile_sets.groupBy("storage_path").agg(F.count("*").alias("n_refs"), F.sum("size_bytes").alias("bytes"))
