"""Fixed-window request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.hotkeys import first_per_key, lookup

# Requests per window by endpoint for callers without account, free and pro users.
WINDOW_SECONDS = 60
LIMITS = {
    "post_tiles": (5, 10, 60),
    "progress": (30, 60, 300),
    "download": (15, 30, 120),
    "mutations": (10, 30, 120),
}
LARGEST_LIMIT = max(max(limits) for limits in LIMITS.values())
WARN_AT = 3


def limit_of(endpoint: Column, plan: Column) -> Column:
    """Limit of a request; twelve fixed numbers, so a CASE and not a join."""
    out = None
    for name, (anonymous, free, pro) in LIMITS.items():
        value = F.when(plan.isNull(), anonymous).when(plan == "pro", pro).otherwise(free)
        out = F.when(endpoint == name, value) if out is None else out.when(endpoint == name, value)
    return out


def with_window(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add identity, plan, limit and the window number to requests (user_id may be null).

    Anonymous requests do not meet in one task: a table uses the hot-key join, which spreads busy users too; a stream, which can't be
    counted, spreads its rows without a user by their id. A stream's busy user is one key here as in the counters that follow.
    """
    plans = users.select("user_id", "plan")
    if requests.isStreaming:
        spread = F.when(F.col("user_id").isNull(), F.xxhash64("event_id")).otherwise(F.lit(0).cast("long"))
        once = plans.withColumn("_spread", F.lit(0).cast("long"))
        known = requests.withColumn("_spread", spread).join(once, ["user_id", "_spread"], "left").drop("_spread")
    else:
        known = lookup(requests, plans, ["user_id"], ["event_id"])
    ip = text.client_ip(F.col("cf_ip"), F.col("forwarded_for"), F.col("peer_ip"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return (
        known.withColumn("plan", F.when(F.col("user_id").isNotNull(), F.coalesce("plan", F.lit("free"))))
        .withColumn(
            "identity",
            F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user:"), F.col("user_id").cast("string"))).otherwise(
                F.concat(F.lit("ip:"), ip)
            ),
        )
        .withColumn("limit", limit_of(F.col("endpoint"), F.col("plan")))
        .withColumn("seconds", seconds)
        .withColumn("window", F.floor(seconds / WINDOW_SECONDS))
    )


GROUP = ("identity", "endpoint", "window")


def verdicts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Every request with its verdict and the numbers of its reply.

    Only the first requests of a window, at most the largest limit, can pass, and finding those is a group limit
    that prunes before the shuffle. They are joined back by the unique event id, so a flood from one caller in
    one window stays spread over all tasks.
    """
    known = with_window(requests, users)
    ranked = first_per_key(
        known.select(*GROUP, "limit", "ts", "event_id"), GROUP, LARGEST_LIMIT, ["ts", "event_id"]
    ).filter(F.col("rn") <= F.col("limit"))
    met = known.join(ranked.select("event_id", "rn"), "event_id", "left")
    allowed = F.col("rn").isNotNull()
    return met.select(
        "event_id", *GROUP, "limit", allowed.alias("allowed"),
        F.coalesce(F.col("limit") - F.col("rn"), F.lit(0)).alias("remaining"),
        ((F.col("window") + 1) * WINDOW_SECONDS).alias("reset"),
        F.when(~allowed, WINDOW_SECONDS - F.col("seconds") % WINDOW_SECONDS).alias("retry_after"),
    )


def window_counts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests per window with allowed and rejected counts: one partial aggregate."""
    counts = with_window(requests, users).groupBy(*GROUP, "limit").agg(F.count("*").alias("requests"))
    return counts.withColumn("allowed", F.least(F.col("requests"), F.col("limit").cast("long"))).withColumn(
        "rejected", F.col("requests") - F.col("allowed")
    )


def lowest_remaining(replies: DataFrame) -> DataFrame:
    """Per identity the endpoint with the least allowance left in its latest reply, and whether to warn."""
    latest = replies.groupBy("identity", "endpoint").agg(F.max_by("remaining", F.col("event_id")).alias("remaining"))
    return latest.groupBy("identity").agg(
        F.min_by("endpoint", F.struct("remaining", "endpoint")).alias("endpoint"), F.min("remaining").alias("remaining")
    ).withColumn("approaching", F.col("remaining") <= WARN_AT)
