"""Request limits on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ratelimit

LATENESS = "10 minutes"
GROUP = ["identity", "endpoint", "window"]


def window_counts(requests: DataFrame, users: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Requests per minute window with a watermark; later rows than that are dropped and counted by Spark."""
    known = ratelimit.with_window(requests.withWatermark("ts", lateness), users)
    counts = known.groupBy(
        "identity", "endpoint", F.window("ts", f"{ratelimit.WINDOW_SECONDS} seconds").alias("span"), "limit"
    ).agg(F.count("*").alias("requests"))
    number = F.floor(F.unix_seconds(F.col("span.start")) / ratelimit.WINDOW_SECONDS)
    allowed = F.least(F.col("requests"), F.col("limit").cast("long"))
    return counts.select(
        "identity", "endpoint", number.alias("window"), "limit", "requests", allowed.alias("allowed"),
        (F.col("requests") - allowed).alias("rejected"),
    )


VERDICT = "event_id bigint, identity string, endpoint string, window bigint, allowed boolean, remaining int"


def _decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count in order of arrival; the state is one number per open window."""
    if state.hasTimedOut:
        state.remove()
        return
    seen = state.get[0] if state.exists else 0
    for pdf in batches:
        rank = seen + 1 + pd.Series(range(len(pdf)), index=pdf.index)
        seen += len(pdf)
        yield pd.DataFrame(
            {
                "event_id": pdf["event_id"], "identity": key[0], "endpoint": key[1], "window": key[2],
                "allowed": rank <= pdf["limit"], "remaining": (pdf["limit"] - rank).clip(lower=0).astype("int32"),
            }
        )
    state.update((seen,))
    end = (int(key[2]) + 1) * ratelimit.WINDOW_SECONDS * 1000
    state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))


def verdicts(requests: DataFrame, users: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Verdict per request as it arrives; a window's counter goes away once the watermark has passed it."""
    known = ratelimit.with_window(requests.withWatermark("ts", lateness), users)
    return known.groupBy(*GROUP).applyInPandasWithState(
        _decide, VERDICT, "seen bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
