"""The rate limiter and windowed counts over unbounded event streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_window(events: DataFrame, key: str, at: str, event: str, limit: int, window: int, late: str = "0 seconds") -> DataFrame:
    """key, event, allowed, retry_after of a stream; the same decisions as operators.state.fixed_window over events in order.

    at: seconds, a long. State is one count and one end of a window for each key. It goes once the watermark has passed
    that end, so addresses that come once leave nothing behind, and a stream that is delayed or replayed forgets no
    window that is still open: time is the events', never the clock's. What comes later than `late` is dropped.
    """
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {event} {events.schema[event].dataType.simpleString()}, allowed boolean, retry_after long"

    def work(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, -1)
        for f in frames:
            f = f.sort_values([at, event])
            allowed, wait = [], []
            for now in f[at].tolist():
                if until <= now:
                    count, until = 0, now + window
                open_ = count < limit
                count += open_
                allowed.append(open_)
                wait.append(0 if open_ else max(1, until - now))
            yield pd.DataFrame({key: f[key], event: f[event], "allowed": allowed, "retry_after": wait})
        state.update((count, until))
        state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.where(F.col(at).isNotNull()).select(key, event, at, F.timestamp_seconds(F.col(at)).alias("_time")).withWatermark("_time", late)
    return rows.groupBy(key).applyInPandasWithState(work, out, "count long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """began, keys, n: events by tumbling or sliding windows of event time; what comes later than `late` is dropped by the watermark."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    counted = events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("began"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, began, ended, n: runs of a key's events with no pause of `gap`."""
    counted = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")
