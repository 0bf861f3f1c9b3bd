"""Structured Streaming forms of the time operators.

Each takes a streaming DataFrame of events (agent, ts, …) and declares its watermark.
Rows later than the watermark are dropped; batch forms in operators.windows see all.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap_seconds: int = 3600, late: str = "10 minutes", key: str = "agent") -> DataFrame:
    """Sessions of a key; a row a whole gap after the last opens a new one."""
    gap = f"{gap_seconds * 1_000_000 - 1} microseconds"
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("w")


def confirmed_feedback(feedback: DataFrame, activations: DataFrame, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Feedback joined with activations of the same memory in the seconds before it.

    A row meets those of its memory in its own stretch of that many seconds and, for feedback, in the one before, not all in the state."""
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    f = feedback.select(F.col("event_id").alias("feedback_id"), F.col("memory_id").alias("fm"), "useful", F.col("ts").alias("fts")).withWatermark("fts", late)
    f = f.withColumn("fs", F.explode(F.array(stretch("fts"), stretch("fts") - 1)))
    a = activations.select(F.col("event_id").alias("activation_id"), "memory_id", F.col("ts").alias("ats")).withWatermark("ats", late).withColumn("astretch", stretch("ats"))
    return f.join(a, F.expr(f"fm = memory_id and fs = astretch and ats <= fts and ats >= fts - interval {seconds} seconds")).drop("fs", "astretch")


def co_activated(activations: DataFrame, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """Pairs of an agent's activations within the seconds of each other, each pair once."""
    x = activations.select(F.col("agent").alias("xa"), F.col("event_id").alias("xe"), F.col("memory_id").alias("xm"), F.col("ts").alias("xt")).withWatermark("xt", late)
    y = activations.select(F.col("agent").alias("ya"), F.col("event_id").alias("ye"), F.col("memory_id").alias("ym"), F.col("ts").alias("yt")).withWatermark("yt", late)
    return x.join(y, F.expr(f"xa = ya and xe < ye and xm != ym and yt >= xt - interval {seconds} seconds and yt <= xt + interval {seconds} seconds"))


def counts(events: DataFrame, size: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute", key: str = "agent") -> DataFrame:
    """Requests of a key per sliding window, for rate limits."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start_ts"), "n")


def coalesced(events: DataFrame, seconds: int = 10, late: str = "1 minute", key: str = "agent") -> DataFrame:
    """Rows kept when those within the seconds after the last kept one are dropped.

    The state of a key is the time of its last kept row; it is given up when the
    watermark has passed it by an hour."""
    import pandas as pd

    kind = events.schema[key].dataType.simpleString()
    width = pd.Timedelta(seconds=seconds)

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        for rows in batches:
            keep = []
            for t in (rows := rows.sort_values(["ts", "event_id"])).ts:
                good = last is None or t - last >= width
                last = t if good else last
                keep.append(good)
            yield rows[keep][[key, "event_id", "ts"]]
        if last is not None:
            state.update((last.to_pydatetime(),))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + 3_600_000, state.getCurrentWatermarkMs() + 1))

    own = events.select(key, "event_id", "ts").withWatermark("ts", late)
    return own.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, event_id long, ts timestamp", "last timestamp", "append", "EventTimeTimeout")


def checkpoint_counters(events: DataFrame, key: str = "agent") -> DataFrame:
    """Writes and recalls of each key so far (complete or update mode)."""
    return events.groupBy(key).agg(F.count_if(F.col("event_type").isin("view", "click")).alias("recalls"), F.count_if(F.col("event_type") == "purchase").alias("writes"), F.max("ts").alias("last_ts"))


def cron_matches(expression: str, minute: int, hour: int, day: int, month: int, weekday: int) -> bool:
    """Whether a five-field cron expression matches a time; Sunday is 0 or 7.
    All five fields must match."""

    def field(text: str, value: int, low: int, high: int) -> bool:
        for part in text.split(","):
            span, _, step = part.partition("/")
            if step and (not step.isdigit() or int(step) < 1):
                return False
            if span == "*":
                a, b = low, high
            elif "-" in span:
                x, _, y = span.partition("-")
                if not (x.isdigit() and y.isdigit()):
                    return False
                a, b = int(x), int(y)
            elif span.isdigit():
                a = int(span)
                b = high if step else a
            else:
                return False
            if a <= value <= b and (value - a) % int(step or 1) == 0:
                return True
        return False

    parts = expression.split()
    if len(parts) != 5:
        return False
    days, weekdays = field(parts[2], day, 1, 31), field(parts[4], weekday, 0, 7) or (weekday == 0 and field(parts[4], 7, 0, 7))
    return field(parts[0], minute, 0, 59) and field(parts[1], hour, 0, 23) and field(parts[3], month, 1, 12) and days and weekdays
