"""Streaming operators whose state follows event time exactly.

A row waits in its key's state until the watermark has passed it.  Then it is counted after every row
before it, so results do not depend on the order of arrival: they are those of a batch over
all rows that were not late.  The state of a key holds its waiting rows and the few
that still matter to coming ones.

Defined results: rows without a time are left out, rows without a key are one key, rows of one time are in
the order of their ids, repeated rows count each; rows later than the watermark are dropped; rows
that the watermark has not passed when a stream stops are given out when it goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "kept_ts array<bigint>, kept_id array<bigint>, kept_value array<bigint>, ts array<bigint>, id array<bigint>, value array<bigint>"
Rows = np.ndarray  # of (microseconds, id, value), in order
#: From (kept, due, watermark in microseconds) to (kept, results, next time to look in microseconds or None).
Step = Callable[[Rows, Rows, int], tuple[Rows, list, int | None]]


def _sorted(rows: Rows) -> Rows:
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def in_event_order(events: DataFrame, step: Step, fields: str, value: Column, late: str, key: str) -> DataFrame:
    """Fold each key's rows (event_id, ts, value) in order of event time, as the watermark passes them."""
    kind = events.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]
    empty = np.zeros((0, 3), np.int64)

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, waiting = empty, empty
        if state.exists:
            old = [np.asarray(c, np.int64) for c in state.get]
            kept, waiting = np.stack(old[:3], 1), np.stack(old[3:], 1)
        if not state.hasTimedOut:
            waiting = np.concatenate([waiting, *(b[["__us", "event_id", "__value"]].to_numpy(np.int64) for b in batches)])
        watermark = state.getCurrentWatermarkMs()
        waiting = _sorted(waiting)
        cut = int(np.searchsorted(waiting[:, 0], watermark * 1000, "right")) if watermark > 0 else 0
        due, waiting = waiting[:cut], waiting[cut:]
        kept, out, look = step(kept, due, watermark * 1000)
        times = [t for t in (look, int(waiting[0, 0]) if len(waiting) else None) if t is not None]
        if not times and not len(kept):
            state.remove() if state.exists else None
        else:
            state.update((*(c.tolist() for c in kept.T), *(c.tolist() for c in waiting.T)))
            # a state without waiting rows is looked at once more when what it keeps may have lost its use
            at = min(times) // 1000 - 1 if times else watermark + 3_600_000
            state.setTimeoutTimestamp(max(at, watermark + 1))
        if out:
            rows = pd.DataFrame(out, columns=names)
            rows.insert(0, key, pd.Series([keys[0]] * len(rows), dtype=object if keys[0] is None else None))
            yield rows

    own = events.where("ts is not null").select(key, "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("__us"), F.coalesce(value.cast("long"), F.lit(-1)).alias("__value"))
    return own.withWatermark("ts", late).groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, {fields}", _STATE, "append", "EventTimeTimeout")


def rate_limited(events: DataFrame, seconds: int = 60, most: int = 300, late: str = "1 minute", key: str = "agent") -> DataFrame:
    """(key, event_id, ts, in_window, limited): as windows.rate_limited, how many requests the key made in the trailing
    window, both ends included, and whether that is too many.  The state is a window's rows of a key."""
    width = seconds * 1_000_000

    def step(kept: Rows, due: Rows, watermark: int) -> tuple[Rows, list, int | None]:
        every = np.concatenate([kept, due])
        t = every[:, 0]
        n = np.searchsorted(t, due[:, 0], "right") - np.searchsorted(t, due[:, 0] - width, "left")
        return every[t >= watermark - width], list(zip(due[:, 1].tolist(), due[:, 0].tolist(), n.tolist())), None

    out = in_event_order(events, step, "event_id long, us long, in_window long", F.lit(0), late, key)
    return out.select(key, "event_id", F.timestamp_micros("us").alias("ts"), "in_window", (F.col("in_window") > most).alias("limited"))


def recent_pairs(activations: DataFrame, seconds: int = 10, most: int = 50, late: str = "1 minute", key: str = "agent") -> DataFrame:
    """(key, event_id, memory_id, with_event, with_memory): each activation with those of other memories among the last ``most``
    of its key, itself included, that are at most the seconds before it.  The state is ``most`` rows of a key.

    Activations without a memory take a place among the last ones and pair with nothing."""
    width = seconds * 1_000_000

    def step(kept: Rows, due: Rows, watermark: int) -> tuple[Rows, list, int | None]:
        every, out = np.concatenate([kept, due]), []
        for d in range(1, min(most, len(every))):
            a, b = every[:-d], every[d:]
            new = np.arange(d, len(every)) >= len(kept)
            hit = new & (a[:, 2] != b[:, 2]) & (a[:, 2] >= 0) & (b[:, 2] >= 0) & (b[:, 0] - a[:, 0] <= width)
            out += zip(b[hit, 1].tolist(), b[hit, 2].tolist(), a[hit, 1].tolist(), a[hit, 2].tolist())
        last = every[max(0, len(every) - most + 1) :]
        return last[last[:, 0] >= watermark - width], out, None

    return in_event_order(activations, step, "event_id long, memory_id long, with_event long, with_memory long", F.col("memory_id"), late, key)


def quiescent(events: DataFrame, minutes: float = 30, late: str = "1 minute", key: str = "agent") -> DataFrame:
    """(key, event_id, last_ts): the last event of each quiet spell of a key, given out once when the watermark
    is ``minutes`` past it.  An event exactly that much later still ends a spell; one state row a key."""
    width = int(minutes * 60_000_000)

    def step(kept: Rows, due: Rows, watermark: int) -> tuple[Rows, list, int | None]:
        every = np.concatenate([kept, due])
        if not len(every):
            return every, [], None
        following = np.append(every[1:, 0], watermark)
        over = following - every[:, 0] >= width
        out = list(zip(every[over, 1].tolist(), every[over, 0].tolist()))
        rest = every[-1:] if not over[-1] else every[:0]
        return rest, out, int(rest[0, 0]) + width if len(rest) else None

    out = in_event_order(events, step, "event_id long, us long", F.lit(0), late, key)
    return out.select(key, "event_id", F.timestamp_micros("us").alias("last_ts"))


def idle(events: DataFrame, minutes: float = 30, key: str = "agent") -> DataFrame:
    """(key, last_ts): keys from which nothing has come for ``minutes`` of the clock on the wall, each quiet spell once.

    The timer of a key starts anew with every batch that has a row of it; last_ts is the latest time among its rows."""
    kind = events.schema[key].dataType.simpleString()

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: pd.Series([keys[0]], dtype=object if keys[0] is None else None), "us": [last]})
            return
        last = state.get[0] if state.exists else np.iinfo(np.int64).min
        for b in batches:
            last = max(last, int(b["us"].max()))
        state.update((last,))
        state.setTimeoutDuration(int(minutes * 60_000))

    own = events.where("ts is not null").select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = own.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, us long", "us bigint", "append", "ProcessingTimeTimeout")
    return out.select(key, F.timestamp_micros("us").alias("last_ts"))


#: Seconds between two runs of each periodic task.
TIMERS = {"consolidation": 60, "probe": 60, "stale": 300, "prune": 1800, "purge": 3600}


def cron_due(expression: str, ts: Column) -> Column:
    """Whether a five-field cron expression names the minute of a time, without Python; see operators.cron_matches."""
    from palimpsest.streaming.operators import cron_matches

    parts = expression.split()
    if len(parts) != 5:
        return F.lit(False)
    spans = ((0, 60, F.minute(ts)), (0, 24, F.hour(ts)), (1, 32, F.dayofmonth(ts)), (1, 13, F.month(ts)), (0, 7, F.dayofweek(ts) - 1))
    out = F.lit(True)
    for k, (low, high, own) in enumerate(spans):
        alone = ["*"] * 5
        alone[k] = parts[k]
        at = [0, 0, 1, 1, 0]
        fits = [v for v in range(low, high) if cron_matches(" ".join(alone), *(at[:k] + [v] + at[k + 1 :]))]
        out = out & (own.isin(fits) if fits else F.lit(False))
    return out


def cron_ticks(ticks: DataFrame, expression: str, late: str = "1 minute") -> DataFrame:
    """(minute): each minute that the expression names and a tick (ts) falls in, once."""
    own = ticks.where("ts is not null").select(F.date_trunc("minute", "ts").alias("minute"))
    return own.where(cron_due(expression, F.col("minute"))).withWatermark("minute", late).dropDuplicatesWithinWatermark(["minute"])


def timer_ticks(ticks: DataFrame, timers: dict[str, int] | None = None, late: str = "1 hour") -> DataFrame:
    """(task, due): for each periodic task the starts of its periods that a tick (ts) falls in, each once.

    ``late`` is at least the longest period, else a slow period could be given out twice."""
    every = F.array(*(F.struct(F.lit(n).alias("task"), F.lit(s).alias("seconds")) for n, s in (timers or TIMERS).items()))
    own = ticks.where("ts is not null").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.explode(every).alias("e"))
    due = own.select("e.task", F.timestamp_seconds(F.col("s") - F.pmod("s", "e.seconds")).alias("due"))
    return due.withWatermark("due", late).dropDuplicatesWithinWatermark(["task", "due"])
