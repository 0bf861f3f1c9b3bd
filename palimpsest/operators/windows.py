"""Time and order: sessions, bands, as-of links, rates, runs.

Bands and intervals are joined on time buckets, so a key's rows meet only their
neighbours in time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def sessions(events: DataFrame, key: str = "agent", ts: str = "ts", gap_seconds: int = 3600, order: str = "event_id") -> DataFrame:
    """(key, session, start, end, n): a row joins the session whose last row is less than the gap before it."""
    w = Window.partitionBy(key).orderBy(ts, order)
    new = F.coalesce((_micros(ts) - F.lag(_micros(ts)).over(w) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    rows = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n"))


def previous_links(memories: DataFrame) -> DataFrame:
    """Temporal edges from each memory's predecessor of the same agent."""
    w = Window.partitionBy("agent").orderBy("created_at", "id")
    links = memories.select("id", F.lag("id").over(w).alias("src")).where("src is not null")
    return links.select("src", F.col("id").alias("dst"), F.lit("temporal").alias("type"), F.lit(0.3).alias("weight"), F.lit(0.8).alias("confidence"))


def co_activated(activations: DataFrame, window_seconds: int = 10, by: str | None = "agent") -> DataFrame:
    """(a, b, n): pairs of memories recalled within the window of each other."""
    width = window_seconds * 1_000_000
    own = activations.select(*([by] if by else []), "memory_id", _micros("ts").alias("t"), "event_id").withColumn("bucket", F.floor(F.col("t") / width).cast("long"))
    right = own.select(*([F.col(by)] if by else []), F.col("memory_id").alias("b"), F.col("t").alias("tb"), F.col("event_id").alias("eb"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    both = own.join(right, [*([by] if by else []), "bucket"]).where((F.col("event_id") < F.col("eb")) & (F.abs(F.col("t") - F.col("tb")) <= width) & (F.col("memory_id") != F.col("b")))
    return both.groupBy(F.least("memory_id", "b").alias("a"), F.greatest("memory_id", "b").alias("b")).agg(F.count("*").alias("n"))


def resolved_feedback(feedback: DataFrame, activations: DataFrame, seconds: int = 60) -> DataFrame:
    """Feedback with the latest activation of the same memory in the seconds before it.

    Both are sorted together by time within a memory's bucket, and what stands last of the activations before a row is its
    latest there; else it is the last of the bucket before.  No row meets more than one other, however many a memory has."""
    width = seconds * 1_000_000
    bucket = F.floor(F.col("t") / width).cast("long").alias("bucket")
    none = lambda c: F.lit(None).cast(feedback.schema[c].dataType).alias(c)
    f = feedback.where("memory_id is not null and ts is not null").select("memory_id", "event_id", "useful", _micros("ts").alias("t"), F.lit(1).alias("kind"))
    a = activations.where("memory_id is not null and ts is not null").select("memory_id", "event_id", none("useful"), _micros("ts").alias("t"), F.lit(0).alias("kind"))
    found = F.when(F.col("kind") == 0, F.struct("t", "event_id"))
    carried = a.select("memory_id", "t", "event_id", bucket).groupBy("memory_id", (F.col("bucket") + 1).alias("bucket")).agg(F.max(F.struct("t", "event_id")).alias("carried"))
    w = Window.partitionBy("memory_id", "bucket").orderBy("t", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(a).select("*", bucket).withColumn("own", F.last(found, ignorenulls=True).over(w)).where("kind = 1")
    hit = both.join(carried, ["memory_id", "bucket"], "left").withColumn("x", F.coalesce("own", "carried")).where(F.col("t") - F.col("x.t") <= width)
    return hit.groupBy(F.col("event_id").alias("feedback_id"), "memory_id", "useful").agg(F.max("x").alias("x")).select("feedback_id", "memory_id", "useful", F.col("x.event_id").alias("activation_id"))


def active_session(events: DataFrame, as_of_micros: int, key: str = "agent", gap_seconds: int = 3600) -> DataFrame:
    """The newest session of each key that ended within the gap before the time asked."""
    s = sessions(events.where(_micros("ts") <= as_of_micros), key, gap_seconds=gap_seconds)
    w = Window.partitionBy(key).orderBy(F.desc("end_ts"), F.desc("session"))
    return s.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (_micros("end_ts") > as_of_micros - gap_seconds * 1_000_000)).drop("rn")


def rate_limited(events: DataFrame, key: str = "agent", seconds: int = 60, most: int = 300) -> DataFrame:
    """Each request with how many its key made in the trailing window, itself included, and whether that is too many."""
    w = Window.partitionBy(key).orderBy(F.col("__t")).rangeBetween(-seconds * 1_000_000, 0)
    out = events.withColumn("__t", _micros("ts")).withColumn("in_window", F.count("*").over(w))
    return out.withColumn("limited", F.col("in_window") > most).drop("__t")


def failure_runs(events: DataFrame, key: str = "agent", ok: str = "ok", order: str = "event_id") -> DataFrame:
    """Consecutive failures up to and including each row, since the key's last success."""
    w = Window.partitionBy(key).orderBy("ts", order)
    run = events.withColumn("__g", F.sum(F.col(ok).cast("int")).over(w))
    inner = Window.partitionBy(key, "__g").orderBy("ts", order)
    return run.withColumn("failures", F.sum((~F.col(ok)).cast("int")).over(inner)).drop("__g")


def breaker_states(events: DataFrame, threshold: int = 5, cooldown_seconds: int = 30, key: str = "agent", ok: str = "ok") -> DataFrame:
    """(key, event_id, state) before each call: closed; open once ``threshold`` failures in a row
    have opened the circuit; half_open when more than the cooldown has passed since then.

    Later failures keep the time of opening, but one in half_open opens anew.  So the state
    depends on the calls before: each key is sorted in Spark and folded, two numbers of state.
    """
    ranged = events.select(key, "event_id", _micros("ts").alias("__t"), F.col(ok).alias("__ok")).repartition(key).sortWithinPartitions(key, "__t", "event_id")
    cooldown = cooldown_seconds * 1_000_000

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, failures, opened = None, 0, 0
        for batch in batches:
            states = []
            for k, t, good in zip(*(batch.column(c).to_pylist() for c in (key, "__t", "__ok"))):
                if k != now:
                    now, failures = k, 0
                state = "closed" if failures < threshold else "half_open" if t - opened > cooldown else "open"
                states.append(state)
                failures = 0 if good else failures + 1
                if failures >= threshold and state != "open":
                    opened = t
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("event_id"), pa.array(states, pa.string())], names=[key, "event_id", "state"])

    return ranged.mapInArrow(fold, f"`{key}` {ranged.schema[key].dataType.simpleString()}, event_id {ranged.schema['event_id'].dataType.simpleString()}, state string")


def coalesced(events: DataFrame, key: str = "agent", seconds: int = 10, schema_cols: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Rows that are kept when one within the seconds after the last kept one is dropped.

    Which row is kept depends on the one kept before, so each key is folded in time
    order: sorted in Spark and streamed through Arrow, one number of state per key.
    """
    own = events.select(key, _micros("ts").alias("__t"), *schema_cols)
    ranged = own.repartition(key).sortWithinPartitions(key, "__t", *schema_cols)
    width = seconds * 1_000_000

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, last = None, 0
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column("__t").to_pylist()):
                good = k != now or t - last >= width
                if good:
                    now, last = k, t
                keep.append(good)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ranged.mapInArrow(fold, ranged.schema).drop("__t")


def recall_confidence(ranked: DataFrame, query: str = "query", score: str = "score", rank: str = "rank") -> DataFrame:
    """(query, confidence, sharpness, cliff, floor) from the first ten scores of each query."""
    eps = 0.05
    g = ranked.where(F.col(rank) <= 10).groupBy(query).agg(
        F.max(F.when(F.col(rank) == 1, F.col(score))).alias("top"), F.avg(F.when(F.col(rank) <= 5, F.col(score))).alias("mean5"), F.max_by(score, rank).alias("last"), F.count("*").alias("n")
    )
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    sharp = F.when((F.col("n") >= 2) & (F.col("mean5") > 0), (F.col("top") / F.col("mean5") - 1) / (F.col("top") / F.col("mean5") + 1)).otherwise(0.0)
    cliff = F.when((F.col("n") >= 2) & (F.col("top") > 0), clamp((F.col("top") - F.col("last")) / F.col("top"))).otherwise(0.0)
    parts = g.select(query, sharp.alias("sharpness"), cliff.alias("cliff"), clamp(F.col("top")).alias("floor"))
    blend = F.exp(0.4 * F.log(F.col("sharpness") + eps) + 0.3 * F.log(F.col("cliff") + eps) + 0.3 * F.log(F.col("floor") + eps)) - eps
    return parts.withColumn("confidence", clamp(blend))
