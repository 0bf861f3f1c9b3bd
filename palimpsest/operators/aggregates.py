"""Aggregates over memories, events and tasks; evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, value: str, q: float, by: list[str] | None = None, name: str = "quantile") -> DataFrame:
    """sorted[min(floor(q n), n - 1)] (0-based), by group.

    The groups' counts of each value are ranked instead of the rows, so the largest
    partition has as many rows as a group has different values."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(value) if by else Window.partitionBy(F.lit(1)).orderBy(value)
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(total))
    rank = F.least(F.floor(q * F.col("n")), F.col("n") - 1)
    found = ranked.where((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank))
    return found.select(*by, F.col(value).alias(name), "n")


def latency_stats(activations: DataFrame, by: list[str]) -> DataFrame:
    """count, mean and 95th percentile (nearest rank) of latency."""
    main = activations.groupBy(*by).agg(F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean_ms"))
    p95 = nearest_rank(activations, "latency_ms", 0.95, by, "p95_ms").drop("n")
    return main.join(p95, by, "left")


def stage_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("agent").agg(*[F.count_if((F.col("stage") == s) & ~F.col("retracted")).alias(s) for s in ("active", "staging", "consolidated")])


def agent_stats(memories: DataFrame) -> DataFrame:
    """Counts by stage, retracted rows of any stage, their total, and the active mean confidence to 3 places."""
    live = ~F.col("retracted")
    active, staging, retracted = F.count_if(live & (F.col("stage") == "active")), F.count_if(live & (F.col("stage") == "staging")), F.count_if(F.col("retracted"))
    mean = F.coalesce(F.avg(F.when(live & (F.col("stage") == "active"), F.col("confidence"))), F.lit(0.0))
    return memories.groupBy("agent").agg(active.alias("active"), staging.alias("staging"), retracted.alias("retracted"), (active + staging + retracted).alias("total"), F.round(mean, 3).alias("avg_confidence"))


def staging_outcomes(events: DataFrame) -> DataFrame:
    """Counts of promoted, discarded and expired, from rows with an ``action``."""
    return events.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("promoted", "discarded", "expired")])


def retrieval_precision(feedback: DataFrame, memories: DataFrame, since: Column, by: list[str] | None = None) -> DataFrame:
    """Share of useful feedback later than ``since`` on known memories, 0 without any."""
    own = feedback.where(F.col("ts") > since).join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return own.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.coalesce(F.count_if("useful") / F.count("*"), F.lit(0.0)).alias("precision"))


def engine_metrics(memories: DataFrame, edges: DataFrame, feedback: DataFrame, as_of: Column, since: Column) -> DataFrame:
    """One row of the engine's health figures."""
    live, active = ~F.col("retracted"), F.col("stage") == "active"
    m = memories.agg(
        F.coalesce(F.avg(F.when(live & active, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        (F.count_if("retracted") / F.greatest(F.count_if(live & active) + F.count_if("retracted"), F.lit(1))).alias("retraction_rate"),
    )
    own = edges.join(memories.select(F.col("id").alias("src")), "src", "left_semi")
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("last_activated").cast("timestamp"))) / 86400e6
    e = own.agg(F.coalesce(F.count_if(F.col("activation_count") > 0) / F.count("*"), F.lit(0.0)).alias("edge_utility"), F.coalesce(F.avg(F.when(F.col("weight") > 0.01, age)), F.lit(0.0)).alias("mean_edge_age_days"))
    p = retrieval_precision(feedback, memories, since).drop("n")
    return m.join(e).join(p)  # one row each


def term_counts(memories: DataFrame, group: str, most: int = 15) -> DataFrame:
    """The most frequent meaningful words of each group: (group, word, n, rn)."""
    from palimpsest.functions.text import STOPWORDS

    words = F.filter(F.split(F.lower(F.regexp_replace("content", r"[^\w\s]", "")), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS))
    counts = memories.select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "word")
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Element-wise mean vector of each group, not brought to unit length."""
    flat = vectors.select(group, F.posexplode("vector").alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"))
    return flat.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("centroid"))


def next_sequence(memories: DataFrame) -> DataFrame:
    return memories.groupBy("agent").agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("next_sequence"))


def consensus_tags(memories: DataFrame, edges: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """Topic and entity tags that at least ``least`` neighbours of a memory share."""
    from palimpsest.operators.graph import undirected

    tags = memories.groupBy(F.col("id").alias("other")).agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))
    pairs = undirected(edges).select("id", "other").repartition("other").distinct()  # dealt once by the neighbour, whose tags are met there
    met = pairs.join(tags, "other").repartition("id")  # and once by the memory, with whole arrays; tags are taken apart and counted there
    near = met.select("id", F.explode("tags").alias("tag")).groupBy("id", "tag").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("id").orderBy(F.desc("n"), "tag")
    return near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def purge_preview(memories: DataFrame, most: int = 20) -> DataFrame:
    return memories.groupBy("agent").agg(F.count("*").alias("n"), F.round(F.avg("salience"), 2).alias("avg_salience")).orderBy(F.desc("n"), "agent").limit(most)


# Retrieval quality.  ``ranked`` has query, id, rank (from 1); ``truth`` has query, id.


def recall_at(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the relevant ids among the first k of each query."""
    hit = truth.join(ranked.where(F.col("rank") <= k).select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.count("*")).alias("recall"))


def mean_reciprocal_rank(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    first = ranked.join(truth, ["query", "id"], "left_semi").groupBy("query").agg(F.min("rank").alias("rank"))
    each = truth.select("query").distinct().join(first, "query", "left")
    return each.agg(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def ndcg_at(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    gain = ranked.where(F.col("rank") <= k).join(truth, ["query", "id"], "left_semi").groupBy("query").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = truth.groupBy("query").agg(F.count("*").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return ideal.join(gain, "query", "left").select("query", (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation of each group by positions (ties in order of id); 0 under two rows."""
    wx, wy = (Window.partitionBy(*by).orderBy(c, "id") for c in (x, y))
    r = df.withColumn("rx", F.row_number().over(wx)).withColumn("ry", F.row_number().over(wy))
    n, d = F.count("*"), F.col("rx").cast("long") - F.col("ry")
    d2 = F.sum((d * d).cast("decimal(20,0)"))  # past a long from some millions of rows on
    return r.groupBy(*by).agg(F.when(n < 2, 0.0).otherwise(1 - (6 * d2).cast("double") / (n.cast("double") * (n * n - 1))).alias("rho"))


def dedup_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of found pairs (a, b) against true ones."""
    n, m = found.agg(F.count("*").alias("n")), truth.agg(F.count("*").alias("m"))
    both = found.join(truth, ["a", "b"], "left_semi").agg(F.count("*").alias("tp"))
    p, r = F.coalesce(F.col("tp") / F.col("n"), F.lit(0.0)), F.coalesce(F.col("tp") / F.col("m"), F.lit(0.0))
    return both.join(n).join(m).select(p.alias("precision"), r.alias("recall"), F.coalesce(F.when(p + r > 0, 2 * p * r / (p + r)), F.lit(0.0)).alias("f1"))
