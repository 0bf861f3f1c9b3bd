"""Operators on the edge table: statistics, maintenance, walks, retraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import ConsolidationConfig
from palimpsest.functions import scoring as S


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, weight): each edge once at either end; a self loop twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")


def end_stats(edges: DataFrame) -> DataFrame:
    """(id, n, sum_weight) of each id that has edges."""
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("n"), F.sum("weight").alias("sum_weight"))


def edge_stats(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, sum_weight) of each asked id, zero without edges."""
    return ids.select("id").join(end_stats(edges), "id", "left").na.fill({"n": 0, "sum_weight": 0.0})


def undirected(edges: DataFrame) -> DataFrame:
    """(id, other, …) from both ends; a self loop once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")))).otherwise(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    return edges.withColumn("e", F.explode(ends)).select("e.id", "e.other", "type", "weight", "confidence")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return undirected(edges).join(ids.select("id").distinct(), "id", "left_semi")


def scoped(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges that start at one of the memories (their ends may lie elsewhere)."""
    return edges.join(memories.select(F.col("id").alias("src")), "src", "left_semi")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def weakest(edges: DataFrame) -> DataFrame:
    """Each node's weakest outgoing edge."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.min(F.struct("weight", "dst")).alias("x")).select("id", F.col("x.dst").alias("dst"), F.col("x.weight").alias("weight"))


def heaviest(edges: DataFrame, keep: int = 20) -> DataFrame:
    """At most ``keep`` outgoing edges of each node, the heaviest."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def upsert(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes by (src, dst): weight, confidence and time are replaced, the count grows, the type stays."""
    c = changes.select("src", "dst", *[F.col(x).alias(f"new_{x}") for x in ("type", "weight", "confidence", "last_activated")])
    both = edges.join(c, ["src", "dst"], "full_outer")
    pick = lambda x: F.coalesce(f"new_{x}", x).alias(x)
    count = F.when(F.col("activation_count").isNull(), 1).otherwise(F.col("activation_count") + F.when(F.col("new_weight").isNotNull(), 1).otherwise(0))
    return both.select("src", "dst", F.coalesce("type", "new_type").alias("type"), pick("weight"), pick("confidence"), count.cast("long").alias("activation_count"), pick("last_activated"))


def decayed(edges: DataFrame, as_of: Column, scale=7.0) -> DataFrame:
    """Decay by idle time: idle under half a day stays; under .01 goes; a change of .001 or less stays."""
    days = S.days_between(as_of, F.col("last_activated"))
    new = S.decay_edge("weight", days, scale)
    out = edges.withColumn("new_weight", F.when(days < 0.5, F.col("weight")).otherwise(new)).where((days < 0.5) | (F.col("new_weight") >= 0.01))
    return out.withColumn("weight", F.when(F.abs(F.col("weight") - F.col("new_weight")) > 0.001, F.col("new_weight")).otherwise(F.col("weight"))).drop("new_weight")


def decayed_by_confidence(edges: DataFrame, memories: DataFrame, as_of: Column, cfg: ConsolidationConfig = ConsolidationConfig()) -> DataFrame:
    """Decay whose half-life grows with the ends' confidence and use."""
    m = memories.select("id", "confidence", "access_count")
    side = lambda c: m.select(F.col("id").alias(c), F.col("confidence").alias(f"c_{c}"), F.col("access_count").alias(f"n_{c}"))
    both = edges.join(side("src"), "src").join(side("dst"), "dst")
    life = S.edge_half_life(F.greatest("c_src", "c_dst"), F.greatest("n_src", "n_dst"))
    days = S.days_between(as_of, F.col("last_activated"))
    out = both.withColumn("half_life", life).withColumn("weight", F.when(days < 0.5, F.col("weight")).otherwise(S.decay_edge("weight", days, F.col("half_life"))))
    return out.where(F.col("weight") >= cfg.prune_below).drop("c_src", "c_dst", "n_src", "n_dst")


def balanced(edges: DataFrame, cfg: ConsolidationConfig = ConsolidationConfig()) -> DataFrame:
    """Outgoing weight of a node beyond the limit is scaled down to it; what becomes too weak goes."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    out = edges.join(total, "src").withColumn("weight", F.when(F.col("total") > cfg.homeostasis, F.col("weight") * cfg.homeostasis / F.col("total")).otherwise(F.col("weight")))
    return out.where((F.col("total") <= cfg.homeostasis) | (F.col("weight") >= cfg.prune_below)).drop("total")


def strengthened(edges: DataFrame, pairs: DataFrame, rate: float = 0.25) -> DataFrame:
    """Edges of (src, dst, signal) pairs grow, missing ones start from .1; returns the changed edges."""
    both = pairs.join(edges.select("src", "dst", "weight"), ["src", "dst"], "left")
    old = F.coalesce("weight", F.lit(0.1))
    return both.select("src", "dst", F.when(F.col("signal") >= 0, S.strengthen(F.greatest(old, F.lit(0.1)), F.col("signal"), rate)).otherwise(F.greatest(F.lit(0.001), old * 0.7)).alias("weight"))


#: Share of the walk per kind of edge, and the penalty's factor per kind.
SUBGRAPHS = {"semantic": (0.40, ("connection", "hebbian")), "temporal": (0.20, ("temporal",)), "causal": (0.25, ("causal",)), "entity": (0.15, ("bridge",))}


def graph_walk(pool: DataFrame, edges: DataFrame, beam: int = 15, hop: float = 0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, boost): what the pool's members gain from strong neighbours in it, over two hops.

    ``pool`` has id, score, text_match, graph_boost.  All four subgraphs are walked in one
    plan, with the subgraph as a column; each hop is one join with the pool's own edges.
    With columns ``by``, such as a query, every value has a pool of its own.
    """
    share = F.create_map(*[F.lit(x) for k, (g, _) in SUBGRAPHS.items() for x in (k, g)])
    kind = F.lit(None).cast("string")
    for k, (_, types) in SUBGRAPHS.items():
        kind = F.when(F.col("type").isin(*types), k).otherwise(kind)
    own = pool.select(*by, "id", "score", "text_match", F.coalesce("graph_boost", F.lit(0.0)).alias("graph_boost"))
    near = undirected(edges).withColumn("sub", kind).where("sub is not null")
    near = (near.join(own.select(*by, "id"), "id") if by else near.join(own.select("id"), "id", "left_semi")).join(own.select(*by, F.col("id").alias("other"), F.col("text_match").alias("other_text")), [*by, "other"])
    width = F.greatest(F.lit(3), F.ceil(F.lit(beam) * F.element_at(share, F.col("sub"))))
    w = Window.partitionBy(*by, "sub").orderBy(F.desc("score"), "id")
    seeds = own.where("text_match >= 0.15").withColumn("sub", F.explode(F.array(*map(F.lit, SUBGRAPHS)))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= width).select(*by, "sub", "id", "score")
    gains = None
    for depth in (0, 1):
        penalty = F.when(F.col("sub") == "causal", 2 * hop ** (depth + 1)).otherwise(hop ** (depth + 1))
        step = seeds.join(near, [*by, "sub", "id"]).where(F.col("other_text") >= (0.1 if depth == 0 else 0.05))
        step = step.withColumn("gain", F.col("score") * F.least(F.col("weight"), F.lit(5.0)) / 5 * penalty)
        boost = F.least(F.col("gain") * F.element_at(share, F.col("sub")), F.lit(0.15))
        hit = step.withColumn("boost", boost).where("boost > 0.001").select(*by, "sub", F.col("other").alias("id"), "gain", "boost")
        gains = hit if gains is None else gains.unionByName(hit)
        w = Window.partitionBy(*by, "sub").orderBy(F.desc("score"), "id")
        seeds = hit.groupBy(*by, "sub", "id").agg(F.max("gain").alias("score")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= width).select(*by, "sub", "id", "score")
    total = gains.groupBy(*by, "id").agg(F.sum("boost").alias("b")).join(own.select(*by, "id", "graph_boost"), [*by, "id"])
    return total.select(*by, "id", F.greatest(F.lit(0.0), F.least("b", 0.25 - F.col("graph_boost"))).alias("boost"))


def beam_walk(pool: DataFrame, edges: DataFrame, beam: int = 15, hop: float = 0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, boost): as graph_walk, but no member gains from one that stands after it in a beam, and the second
    hop starts from the members' own scores.  Recall walks this way.

    A beam is the best of a subgraph by score; the second holds those that the first reached, one place for every way
    there.  What a beam before or an earlier place has explored gains nothing more."""
    share = F.create_map(*[F.lit(x) for k, (g, _) in SUBGRAPHS.items() for x in (k, g)])
    kind = F.lit(None).cast("string")
    for k, (_, types) in SUBGRAPHS.items():
        kind = F.when(F.col("type").isin(*types), k).otherwise(kind)
    own = pool.select(*by, "id", "score", "text_match", F.coalesce("graph_boost", F.lit(0.0)).alias("graph_boost"))
    ends = own.select(*by, F.col("id").alias("other"), F.col("text_match").alias("other_text"), F.col("score").alias("other_score"))
    near = undirected(edges).withColumn("sub", kind).where("sub is not null and id != other")
    near = (near.join(own.select(*by, "id"), "id") if by else near.join(own.select("id"), "id", "left_semi")).join(ends, [*by, "other"])
    key, width = [*by, "sub"], F.greatest(F.lit(3), F.ceil(F.lit(beam) * F.element_at(share, F.col("sub"))))
    place = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = own.where("text_match >= 0.15").withColumn("sub", F.explode(F.array(*map(F.lit, SUBGRAPHS)))).withColumn("rn", place(F.desc("score"), "id")).where(F.col("rn") <= width).select(*key, "id", "score", "rn")

    def step(now: DataFrame, depth: int, least: float) -> DataFrame:
        after = now.select(*key, F.col("id").alias("other"), F.col("rn").alias("other_rn"))
        out = now.join(near, [*key, "id"]).where(F.col("other_text") >= least).join(after, [*key, "other"], "left").where("other_rn is null or other_rn > rn")
        gain = F.col("score") * F.least(F.col("weight"), F.lit(5.0)) / 5 * F.when(F.col("sub") == "causal", 2.0).otherwise(1.0) * hop ** (depth + 1)
        return out.withColumn("boost", F.least(gain * F.element_at(share, F.col("sub")), F.lit(0.15))).where("boost > 0.001").select(*key, F.col("other").alias("id"), F.col("other_score").alias("score"), "boost")

    explored = first.select(*key, "id")
    one = step(first, 0, 0.1)
    second = one.withColumn("rn", place(F.desc("score"), "id")).where(F.col("rn") <= width).groupBy(*key, "id").agg(F.min("score").alias("score"), F.min("rn").alias("rn")).join(explored, [*key, "id"], "left_anti")
    two = step(second, 1, 0.05).join(explored, [*key, "id"], "left_anti")
    total = one.unionByName(two).groupBy(*by, "id").agg(F.sum("boost").alias("b")).join(own.select(*by, "id", "graph_boost"), [*by, "id"])
    return total.select(*by, "id", F.least("b", 0.25 - F.col("graph_boost")).alias("boost")).where("boost > 0.001")


def spreading_activation(pool: DataFrame, edges: DataFrame, rounds: int = 3, keep: float = 0.5, eps: float = 0.01, budget: int = 64) -> DataFrame:
    """(id, activation) after spreading from the pool over fan-normalised edges, normalised to 1 at most.
    The number of rounds is fixed, so the plan has a fixed number of joins; each round keeps ``budget`` nodes."""
    fan = undirected(edges).where("type != 'invalidation'")
    total = fan.groupBy("id").agg(F.sum("weight").alias("total"))
    fan = fan.join(total, "id").select("id", "other", (F.col("weight") / F.col("total")).alias("share"))
    start = pool.select("id", F.col("score").alias("a"))
    now = start
    for _ in range(rounds):
        moved = now.join(fan, "id").groupBy(F.col("other").alias("id")).agg((F.sum(F.col("a") * F.col("share")) * keep).alias("a"))
        now = moved.unionByName(start).groupBy("id").agg(F.sum("a").alias("a")).where(F.col("a") >= eps).orderBy(F.desc(F.round("a", 9)), "id").limit(budget)
    top = now.agg(F.max("a").alias("top"))
    return now.join(F.broadcast(top)).select("id", (F.col("a") / F.col("top")).alias("activation"))


def inherited_edges(edges: DataFrame, memories: DataFrame, corrections: DataFrame, least: float = 0.4, factor: float = 0.7, most: int = 10) -> DataFrame:
    """Edges that corrections (old, new) take over from what they retract."""
    live = memories.where(~F.col("retracted")).select(F.col("id").alias("other"))
    near = undirected(edges).where((F.col("weight") >= least) & ~F.col("type").isin("invalidation", "causal", "temporal"))
    own = near.join(corrections.select(F.col("old").alias("id"), "new"), "id").join(live, "other", "left_semi").where("other != new")
    w = Window.partitionBy("new").orderBy(F.desc("weight"), "other")
    return own.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select(F.col("new").alias("src"), F.col("other").alias("dst"), "type", (F.col("weight") * factor).alias("weight"))


def confidence_penalties(memories: DataFrame, edges: DataFrame, retracted: DataFrame, penalty: float = 0.1, cohesion: float = 1.0) -> DataFrame:
    """(id, confidence) of the neighbours of retracted ids, two hops deep, each hop's loss halved.
    Order-free: a node loses once at its nearest hop, over its strongest way there."""
    near = undirected(edges).where("type != 'invalidation'")
    gone = retracted.select("id").distinct()
    one = near.join(gone, "id").groupBy(F.col("other").alias("id")).agg(F.max("weight").alias("w")).join(gone, "id", "left_anti")
    two = near.join(one.select("id"), "id").groupBy(F.col("other").alias("id")).agg(F.max("weight").alias("w")).join(gone, "id", "left_anti").join(one.select("id"), "id", "left_anti")
    loss = one.withColumn("depth", F.lit(0)).unionByName(two.withColumn("depth", F.lit(1)))
    m = memories.select("id", "confidence").join(loss, "id")
    return m.select("id", F.greatest(F.lit(0.1), F.col("confidence") - penalty * F.least("w", F.lit(1.0)) * F.pow(F.lit(0.5), F.col("depth")) * (0.5 + cohesion)).alias("confidence"))


def cohesion(edges: DataFrame, memories: DataFrame, centre: int, most: int = 20) -> DataFrame:
    """One row: density and tag overlap of the two-hop neighbourhood of a memory."""
    near = undirected(edges).select("id", "other").where("id != other").distinct()
    one = near.where(F.col("id") == centre).select(F.col("other").alias("id"))
    two = near.join(one, "id", "left_semi").select(F.col("other").alias("id"))
    hop = one.withColumn("d", F.lit(1)).unionByName(two.withColumn("d", F.lit(2))).groupBy("id").agg(F.min("d").alias("d")).where(F.col("id") != centre)
    nodes = hop.orderBy("d", "id").limit(most - 1).select("id").unionByName(edges.sparkSession.range(1).select(F.lit(centre).cast("long").alias("id")))
    pairs = near.where("id < other")
    own = nodes.select(F.col("id"), F.lit(1).alias("in_a"))
    marked = pairs.join(own, "id", "left").join(own.select(F.col("id").alias("other"), F.col("in_a").alias("in_b")), "other", "left")
    counts = marked.agg(F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("inner"), F.count_if(F.coalesce("in_a", F.lit(0)) != F.coalesce("in_b", F.lit(0))).alias("outer"))
    tags = memories.join(nodes, "id", "left_semi").select("id", "tags")
    both = tags.alias("a").join(tags.alias("b"), F.col("a.id") < F.col("b.id"))  # at most most * most / 2 pairs
    overlap = both.select((F.size(F.array_intersect("a.tags", "b.tags")) / F.greatest(F.size(F.array_union("a.tags", "b.tags")), F.lit(1))).alias("j")).agg(F.coalesce(F.avg("j"), F.lit(0.0)).alias("overlap"))
    density = F.when(F.col("inner") + F.col("outer") > 0, F.col("inner") / (F.col("inner") + F.col("outer"))).otherwise(0.0)
    return counts.join(overlap).select("inner", "outer", density.alias("density"), "overlap", (density * (0.5 + 0.5 * F.col("overlap"))).alias("cohesion"))
