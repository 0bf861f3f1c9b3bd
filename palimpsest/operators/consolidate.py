"""Batch consolidation: clusters, synthesis, bridges, fading, forgetting, redundancy, drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from palimpsest.config import ConsolidationConfig
from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.operators.aggregates import nearest_rank
from palimpsest.operators.nearest import _matrix

CFG = ConsolidationConfig()


BLOCK = 8192  # vectors of one block; what moves is each vector once for every block of its agent
ROWS = 256  # rows of a product at a time


def _block_pairs(vectors: DataFrame, block: int) -> GroupedData:
    """An agent's vectors in blocks, each two of which meet in one group (agent, i, j)."""
    n = vectors.groupBy("agent").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = vectors.join(n, "agent").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("blocks", "other").groupBy("agent", "i", "j")


def _near(t: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of one block, row of the other, similarity) of the pairs of a group above a similarity, some rows at a time."""
    block, ids, v = np.asarray(t.column("block")), np.asarray(t.column("id")), _matrix(t.column("vector"))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for s in range(0, len(left), ROWS):
        sim = v[left[s : s + ROWS]] @ v[right].T
        x, y = np.nonzero(sim >= least - 1e-6)
        value = np.clip(sim[x, y], -1, 1)
        x, y = left[s + x], right[y]
        keep = np.round(value, 6) >= least
        keep &= ids[x] < ids[y] if i == j else True
        yield x[keep], y[keep], value[keep]


def similar_pairs(vectors: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(agent, a, b, similarity), a < b: pairs of an agent's memories above a similarity.

    Vectors are dealt to blocks; two blocks meet in one task, which multiplies their
    matrices, so what moves is blocks and what comes out is only similar pairs."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, agent = np.asarray(t.column("id")), t.column("agent")[0]
        for x, y, value in _near(t, least):
            a, b = ids[x], ids[y]
            yield pa.RecordBatch.from_arrays([pa.repeat(agent, len(a)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(value)], names=["agent", "a", "b", "similarity"])

    agent = vectors.schema["agent"].dataType.simpleString()
    return _block_pairs(vectors.select("agent", F.col("id").cast("long").alias("id"), "vector"), block).applyInArrow(multiply, f"agent {agent}, a long, b long, similarity double")


def clusters(memories: DataFrame, vectors: DataFrame, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """(agent, cluster, id): greedy clusters from the most used memory on.

    A memory joins a cluster if it is close to one member and not too far from any.
    The greedy pass is inherently in order, one agent at a time: it holds the agent's vectors, and no pairs."""
    live = memories.where("stage = 'active' and not retracted").select("agent", F.col("id").cast("long").alias("id"), "access_count")
    nodes = live.join(vectors.select("id", "vector"), "id").select("agent", "id", "access_count", "vector")
    link = lambda s: np.round(s, 6) >= cfg.complete_link

    def greedy(t: pa.Table) -> pa.Table:
        ids, used = np.asarray(t.column("id")), -np.asarray(t.column("access_count").fill_null(0))
        order = np.lexsort((ids, used))
        ids, v = ids[order], _matrix(t.column("vector"))[order]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for _, members in _clustered(v, link, cfg.cluster_similarity):
            out.append((np.full(len(members), ids[members[0]]), ids[members]))
        cluster, member = (np.concatenate(c) for c in zip(*out)) if out else (ids[:0], ids[:0])
        return pa.table({"agent": pa.repeat(t.column("agent")[0], len(member)), "cluster": pa.array(cluster, pa.int64()), "id": pa.array(member, pa.int64())})

    agent = memories.schema["agent"].dataType.simpleString()
    return nodes.groupBy("agent").applyInArrow(greedy, f"agent {agent}, cluster long, id long")


def _clustered(v: np.ndarray, link, close: float, many: int = 64) -> Iterator[tuple[int, list[int]]]:
    """(seed, members) of clusters among vectors in order.  The seeds' products come ``many`` at a time with all free vectors."""
    free, start = np.arange(len(v)), 0
    taken = np.zeros(len(v), bool)
    while start < len(v):
        seeds = _next_free(taken, start, many)
        if not seeds:
            return
        free = free[~taken[free]]
        own = v[free]
        sims = np.clip(v[seeds] @ own.T, -1, 1)
        for seed, sim in zip(seeds, sims):
            if taken[seed]:
                continue
            near = np.flatnonzero(link(sim) & ~taken[free] & (free != seed))
            # similarity to the closest member, for those that are linked with every one
            at, most, vectors, members = free[near], sim[near], own[near], [int(seed)]
            while len(hit := np.flatnonzero(most >= close)):
                k = hit[0]  # those before it stood too far from the members so far and are past
                members.append(int(at[k]))
                s = np.clip(vectors[k + 1 :] @ vectors[k], -1, 1)
                keep = link(s)
                at, most, vectors = at[k + 1 :][keep], np.maximum(most[k + 1 :], s)[keep], vectors[k + 1 :][keep]
            if len(members) > 1:
                taken[members] = True
                yield int(seed), members
        start = int(seeds[-1]) + 1


def _next_free(taken: np.ndarray, start: int, many: int) -> list[int]:
    """The first ``many`` places from ``start`` on that are not taken."""
    width = many
    while True:
        found = start + np.flatnonzero(~taken[start : start + width])
        if len(found) >= many or start + width >= len(taken):
            return found[:many].tolist()
        width *= 2


def cluster_edges(members: DataFrame, memories: DataFrame, edges: DataFrame, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """Changes inside clusters: existing edges grow by use, missing ones start, at most a cycle's number."""
    m = members.join(memories.select("id", "access_count"), "id")
    pairs = m.join(m.select("cluster", F.col("id").alias("dst"), F.col("access_count").alias("n_dst")), "cluster").where("id < dst").select(F.col("id").alias("src"), "dst", S.access_factor("access_count", "n_dst").alias("af"))
    both = pairs.join(edges.select("src", "dst", "weight"), ["src", "dst"], "left")
    new = both.where("weight is null").orderBy(F.desc(F.round("af", 9)), "src", "dst").limit(cfg.max_new_edges).select("src", "dst", (cfg.new_edge_weight * F.col("af")).alias("weight"), F.lit("new").alias("change"))
    grown = both.where("weight is not null").select("src", "dst", S.strengthen("weight", cfg.edge_signal * F.col("af")).alias("weight"), F.lit("grown").alias("change"))
    return grown.unionByName(new)


def synthesis(memories: DataFrame, prefix: str, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """A summary per tag value that enough memories carry: size, frequent words and text, at most a cycle's number."""
    from palimpsest.operators.aggregates import term_counts
    from palimpsest.operators.search import tag_value

    own = memories.where("stage = 'active' and not retracted").withColumn("value", tag_value(prefix)).where("value is not null")
    sizes = own.groupBy("value").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")).where(F.col("n") >= cfg.synthesis_min).orderBy(F.desc("n"), "value").limit(cfg.synthesis_cap)
    words = term_counts(own.join(F.broadcast(sizes.select("value")), "value", "left_semi"), "value", 10)
    top = words.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda s: s.word).alias("words"))
    return sizes.join(top, "value", "left").select("value", "n", "confidence", F.concat(F.lit("Session "), F.col("value"), F.lit(": "), F.col("n").cast("string"), F.lit(" memories. Topics: "), F.array_join("words", ", ")).alias("content"))


def bridges(members: DataFrame, vectors: DataFrame, edges: DataFrame, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """The most similar pair of each two clusters of an agent, both ways, where no edge leads from one to the other."""
    own = vectors.select("agent", F.col("id").cast("long").alias("id"), "vector").join(members.select("id", F.col("cluster").cast("long").alias("cluster")), "id")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best pair of each two clusters in a product; the rest doesn't leave the task."""
        t = pa.Table.from_batches(batches)
        ids, cluster, agent = np.asarray(t.column("id")), np.asarray(t.column("cluster")), t.column("agent")[0]
        names, code = np.unique(cluster, return_inverse=True)
        best = np.full((len(names),) * 2, -2.0) if len(names) <= 2000 else None  # what a pair of clusters has reached: less can't win
        for x, y, value in _near(t, cfg.bridge_similarity):
            keep = (code[x] != code[y]) & (value > 0)
            if best is not None:
                keep &= value >= best[code[x], code[y]] - 1e-6
            x, y, value = x[keep], y[keep], value[keep]
            if best is not None:
                np.maximum.at(best, (code[x], code[y]), value)
                best = np.maximum(best, best.T)
            a, b, c1, c2 = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.minimum(cluster[x], cluster[y]), np.maximum(cluster[x], cluster[y])
            order = np.lexsort((b, a, -np.rint(value * 1e6), c2, c1))
            first = order[np.append(True, (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0))[: len(order)]]
            yield pa.RecordBatch.from_arrays([pa.repeat(agent, len(first)), *(pa.array(c[first]) for c in (c1, c2, a, b, value))], names=["agent", "c1", "c2", "a", "b", "similarity"])

    kind = vectors.schema["agent"].dataType.simpleString()
    found = _block_pairs(own, BLOCK).applyInArrow(multiply, f"agent {kind}, c1 long, c2 long, a long, b long, similarity double")
    best = found.groupBy("agent", "c1", "c2").agg(F.max_by(F.struct("a", "b", "similarity"), F.struct(F.round("similarity", 6), -F.col("a"), -F.col("b"))).alias("x")).select("x.*")
    top = best.orderBy(F.desc(F.round("similarity", 6)), "a", "b").limit(cfg.max_bridges)
    two = top.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "similarity"))).alias("e")).select("e.*")
    return two.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def faded(memories: DataFrame, as_of: Column, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """(id, agent, content): long, little used, long idle memories, cut short; at most a cycle's number per agent."""
    idle = S.days_between(as_of, F.col("last_accessed"))
    own = memories.where((F.col("stage") == "active") & ~F.col("retracted") & (F.col("access_count") >= 1) & (F.col("access_count") < cfg.fade_max_access) & (F.length("content") >= cfg.fade_min_chars) & (idle >= cfg.fade_days) & ~F.col("memory_class").isin("canonical", "structural"))
    w = Window.partitionBy("agent").orderBy(F.desc(F.round(idle, 6)), "id")
    return own.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cfg.fade_cap).select("id", "agent", T.fade(F.col("content"), cfg.fade_chars).alias("content"))


def forgotten(memories: DataFrame, edges: DataFrame, as_of: Column, cfg: ConsolidationConfig = CFG, cycles: int = 5) -> DataFrame:
    """Active memories to archive: idle beyond a time that use and confidence stretch, not protected
    by edges, past the days of grace, once enough cycles have run."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    own = memories.where("stage = 'active' and not retracted").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    bar = nearest_rank(own, "degree", 0.25, name="bar").select("bar")  # one row
    idle, age = S.days_between(as_of, F.col("last_accessed")), S.days_between(as_of, F.col("created_at"))
    rule = (age > cfg.grace_days) & (idle > S.archive_after_days("access_count", "confidence")) & (F.col("degree") <= F.col("bar"))
    return own.join(F.broadcast(bar)).where(rule & F.lit(cycles >= 5)).select("id", "agent", "degree")


def deleted(memories: DataFrame, edges: DataFrame, as_of: Column, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """Archived memories that nobody read, nothing links to, and that are old."""
    from palimpsest.operators.graph import endpoints

    old = memories.where((F.col("stage") == "archived") & (F.col("access_count") == 0) & (S.days_between(as_of, F.col("created_at")) > cfg.delete_days))
    return old.join(endpoints(edges).select("id").distinct(), "id", "left_anti").select("id", "agent")


def redundant(memories: DataFrame, vectors: DataFrame, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """(agent, id, kept): weak memories that a better one of the agent covers, at most a cycle's number.

    The order decides who survives, so the pass is greedy, one agent at a time: it holds the agent's vectors, and no pairs."""
    weak = memories.where("stage = 'active' and not retracted").select("agent", F.col("id").cast("long").alias("id"), "confidence", "access_count", (F.col("access_count") + 10 * F.col("confidence")).alias("value"))
    nodes = weak.join(vectors.select("id", "vector"), "id").select("agent", "id", "confidence", "access_count", "value", "vector")

    def greedy(t: pa.Table) -> pa.Table:
        ids, value = np.asarray(t.column("id")), np.asarray(t.column("value"))
        order = np.lexsort((ids, -value))
        ids, v = ids[order], _matrix(t.column("vector"))[order]
        left = np.flatnonzero((np.asarray(t.column("confidence"))[order] < 0.6) & (np.asarray(t.column("access_count"))[order] < 3))  # who may go
        kept = np.full(len(ids), -1)
        gone: list[int] = []
        for s in range(0, len(ids), 64):
            left = left[(kept[left] < 0) & (left > s)]
            if len(gone) >= cfg.redundancy_cap or not len(left):
                break
            near = np.round(np.clip(v[s : s + 64] @ v[left].T, -1, 1), 6) >= cfg.redundancy_similarity
            for i, row in enumerate(near, s):
                if kept[i] < 0:
                    new = left[row]
                    new = new[(kept[new] < 0) & (new > i)][: cfg.redundancy_cap - len(gone)]
                    kept[new] = i
                    gone += new.tolist()
        return pa.table({"agent": pa.repeat(t.column("agent")[0], len(gone)), "id": pa.array(ids[gone], pa.int64()), "kept": pa.array(ids[kept[gone]], pa.int64())})

    agent = memories.schema["agent"].dataType.simpleString()
    return nodes.groupBy("agent").applyInArrow(greedy, f"agent {agent}, id long, kept long")


def moved_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of removed memories at the ones kept for them: the heavier of two that fall together stays."""
    g = lambda c: gone.select(F.col("id").alias(c), F.col("kept").alias(f"k_{c}"))
    both = edges.join(g("src"), "src", "left").join(g("dst"), "dst", "left")
    return both.select(F.coalesce("k_src", "src").alias("src"), F.coalesce("k_dst", "dst").alias("dst"), "type", "weight").where("src != dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def merged_tags(memories: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, tags) of the kept memories with the tags of what they replace."""
    extra = gone.join(memories.select("id", F.col("tags").alias("t")), "id").groupBy(F.col("kept").alias("id")).agg(F.flatten(F.collect_list("t")).alias("extra"))
    return memories.join(extra, "id").select("id", F.array_sort(F.array_distinct(F.concat("tags", "extra"))).alias("tags"))


def drifted(memories: DataFrame, edges: DataFrame, clustered: DataFrame, as_of: Column, cfg: ConsolidationConfig = CFG) -> DataFrame:
    """(id, confidence): a little up in a cluster, down without edges and when long idle."""
    from palimpsest.operators.graph import endpoints

    linked = endpoints(edges).select("id").distinct().withColumn("linked", F.lit(True))
    inside = clustered.select("id").distinct().withColumn("inside", F.lit(True))
    own = memories.where("stage = 'active' and not retracted").join(linked, "id", "left").join(inside, "id", "left")
    idle = S.days_between(as_of, F.col("last_accessed"))
    step = F.when(F.col("inside"), 0.01).otherwise(0.0) - F.when(F.col("linked").isNull(), 0.02).otherwise(0.0) - F.when((idle > 30) & (F.col("confidence") > 0.3), 0.01).otherwise(0.0)
    step = F.greatest(F.lit(-cfg.drift_cap), F.least(F.lit(cfg.drift_cap), step))
    return own.select("id", F.when(step == 0, F.col("confidence")).otherwise(F.greatest(F.lit(0.15), F.least(F.lit(0.85), F.col("confidence") + step))).alias("confidence"))


def stale_working(memories: DataFrame, as_of: Column, protected: tuple[str, ...] = ()) -> DataFrame:
    """Working memories of little worth, hardly read and long idle."""
    idle = S.days_between(as_of, F.col("last_accessed"))
    out = memories.where((F.col("memory_class") == "working") & (F.col("salience") < 0.30) & (F.col("access_count") < 2) & (idle > 90) & F.col("superseded_by").isNull())
    return out.where(~F.col("agent").isin(*protected)) if protected else out


def without_ends(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges neither end of which is gone."""
    g = gone.select("id")
    return edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti")


