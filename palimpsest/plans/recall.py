"""The hybrid retrieval query.

Text hits and vector hits are cut first, on the index side; everything after works
on a pool of a few hundred rows joined to their memories.  Query-side values (tokens,
vector, mode) are literals, so the plan has no Python in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import MODES, RecallConfig
from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vector as V
from palimpsest.operators import graph, models, search, windows


def pinned(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of a cut pool as a local table: what follows refers to them
    several times, and would else run the searches again each time."""
    return df.sparkSession.createDataFrame(df.limit(most).collect(), df.schema)


def edges_at(edges: DataFrame | Callable[[list], DataFrame], ids: list) -> DataFrame:
    """Edges with an end among a few ids.  The ids are literals, so the filter reaches the
    edge table's scan or aggregation, and the few edges left are kept while they are in use.
    A function yields those of given ids by itself, where that takes less than the whole table."""
    own = edges(ids) if callable(edges) else edges
    return own.where(F.col("src").isin(ids) | F.col("dst").isin(ids)).persist()


def query_mode(spark, text: str) -> str:
    return spark.range(1).select(T.classify_query(F.lit(text)).alias("m")).first()[0]


def expanded_query(memories: DataFrame, text: str) -> str:
    """A query with a pronoun gets five tags of the ten most used active memories."""
    import re

    if not re.search(r"(?i)\b(she|he|they|her|his|him|their|it|that|this|there)\b", text):
        return text
    top = memories.where("stage = 'active' and not retracted").orderBy(F.desc("access_count"), "id").limit(10).select("id", F.col("access_count").alias("n"), "tags").collect()
    tags = dict.fromkeys(t for r in top for t in r["tags"] or [] if len(t) >= 3 and not re.match(r"session-|low-|D\d", t))
    return " ".join([text, *list(tags)[:5]])


def found(live: DataFrame, text: str, most: int, index: str | None = None, scan: DataFrame | None = None) -> DataFrame:
    """The best by BM25, from an index of these memories, from a scan of their texts for the terms, or from the texts."""
    if scan is not None:
        return search.scanned_bm25(scan, text, most)
    return search.bm25(live, text, most) if index is None else search.indexed_bm25(live.sparkSession, index, text, most)


def scan_for(live: DataFrame, texts: Sequence[str], index: str | None = None) -> DataFrame | None:
    """The scan that searches by these texts share, kept while it is in use; none where an index is read or nothing is asked."""
    terms = search.query_terms(" ".join(texts))
    return search.scanned(live, terms).persist() if index is None and terms else None


def text_hits(live: DataFrame, scope: DataFrame, text: str, most: int, index: str | None = None, expanded: str | None = None, scan: DataFrame | None = None) -> DataFrame:
    """(id, score): the best of two passes, by the query's keywords and by the query with what its pronouns may mean."""
    expanded = expanded_query(scope, text) if expanded is None else expanded
    keywords = " ".join(dict.fromkeys(w for w in text.lower().split() if len(w) > 2 and w not in T.STOPWORDS))
    passes = [found(live, q, most, index, scan) for q in dict.fromkeys([keywords, expanded]) if len(q) > 2 or q != keywords]
    return search.merged_text_hits(*passes or [found(live, text, most, index, scan)])


def scored(candidates: DataFrame, memories: DataFrame, edges: DataFrame, text: str | Column, as_of: Column, mode: str = "balanced") -> DataFrame:
    """Candidates (id, score, similarity) with every part of their score; ``text`` may be a column of theirs."""
    stats = graph.edge_stats(edges, candidates if isinstance(text, str) else candidates.select("id").distinct())
    own = candidates.join(memories, "id").join(stats, "id")
    return scored_tokens(own, T.tokens(F.lit(text)), T.tokens(F.col("concept")), T.tokens(F.col("content")), as_of, mode)


def scored_tokens(own: DataFrame, words: Column, concept: Column, content: Column, as_of: Column, mode: str = "balanced") -> DataFrame:
    """As scored, of candidates with their memory's columns and links (n, sum_weight), from the tokens of query, concept and content."""
    m = MODES[mode]
    own = own.withColumn("keyword_match", F.least(F.lit(1.0), F.greatest(F.col("score"), T.keyword_score(words, concept, content)) + 0.3 * T.concept_overlap(words, concept)))
    own = own.withColumn("vector_match", S.vector_match("similarity", 0.5 if m.gate > 0.5 else 0.35))
    own = own.withColumn("text_match", S.text_match("keyword_match", "vector_match"))
    age = S.days_between(as_of, F.col("created_at"))
    own = own.withColumn("decay", S.base_level("access_count", age, S.decay_exponent(m.decay, "confidence", "access_count")))
    own = own.withColumn("hebbian", F.when(F.col("n") > 0, F.least(F.col("sum_weight") / F.col("n"), F.lit(0.5))).otherwise(0.0))
    temporal = F.least(S.softplus(F.col("decay") + F.col("hebbian")), F.lit(3.0)) / 3
    own = own.withColumn("composite", S.gated_composite("text_match", temporal, S.centrality("n", "sum_weight"), S.feedback_bonus("confidence"), "confidence", m.text, m.temporal))
    return own.withColumn("graph_boost", F.lit(0.0))


def feedback_terms(pool: DataFrame, text: str, top: int = 3, most: int = 5) -> list[str]:
    """New words of the best rows, in order, of those of them that match: a handful of rows on the driver."""
    rows = [r for r in pool.orderBy(F.desc(F.round("composite", 9)), "id").limit(top).select("content", "text_match").collect() if r["text_match"] > 0.1]
    asked = {w for w in text.lower().split()}
    out: dict[str, None] = {}
    for r in rows:
        for w in (r["content"] or "").lower().split():
            if len(w) >= 4 and w not in asked and w not in T.STOPWORDS:
                out[w] = None
    return list(out)[:most]


def added(late: DataFrame, as_of: Column, mode: str) -> DataFrame:
    """The composites of rows that feedback adds: at the default decay, with their links' strength but without centrality and
    bonus.  Their own similarity counts as a match; the gate's largest cosine is that of the first candidates alone."""
    out = late.withColumn("decay", S.base_level("access_count", S.days_between(as_of, F.col("created_at"))))
    temporal = F.least(S.softplus(F.col("decay") + F.col("hebbian")), F.lit(3.0)) / 3
    m = MODES[mode]
    out = out.withColumn("composite", S.gated_composite("text_match", temporal, 0.0, 0.0, "confidence", m.text, m.temporal))
    return out.withColumn("similarity", F.lit(None).cast("double"))


def _beside(df: DataFrame, one: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows with the one row of their group, or of all."""
    return df.join(one, [*by]) if by else df.join(F.broadcast(one))


def _best_first(by: tuple[str, ...], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order))


def bridged(pool: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The pool with boosts for entity tags shared with the two best text matches, the anchors; the further a row's own match is
    below the best one, the more.  Anchors gain nothing.

    Tags on more than 30 % of a pool of over ten say nothing.  With columns ``by`` every value has a pool of its own."""
    tags = pool.select(*by, "id", "text_match", F.explode(F.transform("tags", F.lower)).alias("tag"))
    tags = tags.where(~F.col("tag").rlike(r"^(t\d+|session-.*|dia_.*|speaker\d*|cat:.*)$") & (F.length("tag") >= 3)).distinct()
    size = pool.groupBy(*by).agg(F.count("*").alias("size"))
    df = _beside(tags.groupBy(*by, "tag").agg(F.count("*").alias("df")), size, by).where("size <= 10 or df <= 0.3 * size").select(*by, "tag")
    anchors = pool.where("text_match > 0.15").withColumn("rn", _best_first(by, F.desc("text_match"), "id")).where("rn <= 2")
    asked = anchors.select(*by, F.explode(F.transform("tags", F.lower)).alias("tag")).distinct()
    best = anchors.groupBy(*by).agg(F.max("text_match").alias("best"))
    shared = asked.join(df, [*by, "tag"]).join(tags, [*by, "tag"]).groupBy(*by, "id").agg(F.count("*").alias("k")).join(anchors.select(*by, "id"), [*by, "id"], "left_anti")
    gap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("best") - F.col("text_match")) / F.col("best")))
    boost = _beside(shared.join(pool.select(*by, "id", "text_match"), [*by, "id"]), best, by).select(*by, "id", (F.least(F.lit(0.4), 0.15 * F.col("k")) * gap).alias("b"))
    out = pool.join(boost, [*by, "id"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    return out.withColumn("composite", F.col("composite") + F.col("b")).withColumn("graph_boost", F.col("graph_boost") + F.col("b")).drop("b")


def walked(pool: DataFrame, edges: DataFrame, mode: str, by: tuple[str, ...] = ()) -> DataFrame:
    m = MODES[mode]
    boosts = graph.beam_walk(pool.select(*by, "id", F.col("composite").alias("score"), "text_match", "graph_boost"), edges, m.beam, m.hop, by)
    out = pool.join(boosts, [*by, "id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("composite", F.col("composite") + F.col("boost")).withColumn("graph_boost", F.col("graph_boost") + F.col("boost")).drop("boost")


def _sure(pool: DataFrame, cfg: RecallConfig, by: tuple[str, ...]) -> DataFrame:
    """The pool with its best text match (top), and with whether its first row is a clear winner (skip)."""
    order = F.sort_array(F.collect_list(F.struct((-F.round("composite", 9)).alias("o"), "id", "composite", "text_match")))
    top = pool.groupBy(*by).agg(F.max("text_match").alias("top"), order.alias("first"))  # the pool is cut before: a few dozen rows
    one, two = F.get("first", F.lit(0)), F.get("first", F.lit(1))
    clear = (F.size("first") >= 2) & (F.size("first") <= max(2 * cfg.limit, 20)) & (one["text_match"] >= 0.8)
    clear &= one["composite"] >= 1.5 * F.greatest(two["composite"], F.lit(0.01))
    return _beside(pool, top.select(*by, "top", (F.coalesce(clear, F.lit(False)) if cfg.rerank_skip else F.lit(False)).alias("skip")), by)


def reranked(pool: DataFrame, text: str | Column, scorer: models.Slot, cfg: RecallConfig = RecallConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """The pool with the scorer's score of the query and each row's concept and first characters (rerank).
    Rows of a pool with a clear winner are not put to the model."""
    own = _sure(pool, cfg, by)
    asked = F.when(~F.col("skip"), models.passage(F.col("concept"), F.col("content")))
    return own.withColumn("rerank", models.pair_score(scorer, F.lit(text), asked)).drop("top", "skip")


def blended(pool: DataFrame, rerank: str | None = None, cfg: RecallConfig = RecallConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Composite and reranker score by how sure the text match is; without a reranker, the composite.

    With ``cfg.rerank_skip`` a small pool whose first row is a clear winner keeps its composites, its reranker scores are 0."""
    if rerank is None:
        return pool.withColumn("final", F.col("composite")).withColumn("reranker", F.lit(0.0))
    w = F.when(F.col("skip"), 0.0).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(0.7), 0.3 + 0.4 * (1 - F.col("top")))))
    out = _sure(pool, cfg, by).withColumn("reranker", F.when(F.col("skip"), 0.0).otherwise(F.col(rerank)))
    return out.withColumn("final", (1 - w) * F.col("composite") + w * F.col("reranker")).drop("top", "skip")


def gated(pool: DataFrame, cfg: RecallConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Weak pools are damped or refused: few agreeing channels in the first five, or no margin; with ``cfg.abstain``
    also by the best reranker scores and their spread."""
    ranked = pool.withColumn("rn", _best_first(by, F.desc(F.round("final", 9)), "id"))  # the pool is cut before: a few dozen rows
    five = F.col("rn") <= 5
    stats = ranked.groupBy(*by).agg(
        F.count("*").alias("size"),
        sum((F.coalesce(F.max((five & (F.col(c) > least)).cast("int")), F.lit(0)) for c, least in (("score", 0.3), ("vector_match", 0.05), ("reranker", 0.25))), F.lit(0)).alias("channels"),
        F.coalesce(F.max("similarity"), F.lit(1.0)).alias("max_cosine"),
        F.slice(F.sort_array(F.collect_list(F.when(five, F.col("reranker"))), asc=False), 1, 2).alias("two"),
        F.slice(F.sort_array(F.collect_list("reranker"), asc=False), 1, 5).alias("best"),
    )
    stats = stats.withColumn("margin", F.get("two", F.lit(0)) - F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))).drop("two")
    mean = F.aggregate("best", F.lit(0.0), lambda s, x: s + x) / F.size("best")
    stats = stats.withColumn("top", F.get("best", F.lit(0))).withColumn("mean", mean).withColumn("variance", F.aggregate("best", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("best")).drop("best", "mean")
    out = _beside(ranked, stats, by)
    weak = (F.col("size") >= 3) & ((F.col("channels") < 2) | (F.col("margin") < 0.05))
    floor = 0.5 if MODES[cfg.mode].gate > 0.5 else 0.35
    refused = (F.col("size") >= 3) & (F.col("channels") < (3 if cfg.abstain > 0 else 2)) & (F.col("max_cosine") < floor)
    if cfg.abstain > 0:
        refused |= weak | ((F.col("size") >= 3) & ((F.col("top") < cfg.abstain) | ((F.col("top") < 0.5) & (F.col("variance") < 0.01))))
    out = out.where(~refused)
    if cfg.abstain <= 0 and cfg.weak_pool_penalty:
        out = out.withColumn("final", F.when(weak, F.col("final") * 0.4).otherwise(F.col("final")))
    return out.drop("rn", "size", "channels", "max_cosine", "margin", "top", "variance")


def in_scope(memories: DataFrame, cfg: RecallConfig, agents: Sequence | None = None) -> DataFrame:
    """The memories that a query may return."""
    live = memories if cfg.include_retracted else memories.where(~F.col("retracted"))
    live = live.where(F.col("stage").isin(*cfg.include_stages))
    live = live.where(F.col("agent").isin(*agents)) if agents else live
    return live.where(F.col("memory_type") == cfg.memory_type) if cfg.memory_type else live


def recall(memories: DataFrame, edges: DataFrame | Callable[[list], DataFrame], embeddings: DataFrame | None, text: str, as_of: Column, vector: Sequence[float] | None = None, cfg: RecallConfig = RecallConfig(), agents: Sequence | None = None, scorer: models.Slot | None = None, index: str | None = None) -> DataFrame:
    """The ranked memories for a query: id, concept, content, final score and its parts.

    ``scorer`` reranks the pool.  ``index`` is a store_index of the same memories in scope (``stored_index``); without one
    the texts are searched, once for each round.  ``edges`` may be a function that yields the edges at given ids."""
    mode = query_mode(memories.sparkSession, text) if cfg.mode == "auto" else cfg.mode
    cfg = replace(cfg, mode=mode)
    live = in_scope(memories, cfg, agents)
    expanded = expanded_query(memories.where(F.col("agent").isin(*agents)) if agents else memories, text)
    scan = scan_for(live, [text, expanded], index)
    hits = text_hits(live, memories, text, 3 * cfg.limit, index, expanded, scan)
    if vector is not None and embeddings is not None:
        near = search.vector_top(live, embeddings, vector, max(50, 5 * cfg.limit), 0.40 if MODES[mode].gate > 0.5 else 0.30, cfg.include_stages)
        candidates = search.hybrid_candidates(hits, near)
    else:
        candidates = hits.select("id", "score", F.lit(None).cast("double").alias("similarity"))
    candidates = pinned(candidates, 6 * cfg.limit + max(50, 5 * cfg.limit))
    if scan is not None:
        scan.unpersist()
    ids = [r["id"] for r in candidates.select("id").collect()]
    near = edges_at(edges, ids)
    pool = pinned(scored(candidates, live.where(F.col("id").isin(ids)), near, text, as_of, mode), 6 * cfg.limit + max(50, 5 * cfg.limit))
    extra = feedback_terms(pool, text)
    if extra:
        scan = scan_for(live, [expanded, *extra], index)
        more = pinned(found(live, " ".join([expanded, *extra]), 2 * cfg.limit, index, scan).where(~F.col("id").isin(ids)).select("id", "score"), 2 * cfg.limit)
        if scan is not None:
            scan.unpersist()
        late_ids = [r["id"] for r in more.select("id").collect()]
        if late_ids:
            near.unpersist()
            near = edges_at(edges, ids + late_ids)
        if vector is not None and embeddings is not None:
            asked = F.array(*[F.lit(float(x)) for x in vector])
            own = embeddings.where(F.col("id").isin(late_ids)).select("id", V.cosine(F.col("vector"), asked).alias("similarity"))
            more = more.join(own, "id", "left")
        else:
            more = more.withColumn("similarity", F.lit(None).cast("double"))
        late = added(scored(more, live.where(F.col("id").isin(late_ids)), near, text, as_of, mode), as_of, mode)
        pool = pool.unionByName(late)
    pool = bridged(pinned(pool, 8 * cfg.limit + max(50, 5 * cfg.limit)))
    pool = query_bridged(pool, text) if cfg.query_bridge else pool
    pool = pinned(pool.orderBy(F.desc(F.round("composite", 9)), "id"), 8 * cfg.limit)
    pool = walked(pool, near, mode).where(F.col("composite") >= cfg.min_score)
    pool = pinned(pool.orderBy(F.desc(F.round("composite", 9)), "id"), max(4 * cfg.limit, 40))
    near.unpersist()
    if scorer is not None:
        pool = pinned(reranked(pool, text, scorer, cfg), max(4 * cfg.limit, 40))
    out = finished(gated(blended(pool, "rerank" if scorer else None, cfg), cfg), cfg)
    return out.orderBy(F.desc(F.round("final", 9)), "id").limit(cfg.limit)


def stored_index(memories: DataFrame, path: str, cfg: RecallConfig = RecallConfig(), agents: Sequence | None = None) -> None:
    """The index that recall reads, of the memories that ``cfg`` and ``agents`` let it return."""
    search.store_index(in_scope(memories, cfg, agents), path)


def finished(pool: DataFrame, cfg: RecallConfig, by: tuple[str, ...] = (), texts: tuple[str, ...] = ("concept", "content")) -> DataFrame:
    """The pool's final scores and why, with the recall's confidence; none of it where that is below ``cfg.require_confidence``.

    What was superseded keeps .15 of its score.  Confidence comes from the ten best scores."""
    out = pool.withColumn("final", F.when(F.col("superseded_by").isNotNull(), F.col("final") * 0.15).otherwise(F.col("final")))
    out = out.withColumn("rn", _best_first(by, F.desc(F.round("final", 9)), "id"))
    key = by[0] if by else "__all"
    sure = windows.recall_confidence(out if by else out.withColumn(key, F.lit(1)), key, "final", "rn").select(key, "confidence")
    out = _beside(out.drop("confidence"), sure if by else sure.drop(key), by)
    if cfg.require_confidence > 0:
        out = out.where(F.col("confidence") >= cfg.require_confidence)
    why = T.explain({"text": F.col("text_match"), "vector": F.col("vector_match"), "links": F.col("hebbian"), "graph": F.col("graph_boost")})
    return out.where(F.col("rn") <= cfg.limit).select(*by, "id", "agent", *texts, "final", "text_match", "vector_match", "decay", "hebbian", "graph_boost", "composite", why.alias("why"), F.col("confidence").alias("recall_confidence"))


def side_effects(results: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, confidence, access_count) of what a recall touched."""
    return memories.join(results.select("id"), "id", "left_semi").select("id", S.touched_confidence("confidence", "access_count").alias("confidence"), (F.col("access_count") + 1).alias("access_count"))


def query_bridged(pool: DataFrame, text: str | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The pool with the boosts of entity_bridged."""
    out = pool.join(entity_bridged(pool, text, by), [*by, "id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("composite", F.col("composite") + F.col("boost")).withColumn("graph_boost", F.col("graph_boost") + F.col("boost")).drop("boost")


def entity_bridged(pool: DataFrame, text: str | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, boost) of pool rows with tags that name an entity of the query: the whole tag, what follows ``entity:``, or a word of that."""
    names = T.query_entities(F.lit(text))
    value = lambda t: F.regexp_replace(F.lower(t), "^entity:", "")
    named = lambda t: F.array_contains(names, value(t)) | F.arrays_overlap(F.split(value(t), r"\s+"), names)
    hits = F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), named))
    return pool.where("text_match >= 0.1").select(*by, "id", F.least(F.lit(0.4), hits * 0.4 * F.col("text_match")).alias("boost")).where("boost > 0")
