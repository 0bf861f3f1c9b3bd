"""Scans, deterministic search, full text, vectors, and ranked views of tagged memories.

Every ordering ends with the id, so ties have one order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.vector import cosine

BROADCAST_IDS = 100_000  # ids looked up by a broadcast join at most


def by_agents(memories: DataFrame, agents: Sequence, stage: str | None = None, retracted: bool = False) -> DataFrame:
    out = memories.where(F.col("agent").isin(*agents)) if agents else memories.limit(0)
    out = out.where(F.col("stage") == stage) if stage else out
    return out if retracted else out.where(~F.col("retracted"))


def slim(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """id, agent, concept, vector: the columns that candidates are drawn from."""
    return memories.select("id", "agent", "concept", "stage", "retracted").join(embeddings.select("id", "vector"), "id", "left")


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories of an id table; broadcast only where it is small."""
    ids = ids.select("id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return memories.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def tags_all(tags: Iterable[str]) -> Column:
    out = F.lit(True)
    for t in tags:
        out = out & F.array_contains("tags", t)
    return F.coalesce(out, F.lit(False))


def tags_any(tags: Iterable[str]) -> Column:
    tags = list(tags)
    return F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)) if tags else F.lit(True)


def tags_none(tags: Iterable[str]) -> Column:
    tags = list(tags)
    return ~tags_any(tags) if tags else F.lit(True)


#: Sort keys of a search, and the columns they sort by.
SORT_KEYS = {"created_at": "created_at", "salience": "salience", "confidence": "confidence", "last_accessed": "last_accessed", "sequence": "sequence"}


def search(
    memories: DataFrame, text: str | None = None, concept: str | None = None, stage: str | None = None, retracted: bool | None = None,
    all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = (),
    sort: str = "created_at", descending: bool = True, limit: int | None = 50, offset: int = 0,
) -> DataFrame:
    """Deterministic search: every condition given must hold; retracted rows count unless excluded.
    Null sort keys come last in both directions."""
    out = memories
    if text is not None:
        low = F.lit(text.lower())
        out = out.where(F.contains(F.lower("content"), low) | F.contains(F.lower("concept"), low))
    if concept is not None:
        out = out.where(F.col("concept") == concept)
    if stage is not None:
        out = out.where(F.col("stage") == stage)
    if retracted is not None:
        out = out.where(F.col("retracted") == retracted)
    out = out.where(tags_all(all_of) & tags_any(any_of) & tags_none(none_of))
    key = F.col(SORT_KEYS[sort])
    out = out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def with_any_tag(memories: DataFrame, tags: Sequence[str], exclude: DataFrame | None = None) -> DataFrame:
    out = memories.where(~F.col("retracted") & tags_any(tags))
    return out.join(exclude.select("id"), "id", "left_anti") if exclude is not None else out


def active_by_concept(memories: DataFrame, concepts: DataFrame, all_of: Sequence[str] = ()) -> DataFrame:
    """For each asked (agent, concept): the newest active memory of that concept."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    live = memories.where((F.col("stage") == "active") & ~F.col("retracted") & F.col("superseded_by").isNull() & tags_all(all_of))
    asked = concepts.select(F.col("agent"), key("concept").alias("key")).distinct()
    both = live.withColumn("key", key("concept")).join(asked, ["agent", "key"])
    w = Window.partitionBy("agent", "key").orderBy(F.desc("created_at"), "id")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "key")


def tag_value(prefix: str) -> Column:
    """The value of the first tag with the prefix."""
    return F.substring(F.get(F.filter("tags", lambda t: t.startswith(prefix)), F.lit(0)), len(prefix) + 1, 1_000_000)


def latest_by_tag(memories: DataFrame, prefix: str, by: str = "created_at") -> DataFrame:
    """The newest active memory of each value of a tag, with the value."""
    live = memories.where((F.col("stage") == "active") & ~F.col("retracted")).withColumn("value", tag_value(prefix)).where("value is not null")
    live = live.where("sequence is not null") if by == "sequence" else live
    order = [F.desc(by), F.desc("created_at"), "id"]
    return live.withColumn("rn", F.row_number().over(Window.partitionBy("value").orderBy(*order))).where("rn = 1").drop("rn")


def top_by_tag(memories: DataFrame, prefix: str, limit: int = 50, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = ()) -> DataFrame:
    """Active memories by the number in a tag, largest first; what is no number comes last, an empty value is 0."""
    live = memories.where((F.col("stage") == "active") & ~F.col("retracted") & tags_all(all_of) & tags_any(any_of) & tags_none(none_of))
    value = tag_value(prefix)
    number = F.when(value == "", F.lit(0.0)).otherwise(F.expr("try_cast(value as double)"))
    return live.withColumn("value", value).where("value is not null").withColumn("number", number).orderBy(F.desc_nulls_last("number"), "id").limit(limit)


def effective_state(memories: DataFrame, resolving: Sequence[str] = ("resolves", "reopens", "abandons")) -> DataFrame:
    """For each memory that others refer to by a resolving type: the newest such reference.
    References are ``type:id`` strings in ``refs``."""
    refs = memories.where(~F.col("retracted")).select(F.col("id").alias("by"), "created_at", F.explode("refs").alias("ref"))
    refs = refs.select("by", "created_at", F.substring_index("ref", ":", 1).alias("state"), F.substring_index("ref", ":", -1).cast("long").alias("id")).where(F.col("state").isin(*resolving))
    last = refs.groupBy("id").agg(F.max_by(F.struct("state", "by"), F.struct("created_at", "by")).alias("x"))
    return memories.select("id").join(last, "id").select("id", F.col("x.state").alias("state"), F.col("x.by").alias("resolved_by"))


# Full text.

K1, B = 1.2, 0.75


def _text() -> Column:
    """Concept, content and tags."""
    return F.concat_ws(" ", "concept", "content", F.array_join("tags", " "))


def _indexed() -> Column:
    """The terms of concept, content and tags."""
    return T.index_terms(_text())


def postings(memories: DataFrame) -> DataFrame:
    """(id, len, term, tf) of concept, content and tags."""
    own = memories.select("id", _indexed().alias("w")).select("id", F.size("w").alias("len"), "w")
    return own.select("id", "len", F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def scanned(memories: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, len, tfs): of each memory the number of its terms, and (term, tf) of those that are asked for.

    A small row a memory: kept, it answers several searches by these terms with one look at the texts."""
    own = memories.select("id", _text().alias("text"))
    own = own.select("id", T.n_index_terms(F.col("text")).alias("len"), T.index_terms_among(F.col("text"), terms).alias("w"))
    tfs = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda w: w == t)).alias("tf")))
    return own.select("id", "len", tfs.alias("tfs"))


def query_terms(query: str) -> list[str]:
    return sorted({w for w in "".join(c if c.isascii() and (c.isalnum() or c == "_") or c in " \t\n\r\v\f" else " " for c in query.lower()).split() if len(w) > 1})


def _ranked(post: DataFrame, size: DataFrame, limit: int | None) -> DataFrame:
    """(id, bm25, score) from the asked terms' postings and the one row (n, mean)."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))  # at most one row per query term
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    both = post.join(F.broadcast(df), "term").join(F.broadcast(size)).groupBy("id").agg(F.sum(part).alias("bm25"))
    out = both.select("id", "bm25", (F.col("bm25") / (1 + F.col("bm25"))).alias("score"))
    return out if limit is None else out.orderBy(F.desc(F.round("bm25", 9)), "id").limit(limit)


def bm25(memories: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(id, bm25, score): Robertson's BM25 of any of the query's terms, and r / (1 + r), from the texts.

    One scan yields the collection's size and mean length, one the few postings of
    the query's terms; neither explodes whole texts.  ``indexed_bm25`` reads a stored index.
    """
    terms = query_terms(query)
    return scanned_bm25(scanned(memories, terms) if terms else memories, query, limit)


def scanned_bm25(own: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """As bm25, from what ``scanned`` yields for the query's terms, and maybe others."""
    terms = query_terms(query)
    if not terms:
        return own.select("id", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("score")).limit(0)
    size = own.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))  # one row
    post = own.select("id", "len", F.explode(F.filter("tfs", lambda x: x["term"].isin(*terms))).alias("x"))
    return _ranked(post.groupBy("id", "len", F.col("x.term").alias("term")).agg(F.sum("x.tf").alias("tf")), size, limit)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def store_index(memories: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the inverted index: postings in folders by a hash of the term, sorted by term, and one
    row with the number of memories and their mean length.  Filters of rows or agents go before it."""
    spread = postings(memories).withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)))
    spread.repartition("bucket", "salt").drop("salt").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    memories.select(F.size(_indexed()).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/size")


def indexed_bm25(spark, path: str, query: str, limit: int | None = None) -> DataFrame:
    """As bm25, from a stored index: only the folders and row groups of the asked terms are read."""
    size = spark.read.parquet(f"{path}/size")
    terms, buckets = query_terms(query), size.first()["buckets"]
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), buckets)).distinct().collect()]
    post = spark.read.schema("id long, len int, term string, tf long, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(folders) & F.col("term").isin(terms)) if terms else None
    if post is None:
        return size.select(F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("bm25"), F.lit(0.0).alias("score")).limit(0)
    return _ranked(post.drop("bucket"), size.drop("buckets"), limit)


def bm25_top_then_join(memories: DataFrame, query: str, agents: Sequence, limit: int = 10, strict_inner_limit: bool = False) -> DataFrame:
    """Top-N of the index, then the rows: with ``strict_inner_limit`` the cut comes before the
    agent filter, as an index over all agents has it; else the filter comes first."""
    inner = max(5 * limit, 50)
    live = memories.where(~F.col("retracted") & F.col("agent").isin(*agents))
    hits = bm25(memories if strict_inner_limit else live, query, inner)
    return hits.join(live, "id").orderBy(F.desc(F.round("bm25", 9)), "id").limit(limit)


# Vectors.


def vector_top(memories: DataFrame, embeddings: DataFrame, query: Sequence[float], limit: int = 50, floor: float | None = None, stages: Sequence[str] = ("active", "fading")) -> DataFrame:
    """(id, similarity) of the nearest live memories; the top-k needs no shuffle of vectors."""
    live = memories.where(~F.col("retracted") & F.col("stage").isin(*stages)).select("id")
    sims = embeddings.select("id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    out = sims.join(live, "id", "left_semi")
    out = out.where(F.col("similarity") > floor) if floor is not None else out
    return out.orderBy(F.desc(F.round("similarity", 5)), "id").limit(limit)


def hybrid_candidates(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """(id, score, similarity) of both candidate sets."""
    return text_hits.select("id", "score").join(vector_hits.select("id", "similarity"), "id", "full_outer").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), "similarity")


def merged_text_hits(*passes: DataFrame) -> DataFrame:
    """Several text passes, the best score of each id."""
    out = passes[0].select("id", "score")
    for p in passes[1:]:
        out = out.unionByName(p.select("id", "score"))
    return out.groupBy("id").agg(F.max("score").alias("score"))
