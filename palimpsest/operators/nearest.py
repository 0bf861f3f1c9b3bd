"""Nearest vectors of a table of queries: exactly, or by an inverted file.

The exact form multiplies blocks of queries with blocks of vectors and keeps each
query's best rows of a block, so what leaves a task is ``most`` rows a query.  The
inverted file deals vectors to lists around centroids, one folder each; a query meets
only the vectors in the folders of its ``probes`` nearest centroids.

Vectors are of unit length.  Null vectors and those of another length than the index has
are near to nothing; ties go to the smallest id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 16_384  # vectors of one product
QUERIES = 8_192  # queries of one product
PLACES = 5  # decimals by which similarities are ranked, unless said otherwise


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(similarity: np.ndarray, most: int, places: int) -> np.ndarray:
    """Columns of the ``most`` best of each row, by rounded similarity and then by id; columns stand in order of ids."""
    n = similarity.shape[1]
    key = np.rint(similarity * 10**places).astype(np.int64) * n - np.arange(n)  # no two alike in a row
    if n > 2 * most:
        near = np.argpartition(-key, most - 1, axis=1)[:, :most]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(key, near, 1), axis=1), 1)
    return np.argsort(-key, axis=1)[:, :most]


def _met(queries: DataFrame, vectors: DataFrame, most: int, floor: float | None, places: int = PLACES) -> DataFrame:
    """(query, id, similarity): the best of each query among the vectors of its ``list``.

    ``queries`` is (query, self, vector, list), ``vectors`` (id, vector, list).  Lists of more than a
    block are split, and so are the queries of a list; each two blocks meet in one task."""

    def dealt(df: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))  # a row per list
        return df.join(F.broadcast(n), "list").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), n

    left, lefts = dealt(queries, "query", QUERIES, "i")
    right, rights = dealt(vectors, "id", BLOCK, "j")
    every = lambda df, n, name: df.join(F.broadcast(n), "list").withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1))).drop(f"{name}s")

    def multiply(key, q, v):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and v.num_rows:
            v = v.sort_by("v_id")
            a, b, ids, own = _matrix(q.column("vector")), _matrix(v.column("v_vector")), np.asarray(v.column("v_id")), np.asarray(q.column("query"))
            itself = np.asarray(q.column("self").fill_null(np.iinfo(np.int64).min))
            for s in range(0, len(a), 256):
                sim = np.clip(a[s : s + 256] @ b.T, -1, 1)
                at = np.minimum(np.searchsorted(ids, itself[s : s + 256]), len(ids) - 1)
                same = np.flatnonzero(ids[at] == itself[s : s + 256])
                sim[same, at[same]] = -9
                best = _best(sim, min(most, len(ids)), places)
                value = np.take_along_axis(sim, best, 1)
                row, col = np.nonzero(value > (-2 if floor is None else floor))
                out.append((own[s : s + 256][row], ids[best[row, col]], value[row, col]))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query", "id", "similarity"), zip(*out))})

    l2 = every(left, rights, "j").groupBy("list", "i", "j")
    r2 = every(right, lefts, "i").toDF(*(f"v_{c}" for c in ("list", "id", "vector", "j", "i"))).groupBy("v_list", "v_i", "v_j")
    return _top(l2.cogroup(r2).applyInArrow(multiply, "query long, id long, similarity double"), most, places)


def _top(found: DataFrame, most: int, places: int) -> DataFrame:
    """(query, rank, id, similarity) of each query's best rows; Spark cuts each task's rows before they are shuffled."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", places)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query", "rank", "id", "similarity")


def _asked(queries: DataFrame) -> DataFrame:
    """(query, self, vector, list): ``self`` is an id that the query must not find, null for none."""
    own = queries.where("query is not null and vector is not null and size(vector) > 0")
    itself = F.col("self").cast("long") if "self" in queries.columns else F.lit(None).cast("long")
    return own.select(F.col("query").cast("long").alias("query"), itself.alias("self"), F.col("vector"), F.col("list") if "list" in queries.columns else F.lit(0).alias("list"))


def exact(queries: DataFrame, vectors: DataFrame, most: int = 10, floor: float | None = None, places: int = PLACES) -> DataFrame:
    """(query, rank, id, similarity) of the ``most`` nearest vectors of each query.  With a column ``list`` on both
    sides, such as an agent, a query meets only the vectors of its own."""
    v = vectors.where("id is not null and vector is not null and size(vector) > 0")
    v = v.select("list" if "list" in vectors.columns else F.lit(0).alias("list"), F.col("id").cast("long").alias("id"), "vector")
    return _met(_asked(queries).select("list", "query", "self", "vector"), v, most, floor, places)


# The inverted file.


def _nearest_list(centroids: np.ndarray, probes: int = 1):
    """A function of batches: the ``probes`` nearest lists of each row's vector, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros((0, probes), np.int32)
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column("vector")) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, max(1, near.shape[1]), dtype=np.int32)[: batch.num_rows + 1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    return run


def _sample(vectors: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most ``rows`` vectors, those with the least hash of their id."""
    n = vectors.count()
    h = F.xxhash64("id", F.lit(salt))
    share = (h.cast("double") / F.lit(2.0**64) + 0.5) * n <= 4.0 * rows  # the sort below sees a few times the sample
    return vectors.where(share).orderBy(h, "id").limit(rows)


def trained(vectors: DataFrame, lists: int, sample_rows: int = 100_000, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length by spherical k-means over at most ``sample_rows`` vectors; each round is one Spark job
    that returns a sum per list."""
    drawn = _sample(vectors, sample_rows, 1).persist()
    try:
        first = drawn.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(lists).select("vector").collect()  # ``lists`` rows
        centroids = np.array([r["vector"] for r in first], float).reshape(len(first), -1 if first else 0)
        for _ in range(rounds):

            def sums(batches: Iterator[pa.RecordBatch], c=centroids) -> Iterator[pa.RecordBatch]:
                total, many = np.zeros_like(c), np.zeros(len(c), np.int64)
                for batch in batches:
                    if batch.num_rows:
                        v = _matrix(batch.column("vector"))
                        own = (v @ c.T).argmax(1)
                        many += np.bincount(own, minlength=len(c))
                        np.add.at(total, own, v)
                some = np.flatnonzero(many)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "total"])

            rows = drawn.select("vector").mapInArrow(sums, "list int, total array<double>").collect()  # tasks x lists rows
            total = np.zeros_like(centroids)
            for r in sorted(rows, key=lambda r: (r["list"], r["total"])):
                total[r["list"]] += r["total"]
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            moved = np.where(norm > 0, total / np.maximum(norm, 1e-12), centroids)
            done, centroids = np.allclose(moved, centroids, atol=1e-6), moved
            if done:
                break
        return centroids
    finally:
        drawn.unpersist()


def store_lists(vectors: DataFrame, path: str, lists: int | None = None, recall: float = 0.95, at: int = 10, sample_rows: int = 100_000, asked: int = 64) -> int:
    """Write the inverted file of (id, vector) and return the probes that a query needs.

    Centroids are fitted on at most ``sample_rows`` vectors, every vector is indexed.  ``asked`` vectors of the table are
    then searched exactly: their ``at`` nearest others stand in lists whose place among the query's
    nearest centroids is known, so one pass tells the recall of every number of probes, and the least that
    reaches ``recall`` is stored."""
    spark = vectors.sparkSession
    own = vectors.where("id is not null and vector is not null and size(vector) > 0").select(F.col("id").cast("long").alias("id"), "vector")
    head = own.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("dims")).first()
    n, dims = head["n"], head["dims"] or 0
    own = own.where(F.size("vector") == dims)
    lists = max(1, min(n, lists or max(1, min(4096, int(n**0.5)))))
    centroids = trained(own, lists, sample_rows)
    kind = own.schema["vector"].dataType.simpleString()
    named = own.mapInArrow(_nearest_list(centroids), f"id long, vector {kind}, lists array<int>").select("id", "vector", F.col("lists")[0].alias("list"))
    spread = named.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))  # a list of many vectors is written by several tasks
    spread.write.partitionBy("list").parquet(f"{path}/vectors")
    stored = spark.read.schema(f"id long, vector {kind}, list int").parquet(f"{path}/vectors")
    some = _sample(own, asked, 3).select(F.col("id").alias("query"), F.col("id").alias("self"), "vector")
    found = exact(some, stored.select("id", "vector"), at).join(stored.select("id", "list"), "id")
    order = some.mapInArrow(_nearest_list(centroids, len(centroids)), f"query long, self long, vector {kind}, lists array<int>").select("query", "lists")
    places = [r[0] for r in found.join(order, "query").select(F.array_position("lists", F.col("list"))).collect()]  # asked x at numbers
    probes = int(np.sort(places)[min(len(places) - 1, int(np.ceil(recall * len(places))))]) if places else len(centroids)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").withColumn("probes", F.lit(probes)).coalesce(1).write.parquet(f"{path}/centroids")
    return probes


def probed(spark: SparkSession, path: str, queries: DataFrame, most: int = 10, probes: int | None = None, floor: float | None = None) -> DataFrame:
    """(query, rank, id, similarity) from the inverted file; only the folders of probed lists are read.

    ``probes`` of None takes what the index was found to need, and all lists make the search exact."""
    head = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # a row per list
    if not head:
        return queries.select(F.col("query").cast("long").alias("query"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("similarity")).limit(0)
    centroids = np.array([r["centroid"] for r in head])
    many = min(len(centroids), probes or head[0]["probes"])
    own = _asked(queries).where(F.size("vector") == centroids.shape[1]).drop("list")
    kind = own.schema["vector"].dataType.simpleString()
    at = own.mapInArrow(_nearest_list(centroids, many), f"query long, self long, vector {kind}, lists array<int>").select("query", "self", "vector", F.explode("lists").alias("list"))
    folders = [r[0] for r in at.select("list").distinct().collect()]  # at most the number of lists
    vectors = spark.read.schema(f"id long, vector {kind}, list int").parquet(f"{path}/vectors").where(F.col("list").isin(folders))
    return _met(at.select("list", "query", "self", "vector"), vectors.select("list", "id", "vector"), most, floor)


def recall_against(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true (query, id) pairs that were found."""
    hit = found.select("query", "id", F.lit(1).alias("hit"))
    return truth.select("query", "id").join(hit, ["query", "id"], "left").agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))
