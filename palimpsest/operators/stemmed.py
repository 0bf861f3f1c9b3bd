"""Stemmed full text with cover-density ranking.

The stemmer runs once a word in each task.  The index holds, for
each stem and memory, the places of the stem among the memory's words; words that are left out
keep their place.  A cover is a shortest stretch that satisfies the query: of any of its stems,
one place; of all of them, a stretch with each.  It adds .1, divided by one more than
the words in it that are not the query's.

Defined results: null texts have no words; a query of words that are left out finds nothing; ties go to
the smallest id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.stems import STOP, stem
from palimpsest.operators.search import _bucket

WEIGHT = 0.1  # fixed: of a place without a label
MOST_WORDS = 500_000  # distinct words whose stems a task remembers at most


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"(?U)[^\w]", " ")), r"\s+"), lambda w: w != "")


def _text() -> Column:
    return F.concat_ws(" ", "concept", "content", F.array_join("tags", " "))


def stem_table(memories: DataFrame) -> DataFrame:
    """(word, stem) of every distinct word that is not left out."""
    words = memories.select(F.explode(F.array_distinct(_words(_text()))).alias("word")).where(~F.col("word").isin(*STOP)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array(list(map(stem, words.to_pylist())), pa.string())], names=["word", "stem"])

    return words.mapInArrow(run, "word string, stem string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["id", "agent", "stem", "places"])


def store_stemmed(memories: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the stem table, and postings (agent, id, stem, places) in folders by a hash of the stem."""
    spark = memories.sparkSession
    stem_table(memories).write.parquet(f"{path}/stems")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = dict.fromkeys(STOP)  # of one task
        for batch in batches:
            rows: list[tuple] = []
            for i, agent, words in zip(*(batch.column(c).to_pylist() for c in ("id", "agent", "w"))):
                places: dict[str, list[int]] = {}
                for place, word in enumerate(words or ()):
                    if word not in known:
                        if len(known) > MOST_WORDS:
                            known = dict.fromkeys(STOP)
                        known[word] = stem(word)
                    if known[word] is not None:
                        places.setdefault(known[word], []).append(place)
                rows += [(i, agent, s, p) for s, p in places.items()]
                if len(rows) > 100_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    # a memory's words lie in one row, so its postings are made without a shuffle
    own = memories.select(F.col("id").cast("long").alias("id"), F.col("agent").cast("string").alias("agent"), _words(_text()).alias("w"))
    post = own.mapInArrow(run, "id long, agent string, stem string, places array<int>")
    post = post.withColumn("bucket", _bucket(F.col("stem"), buckets))
    spread = post.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "stem", "id")
    spread.write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/size")


def query_stems(query: str) -> list[str]:
    """Distinct stems of the query's words of two letters or more that are not left out."""
    import re

    return sorted({stem(w) for w in re.sub(r"[^\w\s]", " ", query).lower().split() if len(w) > 1 and w not in STOP})


def cover_density(places: list[np.ndarray], every: bool) -> float:
    """The rank of one memory from the ascending places of each of the query's stems that it holds."""
    if not every:
        return WEIGHT * len(np.unique(np.concatenate(places)))
    place = np.concatenate(places)
    which = np.repeat(np.arange(len(places)), [len(p) for p in places])
    order = np.argsort(place, kind="stable")
    place, which = place[order], which[order]
    # the latest start at or before each place from which every stem occurs
    last = np.full((len(places), len(place)), -1)
    for k in range(len(places)):
        last[k] = np.maximum.accumulate(np.where(which == k, np.arange(len(place)), -1))
    start = last.min(0)
    ends = np.flatnonzero(start >= 0)
    ends = ends[np.concatenate([[True], start[ends][1:] != start[ends][:-1]])] if len(ends) else ends  # of one start the first end
    start = start[ends]
    noise = (place[ends] - place[start]) - (ends - start)
    return float(np.sum(WEIGHT / (1 + noise)))


def stemmed_search(spark: SparkSession, path: str, query: str, agents: list | None = None, every: bool = False, limit: int | None = None, half: float | None = None) -> DataFrame:
    """(id, rank, score) of memories with any of the query's stems, or with all of them; only the folders
    and row groups of the asked stems are read.  With ``half`` the score is rank / (rank + half), else the rank."""
    stems = query_stems(query)
    none = spark.createDataFrame([], "id long, rank double, score double")
    if not stems:
        return none
    buckets = spark.read.parquet(f"{path}/size").first()["buckets"]
    folders = [r[0] for r in spark.createDataFrame([(s,) for s in stems], "s string").select(_bucket(F.col("s"), buckets)).distinct().collect()]
    post = spark.read.schema("id long, agent string, stem string, places array<int>, bucket int").parquet(f"{path}/postings")
    post = post.where(F.col("bucket").isin(folders) & F.col("stem").isin(stems))
    post = post.where(F.col("agent").isin(*agents)) if agents else post
    if not every:
        found = post.groupBy("id").agg((WEIGHT * F.sum(F.size("places"))).alias("rank"))  # a place holds one stem
    else:
        held = post.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("stem", "places"))).alias("x")).where(F.size("x") == len(stems))

        @F.pandas_udf("double")
        def density(x):
            return x.map(lambda lists: cover_density([np.asarray(p) for p in lists], True))

        found = held.select("id", density(F.transform("x", lambda s: s.places)).alias("rank"))
    out = found.withColumn("score", F.col("rank") / (F.col("rank") + half) if half else F.col("rank"))
    return out if limit is None else out.orderBy(F.desc(F.round("rank", 9)), "id").limit(limit)
