"""Exports, imports, merges, transcripts, logs and versioned snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exported(memories: DataFrame, edges: DataFrame, agent: str | None = None, active_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Memories without vectors, in order of creation, and the edges whose both ends are among them."""
    own = memories.where(F.col("agent") == agent) if agent is not None else memories
    own = own.where(~F.col("retracted")) if active_only else own
    ids = own.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return own.drop("vector").orderBy("created_at", "id"), inner


def export_json(memories: DataFrame, edges: DataFrame, folder: str, **filters) -> None:
    own, inner = exported(memories, edges, **filters)
    own.write.mode("errorifexists").json(f"{folder}/memories")
    inner.write.mode("errorifexists").json(f"{folder}/edges")


def content_key(concept: str = "concept", content: str = "content"):
    return F.sha2(F.lower(F.trim(F.concat(F.col(concept), F.lit("\n"), F.col(content)))), 256)


def merged(target: DataFrame, sources: Sequence[DataFrame], remap: dict[str, str] | None = None) -> DataFrame:
    """The rows of the sources that the target lacks, by hash of concept and content; the first source wins."""
    every = None
    for i, s in enumerate(sources):
        rows = s.where(~F.col("retracted")).withColumn("source_no", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    if remap:
        agent = F.col("agent")
        for old, new in remap.items():
            agent = F.when(F.col("agent") == old, new).otherwise(agent)
        every = every.withColumn("agent", agent)
    keyed = every.withColumn("key", content_key()).join(target.select(content_key().alias("key")), "key", "left_anti")
    first = keyed.groupBy("key").agg(F.min(F.struct("source_no", "id")).alias("f"))
    return keyed.join(first, "key").where((F.col("source_no") == F.col("f.source_no")) & (F.col("id") == F.col("f.id"))).drop("f")


def imported(target: DataFrame, memories: DataFrame, edges: DataFrame, agent: str | None = None, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) to add, under new ids after the target's largest; edges to skipped memories go."""
    new = memories.where(~F.col("retracted"))
    new = new.withColumn("agent", F.lit(agent)) if agent is not None else new
    new = merged(target, [new]).drop("key", "source_no") if dedupe else new
    top = target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # ids are numbered within ranges of the old ids, so no task sees all rows
    ranged = new.repartitionByRange("id").select("id", F.spark_partition_id().alias("p")).withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("id")))
    ranged = ranged.persist()
    before = ranged.groupBy("p").agg(F.count("*").alias("c")).withColumn("start", F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    ids = ranged.join(F.broadcast(before), "p").join(F.broadcast(top)).select("id", (F.col("top") + F.coalesce("start", F.lit(0)) + F.col("k")).alias("new_id"))
    rows = new.join(ids, "id").drop("id").withColumnRenamed("new_id", "id")
    e = edges.join(ids.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("new_id").alias("d")), "dst")
    return rows, e.drop("src", "dst").withColumnRenamed("s", "src").withColumnRenamed("d", "dst")


def transcript_summary(lines: DataFrame, last: int = 100) -> DataFrame:
    """(session, last_user, files, tools) from transcript lines (session, line_no, role, text, file, tool)."""
    w = Window.partitionBy("session").orderBy(F.desc("line_no"))
    own = lines.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    newest = lambda c, n: F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("rn", c)))), lambda s: s[c])), 1, n)
    return own.groupBy("session").agg(
        F.substring(F.min_by("text", F.when(F.col("role") == "user", F.col("rn"))), 1, 200).alias("last_user"), newest("file", 20).alias("files"), newest("tool", 30).alias("tools")
    )


#: What a log line is about, first match wins.
LOG_KINDS = {"write": "write", "recall": "recall", "restore": "restore", "hook": "hook", "checkpoint": "checkpoint"}


def log_counts(lines: DataFrame) -> DataFrame:
    """(day, one count per kind) from ``text`` lines that begin with an ISO time."""
    kind = None
    for k, word in LOG_KINDS.items():
        c = F.contains(F.lower("value"), F.lit(word))
        kind = F.when(c, k) if kind is None else kind.when(c, k)
    own = lines.select(F.substring("value", 1, 10).alias("day"), kind.alias("kind")).where("kind is not null")
    return own.groupBy("day").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in LOG_KINDS])


def token_audit(uses: DataFrame) -> DataFrame:
    """(category, calls, tokens, share) of tool uses (tool, tokens)."""
    tool = F.lower("tool")
    category = F.when(tool.rlike("memory_|recall|restore"), "memory").when(tool.rlike("read|grep|glob|search"), "reading").when(tool.rlike("write|edit"), "writing").when(tool.rlike("bash|shell|run"), "running").otherwise("other")
    own = uses.groupBy(category.alias("category")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    total = own.agg(F.sum("tokens").alias("total"))
    return own.join(F.broadcast(total)).select("category", "calls", "tokens", (F.col("tokens") / F.col("total")).alias("share"))


class SnapshotStore:
    """Versioned Parquet tables: a version counts once its manifest row is written; old versions are kept by number.

    Everything goes through Spark's writers and readers, so any file system of the cluster will do."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 6):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def versions(self, name: str) -> list[tuple[int, str]]:
        fs, jvm = self._fs()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/manifest")
        if not fs.exists(path):
            return []
        return sorted((r["version"], r["path"]) for r in self.spark.read.schema("version long, path string, n_rows long").json(path.toString()).collect())

    def save(self, name: str, df: DataFrame, key: str | None = None, partition_by: Sequence[str] = ()) -> int:
        """Write a version; with a key, rows without one or with the same one are refused."""
        version = max((v for v, _ in self.versions(name)), default=0) + 1
        path = f"{self.folder}/{name}/v{version}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(path)
        back = self.spark.read.parquet(path)
        n = back.count()
        if key is not None:
            bad = back.groupBy(key).count().where(f"{key} is null or count > 1").limit(1).count()
            if bad:
                raise ValueError(f"{name}: {key} is null or not unique")
        self.spark.createDataFrame([(version, path, n)], "version long, path string, n_rows long").coalesce(1).write.mode("append").json(f"{self.folder}/{name}/manifest")
        fs, jvm = self._fs()
        for _, old in self.versions(name)[: -self.keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
        return version

    def load(self, name: str, version: int | None = None) -> DataFrame:
        known = dict(self.versions(name))
        if not known:
            raise FileNotFoundError(f"{self.folder}/{name} has no version")
        return self.spark.read.parquet(known[version if version is not None else max(known)])
