"""Copying the tables of a row store into typed Parquet, chunk by chunk.

A chunk is a range of the table's integer key (the range reaches the source's scan), else a class of the key's
hash.  It counts once its ledger row is written, and that is written only after the rows read back from the copy
have the digest of the rows mapped from the source.  A run that breaks off leaves at most folders that no ledger
row names; the next one copies what the ledger lacks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from palimpsest.sources.shared import freeing

_LEDGER = "table string, chunk int, path string, n_rows long, digest string, unreadable long"
_PLAN = "table string, chunks int, bounds string"


@dataclass(frozen=True)
class Table:
    """How a table is keyed and which of its columns change type; others stay as they are."""

    key: tuple[str, ...]
    kinds: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    unique: bool = True
    optional: bool = False


#: The tables of a memory store and what a missing value becomes.
TABLES = {
    "memories": Table(("id",), {"vector": "vector", "retracted": "flag", "tags": "texts", "refs": "texts", "created_at": "time", "last_accessed": "time"}, {"stage": "active", "memory_type": "unclassified", "memory_class": "working", "salience_features": "{}", "reason_codes": "[]"}),
    "edges": Table(("src", "dst", "type"), {"created_at": "time", "last_activated": "time"}, {"type": "hebbian", "activation_count": 0}),
    "agents": Table(("id",), {"created_at": "time"}, {"config": "{}"}),
    "activations": Table(("event_id",), {"ts": "time", "memory_ids": "texts"}),
    "staging_events": Table(("memory_id",), {"ts": "time"}, unique=False),
    "feedback": Table(("event_id",), {"ts": "time", "useful": "flag"}),
    "episodes": Table(("id",), {"vector": "vector", "start_time": "time", "end_time": "time", "created_at": "time"}, {"memory_count": 0}, optional=True),
    "agent_state": Table(("agent",), {"recall_ids": "texts", "last_activity_at": "time", "checkpoint_at": "time", "updated_at": "time"}, {"write_count": 0, "recall_count": 0, "cycle_count": 0}, optional=True),
}


def _floats(c: Column) -> Column:
    """Little-endian 32-bit floats; bytes that are no whole number of them are unreadable (null)."""

    @F.arrow_udf("array<float>")
    def read(blobs):
        import numpy as np
        import pyarrow as pa

        rows = [None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in blobs.to_pylist()]
        return pa.array(rows, pa.list_(pa.float32()))

    return read(c)


def mapped(df: DataFrame, spec: Table) -> DataFrame:
    """The rows in the types of the copy, with __bad: how many values of a row are unreadable there.

    Flags: 0, 1 and null become booleans, null false.  Vectors: bytes become arrays of floats.  Texts: a JSON list becomes
    an array.  Times: ISO text or milliseconds become timestamps.  Columns that have the type already stay."""
    out, bad = [], [F.lit(0)]
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), spec.kinds.get(f.name)
        new = c
        if kind == "flag" and not isinstance(f.dataType, ST.BooleanType):
            bad.append((c.isNotNull() & c.try_cast("long").isNull()).cast("int"))
            new = F.coalesce(c.try_cast("long"), F.lit(0)) != 0
        elif kind == "flag":
            new = F.coalesce(c, F.lit(False))
        elif kind == "vector" and isinstance(f.dataType, ST.BinaryType):
            new = _floats(c)
        elif kind == "texts" and isinstance(f.dataType, ST.StringType):
            new = F.from_json(c, "array<string>")
        elif kind == "time" and isinstance(f.dataType, ST.StringType):
            new = c.try_cast("timestamp")
        elif kind == "time" and isinstance(f.dataType, ST.LongType):
            new = F.timestamp_millis(c)
        if kind in ("vector", "texts", "time") and new is not c:
            bad.append((c.isNotNull() & new.isNull()).cast("int"))
        if f.name in spec.defaults:
            new = F.coalesce(new, F.lit(spec.defaults[f.name]).cast(f.dataType))
        out.append(new.alias(f.name))
    return df.select(*out, sum(bad[1:], bad[0]).cast("long").alias("__bad"))


def digest(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, n_rows, digest): the same for the same rows in any order, copies counted; nulls are told from absent values."""
    names = sorted(columns)
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in names])
    h = F.xxhash64(nulls, *[F.col(f"`{c}`") for c in names])
    total = F.sum(h.cast("decimal(38,0)")).cast("string")
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.concat_ws(":", total, F.bit_xor(h).cast("string")).alias("digest"))


class Migration:
    """A copy under a folder that all executors share.  ``source`` gives a table by name, or None."""

    def __init__(self, spark: SparkSession, folder: str, source: Callable[[str], DataFrame | None] | Mapping[str, DataFrame], tables: Mapping[str, Table] = TABLES, rows_per_chunk: int = 5_000_000, at_once: int = 16):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), dict(tables)
        self.source = source.get if isinstance(source, Mapping) else source
        self.rows_per_chunk, self.at_once = rows_per_chunk, at_once

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def ledger(self) -> DataFrame:
        """One row per copied chunk; of two runs that copied the same, the smallest path."""
        path = f"{self.folder}/_ledger"
        rows = self.spark.read.schema(_LEDGER).json(path) if self._exists(path) else self.spark.createDataFrame([], _LEDGER)
        return rows.groupBy("table", "chunk").agg(F.min_by(F.struct("path", "n_rows", "digest", "unreadable"), "path").alias("x")).select("table", "chunk", "x.*")

    def _record(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _LEDGER).coalesce(1).write.mode("append").json(f"{self.folder}/_ledger")

    def _planned(self, name: str, df: DataFrame, spec: Table) -> tuple[int, list[int] | None]:
        """The table's chunks, as the first run fixed them."""
        path = f"{self.folder}/_plan/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            whole = isinstance(df.schema[spec.key[0]].dataType, ST.IntegralType)
            chunks = max(1, -(-df.count() // self.rows_per_chunk))
            bounds: list[int] | None = None
            if whole:
                at = [i / chunks for i in range(1, chunks)]
                found = df.agg(F.percentile_approx(spec.key[0], at, 10_000).alias("b")).first()["b"] if at else []
                bounds = sorted(set(found or []))
                chunks = len(bounds) + 1
            self.spark.createDataFrame([(name, chunks, json.dumps(bounds))], _PLAN).coalesce(1).write.mode("overwrite").json(path)
        r = self.spark.read.schema(_PLAN).json(path).first()
        return r["chunks"], json.loads(r["bounds"])

    @staticmethod
    def _part(df: DataFrame, key: str, first: int, last: int, chunks: int, bounds: list[int] | None) -> DataFrame:
        """The rows of chunks first to last, with __chunk.  Rows without a key are in the first chunk."""
        k = F.col(key)
        if bounds is None:
            return df.withColumn("__chunk", F.pmod(F.xxhash64(k), F.lit(chunks)).cast("int")).where(F.col("__chunk").between(first, last))
        own = df
        if last < chunks - 1:
            own = own.where((k < bounds[last]) | k.isNull()) if first == 0 else own.where(k < bounds[last])
        if first > 0:
            own = own.where(k >= bounds[first - 1])
        inner = bounds[first:last]
        return own.withColumn("__chunk", F.lit(first) + sum(((F.coalesce(k >= b, F.lit(False))).cast("int") for b in inner), F.lit(0)))

    def run(self, strict: bool = True) -> DataFrame:
        """Copy what is missing; returns the report.  ``strict`` refuses values that the new type can't hold."""
        done = {(r["table"], r["chunk"]) for r in self.ledger().select("table", "chunk").collect()}
        for name, spec in self.tables.items():
            df = self.source(name)
            if df is None:
                if not spec.optional:
                    raise ValueError(f"{name}: no such table in the source")
                continue
            chunks, bounds = self._planned(name, df, spec)
            todo = [c for c in range(chunks) if (name, c) not in done]
            while todo:
                wave = [todo.pop(0)]
                while todo and len(wave) < self.at_once and todo[0] == wave[-1] + 1:
                    wave.append(todo.pop(0))
                self._copy(name, spec, df, wave, chunks, bounds, strict)
        return self.report()

    def _copy(self, name: str, spec: Table, df: DataFrame, wave: list[int], chunks: int, bounds: list[int] | None, strict: bool) -> None:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows = mapped(self._part(df, spec.key[0], wave[0], wave[-1], chunks, bounds), spec)
        with freeing(self.spark):
            rows.drop("__bad").write.partitionBy("__chunk").parquet(path)
        schema = rows.drop("__bad").schema
        back = self.spark.read.schema(schema).parquet(path)
        if spec.unique:
            twice = back.groupBy(*spec.key).count().where("count > 1").first()
            if twice is not None:
                raise ValueError(f"{name}: {spec.key} is not unique: {tuple(twice)[:-1]}")
        ours = {r["__chunk"]: r for r in digest(back, "__chunk", df.columns).collect()}  # a row per chunk of the wave
        bad = rows.groupBy("__chunk").agg(F.sum("__bad").alias("bad"))
        theirs = {r["__chunk"]: r for r in digest(rows, "__chunk", df.columns).join(bad, "__chunk").collect()}
        rows_done = []
        for c in wave:
            a, b = theirs.get(c), ours.get(c)
            if (a and (a["n_rows"], a["digest"])) != (b and (b["n_rows"], b["digest"])):
                raise ValueError(f"{name}, chunk {c}: the copy differs from the source")
            if strict and a and a["bad"]:
                raise ValueError(f"{name}, chunk {c}: {a['bad']} values can't be read in their new type")
            rows_done.append((name, c, f"{path}/__chunk={c}", a["n_rows"] if a else 0, a["digest"] if a else "", a["bad"] if a else 0))
        self._record(rows_done)

    def planned(self) -> dict[str, int | None]:
        """What a run would copy: rows by table, None for a table that the source lacks.  Nothing is written."""
        sizes = {name: self.source(name) for name in self.tables}
        return {name: None if df is None else df.count() for name, df in sizes.items()}

    def report(self) -> DataFrame:
        """(table, chunks, n_rows, unreadable) of what is copied."""
        return self.ledger().groupBy("table").agg(F.count("*").alias("chunks"), F.sum("n_rows").alias("n_rows"), F.sum("unreadable").alias("unreadable"))

    def load(self, name: str) -> DataFrame:
        """A copied table.  A chunk that is missing makes it an error: part of a table is no table."""
        r = self.spark.read.schema(_PLAN).json(f"{self.folder}/_plan/{name}").first()
        own = self.ledger().where(F.col("table") == name).collect()  # a row per chunk
        if len(own) < r["chunks"]:
            raise ValueError(f"{name}: {len(own)} of {r['chunks']} chunks are copied")
        full = [x["path"] for x in own if x["n_rows"]]
        if not full:  # the types of an empty table come from its source
            return mapped(self.source(name), self.tables[name]).drop("__bad").limit(0)
        return self.spark.read.parquet(*full)
