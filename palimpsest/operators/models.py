"""Models in slots: encoders of texts and scorers of (query, passage) pairs.

A model is a ``Slot``: a version and a factory without arguments, which each Python worker calls once.
The factory loads what it needs (files of a model, arrays); tasks get texts in Arrow batches.  Encoders give a row of numbers
a text, scorers a logit a pair.  No model is shipped: a hashed encoder and a small trained scorer stand in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shared import Scratch, freeing


@dataclass(frozen=True)
class Slot:
    version: str
    factory: Callable[[], Callable]


_LOADED: dict[str, Callable] = {}  # of this Python worker


def loaded(slot: Slot) -> Callable:
    if slot.version not in _LOADED:
        _LOADED[slot.version] = slot.factory()
    return _LOADED[slot.version]


# Encoders.


class HashedEncoder:
    """Stand-in: square roots of counts of words and of their letter triples in signed hashed places, of unit length;
    zeros for an empty text alone."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts):
            parts: dict[str, int] = {}
            for w in re.findall(r"\w+", text.lower()):
                for g in (w, *(f"<{w}>"[i : i + 3] for i in range(len(w)))):
                    parts[g] = parts.get(g, 0) + 1
            for g, n in parts.items():
                h = zlib.crc32(g.encode())
                row[h // 2 % self.dims] += n**0.5 * (1 - 2 * (h & 1))
            if text and not row.any():  # no words, or parts that cancel out: one place, by the whole text
                h = zlib.crc32(text.encode())
                row[h // 2 % self.dims] = 1 - 2 * (h & 1)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def hashed_encoder(dims: int = 64) -> Slot:
    return Slot(f"hashed2-{dims}", partial(HashedEncoder, dims))


def encoding(slot: Slot, text: Column, batch: int = 32) -> Column:
    """The vector of each text, whole; null for null.  The model sees ``batch`` texts at once."""

    @F.arrow_udf("array<float>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(slot)
        for part in parts:
            there = [i for i, t in enumerate(part.is_valid().to_pylist()) if t]
            out: list = [None] * len(part)
            for k in range(0, len(there), batch):
                some = there[k : k + batch]
                for i, v in zip(some, np.asarray(model(part.take(some).to_pylist()), np.float32)):
                    out[i] = v
            yield pa.array(out, pa.list_(pa.float32()))

    return encode(text)


class EncodedStore:
    """Vectors of memories by one model's version, kept beside the memories and filled up in batches.

    A row is (id, digest, vector), the digest that of the encoded text; a changed text has another digest and is encoded
    again, its old vector is no longer met.  Rows lie in folders by a hash of the id.  A run stores one folder's new rows at a
    time, so one that is broken off loses at most that folder's, and the next encodes only what is missing.

    Memories without an id or without any text have no vector; repeated rows have one; of different texts of
    one id each has its own."""

    SLICES = 16

    def __init__(self, spark: SparkSession, folder: str, slot: Slot):
        self.spark, self.slot = spark, slot
        self.folder = f"{folder.rstrip('/')}/{slot.version}"

    @staticmethod
    def texts(memories: DataFrame) -> DataFrame:
        """(id, digest, text, slice) of what is encoded: concept and content."""
        text = F.concat_ws(" ", "concept", "content")
        own = memories.where("id is not null").select("id", text.alias("text")).where("text != ''")
        return own.select("id", F.sha2("text", 256).alias("digest"), "text", F.pmod(F.xxhash64("id"), F.lit(EncodedStore.SLICES)).cast("int").alias("slice"))

    def stored(self) -> DataFrame:
        kind = "id long, digest string, vector array<float>, slice int"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(kind).parquet(self.folder) if there else self.spark.createDataFrame([], kind)

    def missing(self, memories: DataFrame) -> DataFrame:
        return self.texts(memories).join(self.stored().select("id", "digest", "slice"), ["id", "digest", "slice"], "left_anti")

    def backfill(self, memories: DataFrame, batch: int = 32) -> int:
        """Encode what has no vector yet; the number of texts encoded."""
        done = 0
        with Scratch(self.spark) as scratch:
            todo = scratch.stored(self.missing(memories).dropDuplicates(["id", "digest"]).repartition("slice", F.pmod(F.xxhash64("digest"), F.lit(64))), "todo")
            counts = {r["slice"]: r["count"] for r in todo.groupBy("slice").count().collect()}  # a row a folder
            for k in sorted(counts):
                new = todo.where(F.col("slice") == k).select("id", "digest", encoding(self.slot, F.col("text"), batch).alias("vector"), "slice")
                with freeing(self.spark):
                    new.write.mode("append").partitionBy("slice").parquet(self.folder)
                done += counts[k]
        return done

    def vectors(self, memories: DataFrame) -> DataFrame:
        """(id, vector) of the memories as they are now."""
        now = self.texts(memories).select("id", "digest", "slice")
        return now.join(self.stored(), ["id", "digest", "slice"]).select("id", "vector").dropDuplicates(["id"])


# Scorers of pairs.

PASSAGE = 400  # characters of a content that a scorer sees, after the concept


def passage(concept: Column, content: Column) -> Column:
    return F.concat(F.coalesce(concept, F.lit("")), F.lit(": "), F.substring(F.coalesce(content, F.lit("")), 1, PASSAGE))


def pair_features(query: str, text: str) -> list[float]:
    """How a query's words meet a passage's."""
    q, p = re.findall(r"\w+", query.lower()), re.findall(r"\w+", text.lower())
    own = list(dict.fromkeys(q))
    if not own or not p:
        return [1.0] + [0.0] * 7
    place: dict[str, int] = {}
    for i, w in enumerate(p):
        place.setdefault(w, i)
    hit = [w for w in own if w in place]
    triples = lambda ws: {f"<{w}>"[i : i + 3] for w in ws for i in range(len(w))}
    a, b = triples(own), triples(place)
    two, pairs = set(zip(q, q[1:])), set(zip(p, p[1:]))
    return [
        1.0, len(hit) / len(own), sum(map(len, hit)) / sum(map(len, own)), len(a & b) / len(a), len(two & pairs) / len(two) if two else 0.0,
        1 - min(place[w] for w in hit) / len(p) if hit else 0.0, len(hit) / len(place), min(len(own), 20) / 20,
    ]


class PairScorer:
    """A logistic model over pair_features."""

    def __init__(self, weights: tuple[float, ...]):
        self.weights = np.asarray(weights)

    def __call__(self, queries: list[str], passages: list[str]) -> np.ndarray:
        return np.array([pair_features(q, p) for q, p in zip(queries, passages)]).reshape(-1, len(self.weights)) @ self.weights


def labelled_pairs(memories: DataFrame, max_rows: int = 600, words: int = 5) -> list[tuple[str, str, int]]:
    """(query, passage, label): words drawn from a memory's passage, in a row or one by one, with this passage (1) and with
    another's (0).  At most ``max_rows`` memories, chosen by a hash of the id."""
    own = memories.where("id is not null and content is not null").select("id", passage(F.col("concept"), F.col("content")).alias("p"))
    rows = own.orderBy(F.xxhash64("id"), "id", "p").limit(max_rows).collect()
    out = []
    for k, r in enumerate(rows):
        rng = np.random.default_rng(zlib.crc32(str(r["id"]).encode()))
        there = re.findall(r"\w+", r["p"].lower())
        if len(there) < 2:
            continue
        at = int(rng.integers(max(1, len(there) - words)))
        some = there[at : at + words] if k % 2 else [there[int(i)] for i in rng.integers(len(there), size=words)]
        query = " ".join(some)
        out.append((query, r["p"], 1))
        other = rows[(k + 1 + int(rng.integers(max(1, len(rows) - 1)))) % len(rows)]["p"]
        if other != r["p"]:
            out.append((query, other, 0))
    return out


def trained_scorer(pairs: list[tuple[str, str, int]], rounds: int = 40, penalty: float = 1e-3) -> Slot:
    """Logistic regression by Newton steps on a bounded table of pairs."""
    x = np.array([pair_features(q, p) for q, p, _ in pairs]).reshape(len(pairs), 8)
    y = np.array([float(k) for *_, k in pairs])
    w = np.zeros(8)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(8), x.T @ (p - y) / len(y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    weights = tuple(round(float(v), 6) for v in w)
    return Slot(f"pairs-{zlib.crc32(repr(weights).encode()):08x}", partial(PairScorer, weights))


def pair_score(slot: Slot, query: Column, text: Column, batch: int = 64) -> Column:
    """Sigmoid of the model's logit of each pair; 0, without asking the model, where either is null."""

    @F.arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for q, p in parts:
            there = [i for i, (a, b) in enumerate(zip(q.is_valid().to_pylist(), p.is_valid().to_pylist())) if a and b]
            out = np.zeros(len(q))
            for k in range(0, len(there), batch):
                some = there[k : k + batch]
                logits = np.asarray(loaded(slot)(q.take(some).to_pylist(), p.take(some).to_pylist()), float)
                out[some] = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.array(out)

    return score(query, text)
