"""Quality classifier: naive Bayes support vectors.

A text's n-gram indicators (words, word pairs and byte triples, hashed into a
table of fixed size) are scaled by the ratio of the two classes' log counts and
brought to unit length; a linear hinge-loss model over them is fitted by dual
coordinate descent.  The margin becomes a probability by a logistic curve fitted
on margins of folds that the model did not see.

The fit takes at most ``max_rows`` labelled rows (those with the least hash of
their id, so the choice depends on neither order nor content); scoring is one pass
over all texts without a shuffle, and the broadcast model has a fixed size.

Defined results: a null or empty text has no n-grams and scores as the bias alone
says; texts of any length are read whole; repeated rows score alike; labels that
are null are left out and repeated ones are averaged; of several texts under one id
the largest is learnt; with no labelled row the
score is 0.5, with one class its share smoothed; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._words import SPACED, U, buffers, chunks, mix, windows, words

BITS = 20
_MASK = U((1 << BITS) - 1)


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every distinct n-gram of every text, sorted."""
    w = words(data, offsets, SPACED)
    h, text = w.hashes(), w.text_of().astype(U)
    keys = [text << U(BITS) | h & _MASK]
    if len(h) > 1:
        same = text[1:] == text[:-1]
        keys.append((text[:-1] << U(BITS) | windows(h, 2) & _MASK)[same])
    if len(data) > 2:
        b = data.astype(np.uint32)
        tri = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(U)
        same = of[2:] == of[:-2]
        keys.append((of[:-2] << U(BITS) | (tri >> np.uint32(32 - BITS)).astype(U))[same])
    k = np.sort(np.concatenate(keys))
    k = k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k
    return (k >> U(BITS)).astype(np.int64), (k & _MASK).astype(np.int64)


@dataclass
class Model:
    """Fixed-size tables: the scaled weights and the squared scales."""

    weight: np.ndarray  # float32, 2**BITS: ratio * weight
    scale2: np.ndarray  # float32: ratio squared
    bias: float
    slope: float
    shift: float

    def margins(self, n: int, text: np.ndarray, feature: np.ndarray) -> np.ndarray:
        total = np.bincount(text, self.weight[feature], n)
        norm = np.sqrt(np.bincount(text, self.scale2[feature], n))
        return total / np.maximum(norm, 1e-9) + self.bias

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed shares of each feature, positive over negative."""
    size = 1 << BITS
    count = [np.full(size, smooth), np.full(size, smooth)]
    for r, c in zip(rows, y):
        count[int(c)][r] += 1
    n = np.bincount(y.astype(int), minlength=2) + 2 * smooth
    ratio = np.log(count[1] / n[1]) - np.log(count[0] / n[0])
    ratio[(count[0] + count[1]) <= 2 * smooth] = 0
    return ratio


def coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss in the dual, one coordinate at a time (classes weigh alike)."""
    sign = np.where(y > 0, 1.0, -1.0)
    cap = c * np.where(y > 0, len(y) / (2 * max(1, int(y.sum()))), len(y) / (2 * max(1, int((1 - y).sum()))))
    value = []
    for r in rows:
        v = ratio[r]
        value.append(v / max(float(np.sqrt(v @ v)), 1e-9))
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1.0 for v in value])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows[i], value[i]
            g = sign[i] * (float(w[r] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cap[i])
            d = new - alpha[i]
            if d:
                alpha[i] = new
                w[r] += d * sign[i] * v
                bias += d * sign[i]
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = x.T @ (p - target)
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1e-6, b)


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 30, folds: int = 4, seed: int = 7) -> Model:
    empty = np.zeros(1 << BITS, np.float32)
    if len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(empty, empty, 0.0, 1.0, float(np.log(share / (1 - share))))

    def one(at: np.ndarray) -> Model:
        own = [rows[i] for i in at]
        ratio = log_count_ratios(own, y[at])
        w, bias = coordinate_descent(own, y[at], ratio, c, epochs, seed)
        return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)

    order = np.random.default_rng(seed).permutation(len(y))
    fold = np.empty(len(y), int)
    fold[order] = np.arange(len(y)) % folds
    unseen = np.zeros(len(y))
    for k in range(folds):
        at, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[at].tolist())) < 2:
            continue
        m = one(at)
        lengths = [len(rows[i]) for i in rest]
        unseen[rest] = m.margins(len(rest), np.repeat(np.arange(len(rest)), lengths), np.concatenate([rows[i] for i in rest]) if sum(lengths) else np.zeros(0, np.int64))
    model = one(np.arange(len(y)))
    model.slope, model.shift = logistic(unseen, y)
    return model


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``max_rows`` labelled rows whose crc32(id as text) mod 5 is not 0."""
    ids = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isNotNull() & (F.crc32(F.col("__id").cast("string")) % 5 != 0))
        .groupBy("__id")
        .agg((F.avg("__y") >= 0.5).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    texts = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    drawn = texts.join(F.broadcast(ids), "__id")  # ids: at most max_rows rows
    drawn = drawn.groupBy("__id", "__y").agg(F.max("__text").alias("__text"))  # of an id's texts one, however many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", 1 << 20):
                text, feature = indicators(*buffers(part.column("__text")))
                at = np.searchsorted(text, np.arange(part.num_rows + 1))
                packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y"), pa.array(packed, pa.binary())], names=["__id", "__y", "__x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["__id"])
        m = fit([np.frombuffer(r["__x"], "<i4").astype(np.int64) for r in found], np.array([r["__y"] for r in found], int))
        yield pa.RecordBatch.from_pylist([{"weight": m.weight.tobytes(), "scale2": m.scale2.tobytes(), "bias": float(m.bias), "slope": float(m.slope), "shift": float(m.shift)}])

    # fitted in a task: at most max_rows rows, whose n-grams are more than a driver should hold beside its plans
    rows = drawn.mapInArrow(run, f"__id {drawn.schema['__id'].dataType.simpleString()}, __y int, __x binary")
    m = rows.repartition(1).mapInArrow(learn, "weight binary, scale2 binary, bias double, slope double, shift double").first()
    if m is None:  # no row, no task
        return fit([], np.zeros(0, int))
    return Model(np.frombuffer(m["weight"], np.float32), np.frombuffer(m["scale2"], np.float32), m["bias"], m["slope"], m["shift"])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the kept columns, and score double, one row per input row.  Kept columns must
    have other names than ``score``."""
    kept = documents.select(*dict.fromkeys([id_col, *keep]), F.col(text_col).cast("string").alias("__text"))
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2 * 4 * 2**BITS bytes
    names = [c for c in kept.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in chunks(batch, "__text", 1 << 20):
                p = m.probabilities(m.margins(part.num_rows, *indicators(*buffers(part.column("__text")))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p, pa.float64())], names=[*names, "score"])

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)
    return kept.mapInArrow(run, f"{fields}, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
