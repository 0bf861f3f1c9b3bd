"""Vector functions.  Vectors are arrays of float of unit length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product in [-1, 1]; 0 for empty vectors or different lengths."""
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(0.0)


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in encoder without a model: hashed term counts of unit length."""
    terms = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    slots = F.transform(terms, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
