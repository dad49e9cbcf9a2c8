"""Vector expressions over `array<float>` columns; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for a missing or zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of an `array<array<float>>`, in the row it lies in; null when empty."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    rest = F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0)))
    total = F.aggregate(rest, first, lambda sums, v: F.zip_with(sums, v, lambda s, x: s + x.cast("double")))
    return F.transform(total, lambda s: s / F.size(vectors))
