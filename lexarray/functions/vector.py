"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_wide(a), lambda x: x * x)))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, l2 or dot (negated, so that smaller is nearer); any other name means cosine. A zero vector has no cosine distance: null."""
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y))))
    if metric == "dot":
        return -dot(a, b)
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """With a small constant beside each norm, so that zero vectors give zero."""
    return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def quantize(v: Column) -> Column:
    """Clipped to [-1, 1], times 127, cut to a signed byte, and divided again."""
    def one(x: Column) -> Column:
        clipped = F.greatest(F.least(x.cast("float"), F.lit(1.0).cast("float")), F.lit(-1.0).cast("float"))
        return ((clipped * F.lit(127.0).cast("float")).cast("float").cast("tinyint").cast("float") / F.lit(127.0).cast("float")).cast("float")

    return F.transform(v, one)
