"""Vector arithmetic, distances and scores as column expressions; components are widened to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Similarity, from -1 to 1; 0 where a norm is 0. One root of both squares, as in SQL engines, so that parallel vectors tie as they do there."""
    aa, bb = dot(a, a), dot(b, b)
    n = F.when((aa * bb).between(1e-290, 1e290), F.sqrt(aa * bb)).otherwise(F.sqrt(aa) * F.sqrt(bb))
    c = dot(a, b) / F.nullif(n, F.lit(0.0))
    return F.when(n == 0, F.lit(0.0)).when(c > 1, F.when(F.isnan(c), c).otherwise(F.lit(1.0))).when(c < -1, F.lit(-1.0)).otherwise(c)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def scale(a: Column, k: float) -> Column:
    return F.transform(doubles(a), lambda x: x * F.lit(float(k)))


def normalize(a: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def subvector(a: Column, start: int, length: int) -> Column:
    """``length`` components from the 0-based ``start``."""
    return F.slice(a, start + 1, length)


def truncate(a: Column, length: int) -> Column:
    return F.slice(a, 1, length)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    """l2; minus the inner product; or 1 - cosine."""
    if metric == "l2":
        return l2(a, b)
    if metric == "ip":
        return -dot(a, b)
    if metric == "cosine":
        return 1 - cosine(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def score(metric: str, d: Column) -> Column:
    """A distance as a score from 0 to 1, higher for nearer."""
    if metric == "l2":
        return 1 / (1 + d)
    if metric == "ip":
        return 1 / (1 + F.exp(d))
    if metric == "cosine":
        return F.least(F.greatest(1 - d, F.lit(0.0)), F.lit(1.0))
    raise ValueError(f"unknown metric {metric!r}")
