"""Column functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def as_doubles(c: str) -> Column:
    return F.col(c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(FLOOR))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(FLOOR))


def cosine01(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def manhattan(a: Column, b: Column) -> Column:
    return -F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def finite(a: Column) -> Column:
    """NaN becomes 0, infinities become 1 and -1."""
    inf = F.lit(float("inf"))
    return F.transform(a, lambda x: F.when(F.isnan(x), 0.0).when(x == inf, 1.0).when(x == -inf, -1.0).otherwise(x))
