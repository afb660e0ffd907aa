"""Vector expressions evaluated in the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalized(vector: Column) -> Column:
    """The vector divided by its norm; null for a zero vector."""
    length = norm(vector)
    return F.when(length > 0, F.transform(doubles(vector), lambda x: x / length))


def is_finite(vector: Column) -> Column:
    return F.forall(doubles(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def is_usable(vector: Column, dim: int) -> Column:
    """``dim`` finite numbers, not all zero; false for null."""
    return F.coalesce((F.size(vector) == dim) & is_finite(vector) & F.exists(doubles(vector), lambda x: x != 0), F.lit(False))
