"""Arithmetic on vectors held as arrays, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.when(length(v) == 0, F.lit(1.0)).otherwise(length(v))
    return F.transform(v, lambda x: x / n)


def cosine_distance(a: Column, b: Column, same: Column) -> Column:
    """1 - a.b of unit vectors; 0 where both are one."""
    return F.when(same, F.lit(0.0)).otherwise(1 - dot(a, b))


def rank_discount(rank: Column) -> Column:
    """For a rank from 0."""
    return F.lit(1.0) / F.log2(rank + 2)


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_sum_exp(v: Column) -> Column:
    """Of an array."""
    top = F.array_max(v)
    return top + F.log(F.aggregate(F.transform(v, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def smooth_max(v: Column, tau: float) -> Column:
    return F.lit(tau) * log_sum_exp(F.transform(v, lambda x: x / tau))


def softmax(v: Column) -> Column:
    whole = log_sum_exp(v)
    return F.transform(v, lambda x: F.exp(x - whole))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
