"""Vectors as ``array<float>``; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def magnitude(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: _d(x) * _d(x))))


def normalised(a: Column) -> Column:
    """Scaled to length 1, as floats; a zero vector stays."""
    m = magnitude(a)
    return F.when(m == 0, a).otherwise(F.transform(a, lambda x: (_d(x) / m).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a vector is zero."""
    return F.try_divide(F.try_divide(dot(a, b), magnitude(a)), magnitude(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y)))))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (_d(x) + _d(y)).cast("float"))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)).cast("float"))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (_d(x) * _d(y)).cast("float"))


def plus_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: (_d(x) + F.lit(float(s))).cast("float"))


def times_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: (_d(x) * F.lit(float(s))).cast("float"))


def component(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))
