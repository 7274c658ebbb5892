"""Vector and histogram expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def project(a: Column, matrix: list[list[float]]) -> Column:
    """The vector times a matrix given by its columns."""
    return F.array(*[dot(a, F.array(*[F.lit(float(x)) for x in column])) for column in matrix])


def chi_square(h: Column, r: Column) -> Column:
    """Sum of (h - r)^2 / (r + 1e-10) over bins."""
    return total(F.zip_with(h, r, lambda x, y: (x - y) * (x - y) / (y + F.lit(1e-10))))


def add(a: Column, b: Column) -> Column:
    """Sum of two vectors."""
    return F.zip_with(a, b, lambda x, y: x + y)
