"""Column functions on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Col, col


def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Col) -> Column:
    return F.sqrt(F.aggregate(col(a).cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Col, b: Col) -> Column:
    """0 where either is zero; null where their sizes differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(col(a)) != F.size(col(b)), F.lit(None)).when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Col) -> Column:
    """The vector with length 1; zero stays zero."""
    return F.transform(col(a).cast("array<double>"), lambda x: x / F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a)))
