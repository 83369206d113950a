"""Vector and set similarity in double precision, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for different widths or a zero vector."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(a.cast("array<double>"))


def clamped(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """Rounded as SQL does it here: the double is scaled, then rounded. F.round goes by its decimal digits, so that 41/640 becomes 0.064063, not 0.064062."""
    return F.round(value * 10.0**digits) / 10.0**digits


def lexical(shared: Column, query: Column, row: Column, same_model: Column) -> Column:
    """shared / sqrt(query * row), one more for the same model, at most 2; 0 if a side is empty."""
    return F.when((query == 0) | (row == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(2.0), shared / F.sqrt(query * row) + F.when(same_model, 1.0).otherwise(0.0)))
