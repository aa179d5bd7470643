"""Vector and set functions as SQL expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def angular(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    return 1 - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hamming(a: Column, b: Column) -> Column:
    """Share of places that differ."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(differ.cast("double"), F.size(a)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets given as arrays; 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0)))


def valid_distance(metric: str, d: Column) -> Column:
    """Jaccard distances count below 1 only; others always."""
    return d < 1 - 1e-5 if metric == "jaccard" else F.lit(True)


def normalized(a: Column) -> Column:
    """The vector by its length; a zero vector stays as it is."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, norm(a)), x))


def quantized(a: Column, low: Column, high: Column) -> Column:
    """Bytes 0 to 255 of each number between the bounds."""
    return F.transform(a, lambda x: F.round(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * 255).cast("int"))
