"""Vector arithmetic as column expressions.

Vectors are ``array<float>`` or ``array<double>``; all arithmetic is in double.  Every
function takes and returns columns, so it works in any select, filter or join and
stays inside the JVM.  A null vector gives null; vectors of different lengths raise.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over the places of both vectors."""
    same = F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<double>"))
    return _sum(F.zip_with(same.cast("array<double>"), b.cast("array<double>"), f))


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size.isNotNull(), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def euclidean(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + euclidean_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + manhattan_distance(a, b))


def angular(a: Column, b: Column) -> Column:
    return 1.0 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))) / pi


def rbf(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * squared_distance(a, b))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "dot": dot,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "angular": angular,
    "rbf": rbf,
}


def similarity(metric: str, a: Column, b: Column) -> Column:
    """The similarity of that name."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    plain = a.cast("array<double>")
    size = norm(a)
    return F.when(size > 0, F.transform(plain, lambda x: x / size)).otherwise(plain)


def normalized_cosine(a: Column, b: Column) -> Column:
    """The cosine of vectors that are known to be unit vectors."""
    return dot(a, b)


def is_normalized(a: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(a) - 1.0) <= tolerance


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, dim, mean``: the mean vector of each key, an element a row; partial sums run before the shuffle."""
    return df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("mean"))


def centroid_arrays(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, centroid``: the mean vector of each key; vectors of one key must be of one length."""
    means = centroids(df, key, vector)
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("centroid"))
