"""Dense vectors as arrays, sparse ones as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def sparse_dot(a: Column, b: Column) -> Column:
    """Sum of the products of shared keys, in the order of a's keys."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + F.coalesce(e["value"].cast("double") * F.element_at(b, e["key"]).cast("double"), F.lit(0.0)))


def sparse_cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return sparse_dot(a, b) / (F.sqrt(sparse_dot(a, a)) * F.sqrt(sparse_dot(b, b)) + F.lit(epsilon))
