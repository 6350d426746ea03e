"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 50


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(written(least), "u")


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v); root is the smallest node of the component.

    Each half-step takes the minimum of a node's neighbours (pre-aggregated, so a hub is no hot key there) and joins it
    back from a written table (so a hub's edges are split by the skew join). The number of rounds grows with the
    logarithm of the nodes; edges never become more. No edges give no rows; loops are ignored.
    """
    big = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = written(edges.select(*big("u", "v")).filter("u > v").distinct())
    before = _signature(now)
    for _ in range(MOST_ROUNDS):
        both = written(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = written(_joined(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = _joined(large, least).select("v", "m").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(to_least.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
