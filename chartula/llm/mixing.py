"""Mixing sources to target weights: repetition rates for a source, whole copies and one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, n_words, whole, written


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources in code point order, null last, take the weights in turn and share ``share[0] / share[1]`` of all sizes.
    No target exceeds ``most`` times its source's size; the excess goes to the others by weight. Filling up in the order
    of cap over weight finds who is capped without iterating. An empty table gives no rows; a source of size 0 gets 0.
    """
    up, down = share
    by_name, everyone = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    filled = ranked.select(
        "*", F.sum("source_size").over(everyone).alias("all_size"), F.sum("weight").over(everyone).alias("all_weight"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    capped = filled.withColumn("capped", (up * F.col("all_size") - down * F.col("cap_before")) * F.col("weight") >= down * cap * (F.col("all_weight") - F.col("weight_before")))
    rest = capped.select(
        "source", "source_size", "weight", "capped", cap.alias("cap"),
        (up * F.col("all_size") - down * F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(everyone)).alias("left"),
        (down * F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everyone)).alias("by"),
    )
    return rest.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("left").cast("double") * F.col("weight") / F.col("by")).alias("target"))


def mix(docs: DataFrame, *also: str, seed: str = "mix-1", **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of documents (doc_id, text, source); ``also`` names columns to carry.

    A document comes floor(rate) times, and once more with the probability of the rest: a hash of the seed and the id
    decides, so reruns agree and repeated rows fare alike. Null text has size 0, a null id hashes as the empty string, a
    null source is a source of its own. The rows joined are narrow; the targets are one row a source, whose size the
    optimizer knows from the written table: small ones are broadcast, others joined by sorted keys with skew split.
    """
    carried = F.struct(*also, F.lit(0).alias("none_")).alias("carried")
    sizes = written(docs.select("doc_id", "source", n_words(whole()).alias("size")))
    targets = written(source_targets(sizes, **options)).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # Carried columns may be wide: rows with them come from the documents themselves, and are joined to the few targets.
    rows = docs.select("doc_id", "source", n_words(whole()).alias("size"), carried) if also else sizes.withColumn("carried", carried)
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long").alias("copies"), *[F.col("carried")[c].alias(c) for c in also])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
ranked AS (SELECT source, source_size, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS BIGINT) AS weight
           FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
filled AS (SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
                  coalesce(sum(2 * source_size) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
           FROM ranked WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (3 * all_size - 2 * cap_before) * weight >= 4 * source_size * (all_weight - weight_before) AS capped FROM filled),
rest AS (SELECT *, 3 * all_size - 2 * sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER () AS remaining,
                2 * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS by_weight FROM capped),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
                   ELSE CAST(remaining AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(by_weight AS DOUBLE) END AS target FROM rest),
rates AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                 CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS drawn
          FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rates
"""
