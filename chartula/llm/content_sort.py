"""Exact dedup by content sort: splitters, sorted bytes, neighbours compared in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole, written

#: Runs into which copies of one text may be dealt, and the characters of a text that a splitter holds.
SALTS, SPLITTER = 64, 32


def exact_groups(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of documents (doc_id, text), one row each; ``also`` names columns
    to carry.

    Sampled splitters over (start of the text, its hash, salt) range-partition the rows, so that even the copies of one
    text, being a third of all rows, spread over many partitions; a splitter is short however long the texts are. The
    external sort puts equal texts side by side and the window compares neighbours over their whole length. Each run
    sends on one row, and runs of one text (at most SALTS) meet under its SHA-256. The row with the largest doc_id stays.

    Null text counts as empty. A null id is smaller than any other. One row of a group is kept: of rows that repeat the
    largest id, the first by the carried columns; group_size counts every row. No rows give no rows.
    """
    rows = docs.select("doc_id", F.struct(*also, F.lit(0).alias("none_")).alias("carried"), whole().alias("text")).select(
        "doc_id", "carried", "text", F.substring("text", 1, SPLITTER).alias("start"), F.xxhash64("text").alias("hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    content = ["start", "hash", "salt", "text"]
    run = Window.partitionBy(*content).orderBy(F.col("doc_id").desc_nulls_last(), "carried")
    sorted_rows = rows.repartitionByRange("start", "hash", "salt").withColumn("place", F.row_number().over(run)).withColumn("largest", F.first("doc_id").over(run))
    narrow = written(sorted_rows.select("doc_id", "carried", "salt", "place", "largest", F.sha2("text", 256).alias("text_sha256")))
    runs = narrow.groupBy("text_sha256", "salt").agg(F.max("largest").alias("largest"), F.count("*").alias("size"))
    text = Window.partitionBy("text_sha256")
    groups = written(runs.select("text_sha256", "salt", F.max("largest").over(text).alias("keep_id"), F.sum("size").over(text).alias("group_size")))
    return narrow.drop("largest").join(groups, ["text_sha256", "salt"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "text_sha256", *[F.col("carried")[c].alias(c) for c in also])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""
