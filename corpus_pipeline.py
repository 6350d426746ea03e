"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Every stage sees all that its predecessor kept, and carries the rows through its operator, so that each decision is about a
row, whatever ids repeat. All but the last return the columns of documents; a column that the input lacks is null.

* quality: documents that the quality rules reject go; of the others the lines that fail go, and n_chars is counted anew. A
  document without such a line stays as it is;
* exact: of equal texts one row stays, that with the largest doc_id (null is the smallest; of rows that repeat the id, the
  first by the other columns);
* near: of each SimHash component one row stays, that with the smallest doc_id (null is the largest; of rows that repeat
  it, one by a hash of the row). A component of null ids alone keeps one row too;
* mix: a row comes as often as the mix takes it, not at all to twice; rows that repeat an id fare alike;
* pack: sequences of tokens; rows that the mix repeats are packed as often.

Null texts count as empty (the quality rules reject them), empty tables give no rows. The near stage can't be put in SQL
(XXH64, popcounts and components), so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartula.llm import content_sort, golay, mixing, packing, quality
from chartula.llm.common import documents, written

KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = tuple(KINDS)
CARRIED = COLUMNS[1:]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in KINDS.items()])


def _row() -> Column:
    """Names a row besides its id: rows that agree in both are the same in all columns."""
    return F.xxhash64(*CARRIED)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each of kept (doc_id, row); the texts are dealt once, by those two."""
    keys = [F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    right = kept.select(*keys, F.col("row").alias("_row")).hint("shuffle_hash")
    left = docs.select("*", *keys, _row().alias("_row"))
    found = left.join(right, ["_id", "_none", "_row"], "left_semi")
    first = Window.partitionBy("_id", "_none", "_row").orderBy(F.lit(0))
    return found.withColumn("_place", F.row_number().over(first)).filter("_place = 1").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(_columns(docs), "lang", "source")
    # As one element of an array, a verdict is found once: as a column, the optimizer would evaluate it in a filter again.
    row = F.struct("doc_id", F.col("cleaned").alias("text"), "lang", "source", "kept")
    kept = judged.select(F.inline(F.filter(F.array(row), lambda x: x["kept"])))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    return _only(docs, written(content_sort.exact_groups(docs.withColumn("row", _row()), "row").filter("kept").select("doc_id", "row")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    groups = golay.near_groups(docs.withColumn("row", _row()), "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return _only(docs, written(groups.groupBy("root").agg(F.min(order).alias("least")).select("least.doc_id", "least.row")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_columns(docs), "text", "lang", "n_chars").filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_columns(docs), public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
