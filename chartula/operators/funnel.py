"""Filters that narrow a set of queries, with their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CONSOLIDATION_FAILURE, CONTEXT_FAILURE, CONTEXT_TOO_LONG, QUERY_FAILURE

#: Fixed value: beginnings of list items and clauses, with Unicode letters for word characters.
ITEM = r"^(Art\.)? ?([\p{L}\p{N}_]+)?\.? ?([\p{L}\p{N}_]+[\.\)])? ?-"


def drop_failures(queries: DataFrame) -> DataFrame:
    return queries.filter(~F.col("query").eqNullSafe(F.lit(QUERY_FAILURE)))


def drop_items(queries: DataFrame, enabled: bool = True) -> DataFrame:
    """Without chunks that end in a colon or begin like a list item; null chunks stay."""
    bad = F.col("chunk").endswith(":") | F.col("chunk").rlike(ITEM)
    return queries.filter(~F.coalesce(bad, F.lit(False))) if enabled else queries


def last_of(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def with_ranks(queries: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """queries with dense_rank and sparse_rank of results (query, gt_chunk_id, gt_chunk_rank, seq); the last of repeated rows counts."""
    for name, results in (("dense_rank", dense), ("sparse_rank", sparse)):
        last = results.groupBy("query", "gt_chunk_id").agg(F.max_by("gt_chunk_rank", "seq").alias(name)).withColumnRenamed("gt_chunk_id", "chunk_id")
        queries = queries.join(last, ["query", "chunk_id"], "left")
    return queries


def verdicts(ranks: DataFrame, k: int = 10) -> DataFrame:
    """with_ranks() and outcome: dropped_dense, dropped_sparse or kept; dense is asked first."""
    in_top = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    return ranks.withColumn("outcome", F.when(in_top("dense_rank"), "dropped_dense").when(in_top("sparse_rank"), "dropped_sparse").otherwise("kept"))


def rank_filter(queries: DataFrame, dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    return verdicts(with_ranks(queries, dense, sparse), k).filter("outcome = 'kept'").drop("dense_rank", "sparse_rank", "outcome")


def assurance_filter(queries: DataFrame, assurance: DataFrame) -> DataFrame:
    """Queries whose last verdict (by seq, where there is one) is exactly Yes."""
    order = "seq" if "seq" in assurance.columns else None
    last = last_of(assurance, ["chunk_id"], "passes_assurance", order) if order else assurance.select("chunk_id", "passes_assurance")
    return queries.join(last.filter("passes_assurance = 'Yes'"), "chunk_id", "left_semi")


def drop_context_failures(chunks: DataFrame, sentinels: tuple[str, ...] = (CONTEXT_FAILURE, CONTEXT_TOO_LONG, CONSOLIDATION_FAILURE)) -> DataFrame:
    for s in sentinels:
        chunks = chunks.filter(~F.coalesce(F.contains("chunk", F.lit(s)), F.lit(False)))
    return chunks


def only_ids(df: DataFrame, ids: DataFrame, exact: bool = True) -> DataFrame:
    """Rows whose chunk_id is in ids; exact: every id must be there."""
    wanted = ids.select("chunk_id").distinct()
    if exact and (missing := wanted.join(df.select("chunk_id"), "chunk_id", "left_anti").limit(3).collect()):
        raise ValueError(f"ids without a row, such as {[r.chunk_id for r in missing]}")
    return df.join(wanted, "chunk_id", "left_semi")


def non_contextual(all_queries: DataFrame, contextual: DataFrame) -> DataFrame:
    keys = ["chunk_id", "query"]
    return all_queries.join(contextual.select(*keys), keys, "left_anti")


def todo(df: DataFrame, done: DataFrame, update: bool = False, key: str = "chunk_id") -> DataFrame:
    """Rows left to do after a checkpoint; update: rows to do again."""
    return df.join(done.select(key).distinct(), key, "left_semi" if update else "left_anti")


def funnel_counts(before: DataFrame, **stages: DataFrame) -> DataFrame:
    """(stage, n_in, n_dropped, n_kept), each stage fed by the one before it."""
    counts = before.agg(F.count("*").alias("n")).select(F.lit(0).alias("at"), F.lit("input").alias("stage"), "n")
    for at, (name, df) in enumerate(stages.items(), 1):
        counts = counts.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(at).alias("at"), F.lit(name).alias("stage"), "n"))
    prior = counts.select((F.col("at") + 1).alias("at"), F.col("n").alias("n_in"))
    return counts.join(prior, "at").select("stage", "n_in", (F.col("n_in") - F.col("n")).alias("n_dropped"), F.col("n").alias("n_kept"))
