"""Retrieval metrics at k over a ranked run (query_id, item, rank) and qrels (query_id, item)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 50, 100)
#: Hashed places of the chunks that result rows name; at most so many go to every task.
PLACES = 1 << 21


def without_self(run: DataFrame, item: str = "chunk_id") -> DataFrame:
    """The run without items that are their own query, ranked anew."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return run.filter(F.col("query_id") != F.col(item)).withColumn("rank", F.row_number().over(order))


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, item: str = "chunk_id") -> DataFrame:
    """(query_id, k, recall, precision, rr, ndcg, ap) of every query with a relevant item; one that found nothing has zeros."""
    rel = qrels.select("query_id", item).distinct()
    # Of the run only relevant items count: the i-th of them by rank has i hits up to its place.
    hits = run.join(rel, ["query_id", item]).withColumn("hits", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    found = hits.groupBy("query_id").agg(F.collect_list(F.struct("rank", "hits")).alias("found"))
    every = rel.groupBy("query_id").agg(F.count("*").alias("n_rel")).join(found, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.filter(F.array_sort(F.coalesce("found", F.array().cast("array<struct<rank: int, hits: int>>"))), lambda h: h["rank"] <= F.col("k"))
    total = lambda f: F.aggregate(inside, F.lit(0.0), lambda s, h: s + f(h))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.col("k")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return every.select(
        "query_id", "k", (F.size(inside) / F.col("n_rel")).alias("recall"), (F.size(inside) / F.col("k")).alias("precision"),
        F.when(F.size(inside) > 0, 1.0 / inside[0]["rank"]).otherwise(0.0).alias("rr"), (total(lambda h: 1.0 / F.log2(h["rank"] + 1.0)) / ideal).alias("ndcg"), (total(lambda h: h["hits"] / h["rank"]) / F.col("n_rel")).alias("ap"),
    )


def mean_at(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, item: str = "chunk_id") -> DataFrame:
    """(k, recall, precision, mrr, ndcg, map): means over the queries with a relevant item."""
    return per_query(run, qrels, ks, item).groupBy("k").agg(*[F.round(F.avg(c), 5).alias(n) for c, n in (("recall", "recall"), ("precision", "precision"), ("rr", "mrr"), ("ndcg", "ndcg"), ("ap", "map"))])


def unknown_labels(qrels: DataFrame, corpus: DataFrame, item: str = "chunk_id") -> DataFrame:
    """Relevant items that the corpus lacks; an evaluation needs none."""
    return qrels.join(corpus.select(item), item, "left_anti")


def check_labels(qrels: DataFrame, corpus: DataFrame, item: str = "chunk_id") -> None:
    if missing := unknown_labels(qrels, corpus, item).limit(5).collect():
        raise ValueError(f"labels outside the corpus, such as {[r[item] for r in missing]}")


def ground_truth_rank(queries: DataFrame, run: DataFrame, item: str = "chunk_id") -> DataFrame:
    """queries (query_id, gt_chunk_id, …) with gt_rank, null outside the run."""
    return queries.join(run.select("query_id", F.col(item).alias("gt_chunk_id"), F.col("rank").alias("gt_rank")), ["query_id", "gt_chunk_id"], "left")


def result_rows(queries: DataFrame, run: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, query, gt_chunk_id, gt_chunk_text, gt_chunk_rank, pred_chunks): the k best nested, scores to 3 decimals.

    Every query has its row; one without hits has an empty list. The run is read once, and so are the chunks, of which only those
    are shuffled that share a hashed place with a chunk that is named.
    """
    asked = queries.select("query_id", "query", "gt_chunk_id")
    mine = asked.select("query_id", "gt_chunk_id").join(run.select("query_id", "chunk_id", "score", "rank"), "query_id").filter((F.col("rank") <= k) | (F.col("chunk_id") == F.col("gt_chunk_id")))
    found = mine.groupBy("query_id").agg(F.max(F.when(F.col("chunk_id") == F.col("gt_chunk_id"), F.col("rank"))).alias("gt_rank"), F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", F.col("chunk_id").alias("id"), "score"))).alias("top"))
    rows = asked.join(found, "query_id", "left")
    none = F.array().cast("array<struct<rank: int, id: string, score: double>>")
    truth = F.struct(F.lit(0).alias("rank"), F.col("gt_chunk_id").alias("id"), F.lit(None).cast("double").alias("score"))
    wanted = rows.select("query_id", "query", "gt_chunk_id", "gt_rank", F.explode(F.concat(F.array(truth), F.coalesce("top", none))).alias("x"))
    place = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(PLACES))
    named = F.broadcast(wanted.select(place(F.col("x.id")).alias("_place")).distinct())
    few = chunks.select(F.col("chunk_id").alias("_id"), "chunk", place(F.col("chunk_id")).alias("_place")).join(named, "_place", "left_semi")
    texts = wanted.join(few.select("_id", "chunk"), F.col("x.id") == F.col("_id"), "left")
    pred = F.struct(F.col("x.rank").alias("rank"), F.coalesce("chunk", F.lit("")).alias("pred_chunk_text"), F.col("x.id").alias("pred_chunk_id"), F.bround("x.score", 3).alias("pred_chunk_score"))
    out = texts.groupBy("query_id", "query", "gt_chunk_id", "gt_rank").agg(F.max(F.when(F.col("x.rank") == 0, F.col("chunk"))).alias("gt"), F.array_sort(F.collect_list(F.when(F.col("x.rank") > 0, pred))).alias("preds"))
    return out.select(
        "query_id", "query", "gt_chunk_id", F.coalesce("gt", F.lit("")).alias("gt_chunk_text"), F.col("gt_rank").alias("gt_chunk_rank"),
        F.transform("preds", lambda p: F.struct(p["pred_chunk_text"].alias("pred_chunk_text"), p["pred_chunk_id"].alias("pred_chunk_id"), p["pred_chunk_score"].alias("pred_chunk_score"), p["rank"].alias("rank"))).alias("pred_chunks"),
    )


def timed(stages: dict[str, Callable[[], DataFrame]]) -> dict[str, float]:
    """Seconds of each stage, run to its end without keeping rows."""
    out = {}
    for name, make in stages.items():
        began = time.monotonic()
        make().write.format("noop").mode("overwrite").save()
        out[name] = time.monotonic() - began
    return out
