"""Analytics over chunks, queries and runs: totals, distances, histograms, context-before-target rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V

NEVER = 2147483647


def doc_totals(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_words, n_tokens, ratio): tokens a word to 6 decimals, NaN for a document without words."""
    c = F.col("chunk")
    sums = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(X.word_count(c)).alias("n_words"), F.sum(X.token_count(c)).alias("n_tokens"))
    # Rounded as a product of doubles, as SQL does: what lies just below an edge between two roundings stays below.
    return sums.withColumn("ratio", F.when(F.col("n_words") > 0, F.round(F.try_divide("n_tokens", "n_words") * 1e6) / 1e6).when(F.col("n_words") == 0, F.lit(float("nan"))))


def describe(df: DataFrame, value: Column, key: str) -> DataFrame:
    """One row: n, mean, exact percentiles by linear interpolation, max and its key (smallest on ties)."""
    v = df.select(value.cast("double").alias("v"), F.col(key).alias("key"))
    p = v.agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.percentile("v", F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99)))).alias("p"), F.max("v").alias("max"), F.min_by("key", F.struct(-F.col("v"), F.col("key"))).alias("argmax"))
    return p.select("n", "mean", *[F.round(F.col("p")[i], 6).alias(f"p{q}") for i, q in enumerate((50, 90, 95, 99))], "max", "argmax")


def context_before_target(ranks: DataFrame) -> DataFrame:
    """Adds acpt and allcpt to rows (target_rank, context_ranks): any, and all, of the context ahead of the target."""
    target = F.coalesce(F.col("target_rank"), F.lit(NEVER))
    ctx = F.transform("context_ranks", lambda r: F.coalesce(r, F.lit(NEVER)))
    return ranks.withColumn("acpt", F.coalesce(F.exists(ctx, lambda r: r < target), F.lit(False))).withColumn("allcpt", F.coalesce((F.size("context_ranks") > 0) & F.forall(ctx, lambda r: r < target), F.lit(False)))


def context_ranks(pairs: DataFrame, run: DataFrame) -> DataFrame:
    """(query_id, target_rank, context_ranks, n_contexts) of pairs (query_id, target_id, context_ids) and a ranked run.

    context_ranks follow the order of context_ids, null where the run lacks one.
    """
    r = run.select("query_id", F.col("chunk_id").alias("id"), "rank")
    ids = F.concat(F.array("target_id"), F.coalesce("context_ids", F.array().cast("array<string>")))  # the target is place 0
    found = pairs.select("query_id", F.posexplode(ids).alias("pos", "id")).join(r, ["query_id", "id"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("rank").alias("r")))).alias("c"))
    ranks = F.transform("c", lambda s: s["r"]["rank"])
    return found.select("query_id", ranks[0].alias("target_rank"), F.slice(ranks, F.lit(2), F.size(ranks)).alias("context_ranks"), (F.size("c") - 1).alias("n_contexts"))


def cumulative_tokens(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("chunk_idx", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.select("doc_id", "chunk_id", "chunk_idx", X.token_count(F.col("chunk")).alias("tok")).withColumn("cum", F.sum("tok").over(w))


def distances(queries: DataFrame, cum: DataFrame) -> DataFrame:
    """(query_id, chunk_distance, token_distance) of queries (query_id, chunk_id, used); token_distance is 0 without used ids."""
    t = queries.join(cum.select("chunk_id", F.col("chunk_idx").alias("t_idx"), F.col("tok").alias("t_tok"), F.col("cum").alias("t_cum")), "chunk_id")
    u = t.select("*", F.explode_outer("used").alias("use_id")).join(cum.select(F.col("chunk_id").alias("use_id"), F.col("chunk_idx").alias("u_idx"), F.col("tok").alias("u_tok"), F.col("cum").alias("u_cum")), "use_id", "left")
    d = F.col("t_cum") - F.col("u_cum")
    apart = F.when(d > 0, d + F.col("u_tok")).otherwise(F.abs(d) + F.col("t_tok"))
    return u.groupBy("query_id").agg(F.max(F.abs(F.col("u_idx") - F.col("t_idx"))).alias("chunk_distance"), F.coalesce(F.max(apart), F.lit(0)).alias("token_distance"))


def power_histogram(df: DataFrame, value: Column, low: int = 6, high: int = 18) -> DataFrame:
    """(lo, hi, n, pct): bins [2^i, 2^(i+1)), the last closed; values outside count nowhere."""
    v = df.select(value.alias("v")).filter((F.col("v") >= 2**low) & (F.col("v") <= 2**high))
    lo = F.lit(2 ** (high - 1))
    for i in range(high - 1, low, -1):
        lo = F.when(F.col("v") < 2**i, 2 ** (i - 1)).otherwise(lo)
    # The edges are tested from the highest down, so the smallest that exceeds the value decides.
    n = v.groupBy(lo.cast("long").alias("lo")).agg(F.count("*").alias("n"))
    return n.select("lo", (F.col("lo") * 2).alias("hi"), "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


def overflow_histogram(df: DataFrame, value: Column, width: int = 15, top: int = 300) -> DataFrame:
    return df.groupBy(F.least(F.floor(value / width), F.lit(top // width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def prompt_budget(chunks: DataFrame, overhead: int = 500, newline: int = 1, budget: int = 264_400) -> DataFrame:
    """cumulative_tokens() with used: running tokens, a separator between chunks, the overhead and the largest chunk of all."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = cumulative_tokens(chunks)
    largest = cum.agg(F.max("tok").alias("largest"))
    used = F.col("cum") + newline * (F.count("*").over(w) - 1) + F.col("largest") + overhead
    return cum.join(F.broadcast(largest)).withColumn("used", used).withColumn("fits", F.col("used") <= budget).drop("largest")


def stratified(df: DataFrame, by: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group in the given order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def overlap_table(df: DataFrame) -> DataFrame:
    """Lexical, sparse and dense likeness of queries (q_w, q_v) to chunk (c_w, c_v) and context (x_w, x_v); null or empty: no row.

    A billionth is added before rounding, so that a value on the edge between two roundings falls on one side whatever the
    order of its sum.
    """
    full = df.filter("size(q_w) > 0 AND size(c_w) > 0 AND size(x_w) > 0")
    out = {}
    for side, name in (("c", "chunk"), ("x", "context")):
        w, v = F.col(f"{side}_w"), F.col(f"{side}_v")
        out |= {f"lexical_{name}": V.sparse_dot(F.col("q_w"), w), f"sparse_{name}": V.sparse_cosine(F.col("q_w"), w), f"dense_{name}": V.cosine(F.col("q_v"), v)}
    return full.select("query_id", *[F.round(c + 1e-9, 6).alias(n) for n, c in out.items()])
