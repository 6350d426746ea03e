"""The graph of references between chunks: one and two hops, resolved to text in the order of the references."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


#: How contexts are written.
EXPLICIT = (" (chunk_id: ", ")")
IMPLICIT = ("Chunks with chunk_id: ", " have the implicit context (neighboring chunks): ", " \n")


def lookup(chunks: DataFrame, *more: str) -> DataFrame:
    """(chunk_id, chunk, more): one row an id. Where ids repeat, the last by chunk_idx and text counts."""
    order = F.struct(F.coalesce("chunk_idx", F.lit(-1)), "chunk") if "chunk_idx" in chunks.columns else F.struct("chunk")
    last = chunks.groupBy("chunk_id").agg(F.max_by(F.struct("chunk", *more), order).alias("_last"))
    return last.select("chunk_id", *[F.col(f"_last.{c}").alias(c) for c in ("chunk", *more)])


def candidates(chunks: DataFrame, column: str = "explicit_context_chunks") -> DataFrame:
    return chunks.filter(F.size(F.coalesce(F.col(column), F.array().cast("array<string>"))) > 0)


def edges(chunks: DataFrame, column: str) -> DataFrame:
    """(chunk_id, pos, ref): an edge a reference."""
    return chunks.select("chunk_id", F.posexplode(column).alias("pos", "ref"))


def explicit_context(chunks: DataFrame, column: str = "explicit_context_chunks") -> DataFrame:
    """(chunk_id, context_chunks): texts with their ids, in array order; dangling ids are dropped."""
    found = edges(candidates(chunks, column), column).join(lookup(chunks).select(F.col("chunk_id").alias("ref"), "chunk"), "ref")
    text = F.concat("chunk", F.lit(EXPLICIT[0]), "ref", F.lit(EXPLICIT[1]))
    return found.groupBy("chunk_id").agg(F.collect_list(F.struct("pos", text.alias("text"))).alias("c")).select("chunk_id", X.joined_in_order(F.col("c"), " \n ").alias("context_chunks"))


def implicit_context(chunks: DataFrame, owner_mode: str = "all", explicit: str = "explicit_context_chunks", implicit: str = "implicit_context_chunks") -> DataFrame:
    """(chunk_id, impl_context_chunks): a line for each distinct text two hops away, in the order first seen.

    A line names the explicit chunks that lead to it: all of them, one for each path, or the last only (owner_mode).
    """
    first = edges(candidates(chunks, explicit), explicit).withColumnRenamed("pos", "p1")
    known = lookup(chunks, implicit).withColumn("name", F.sha2("chunk", 256))
    second = known.select(F.col("chunk_id").alias("ref"), F.posexplode(implicit).alias("p2", "far"))
    # Texts are grouped by their hashes; each line gets its text once, after the paths are gathered.
    far = first.join(second, "ref").join(known.select(F.col("chunk_id").alias("far"), "name"), "far")
    paths = far.groupBy("chunk_id", "name").agg(F.array_sort(F.collect_list(F.struct("p1", "p2", "ref"))).alias("paths"), F.min("far").alias("far")).join(known.select(F.col("chunk_id").alias("far"), "chunk"), "far")
    owners = F.array_join(F.transform("paths", lambda p: p["ref"]), ", ") if owner_mode == "all" else F.element_at("paths", -1)["ref"]
    line = F.concat(F.lit(IMPLICIT[0]), owners, F.lit(IMPLICIT[1]), "chunk", F.lit(IMPLICIT[2]))
    lines = paths.select("chunk_id", F.struct(F.col("paths")[0]["p1"].alias("p1"), F.col("paths")[0]["p2"].alias("p2"), line.alias("text")).alias("line"))
    return lines.groupBy("chunk_id").agg(F.collect_list("line").alias("c")).select("chunk_id", X.joined_in_order(F.col("c"), "").alias("impl_context_chunks"))


def target_context(chunks: DataFrame, implicit: str = "implicit_context_chunks") -> DataFrame:
    found = edges(candidates(chunks, implicit), implicit).join(lookup(chunks).select(F.col("chunk_id").alias("ref"), F.col("chunk").alias("text")), "ref")
    return found.groupBy("chunk_id").agg(F.collect_list(F.struct("pos", "text")).alias("c")).select("chunk_id", X.joined_in_order(F.col("c"), " \n ").alias("target_context"))


def within_words(df: DataFrame, columns: tuple[str, ...], most_words: int = 20_000) -> DataFrame:
    """The rows whose columns have at most so many words together."""
    return df.filter(reduce(add, [X.word_count(F.coalesce(F.col(c), F.lit(""))) for c in columns]) <= most_words)


def assembled(chunks: DataFrame, most_words: int = 20_000, owner_mode: str = "all") -> DataFrame:
    """(chunk_id, chunk, context, target_context): both contexts, without rows over the word budget."""
    base = candidates(chunks).select("chunk_id", "chunk")
    rows = base.join(explicit_context(chunks), "chunk_id", "left").join(implicit_context(chunks, owner_mode), "chunk_id", "left").join(target_context(chunks), "chunk_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.select("chunk_id", "chunk", F.concat(empty("context_chunks"), F.lit("\n\n"), empty("impl_context_chunks")).alias("context"), empty("target_context").alias("target_context"))
    return within_words(rows, ("chunk", "context", "target_context"), most_words)


def chains(chunks: DataFrame, hops: int, column: str = "explicit_context_chunks") -> DataFrame:
    """(chunk_id, ref, hop): references within ``hops`` steps, each at its first; bounded joins, no cycle is followed."""
    step = edges(candidates(chunks, column), column).select("chunk_id", "ref").distinct()
    seen = front = step.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        onward = front.select("chunk_id", F.col("ref").alias("via")).join(step.select(F.col("chunk_id").alias("via"), "ref"), "via").select("chunk_id", "ref").distinct()
        front = onward.join(seen.select("chunk_id", "ref"), ["chunk_id", "ref"], "left_anti").filter("ref <> chunk_id").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def seeded(key: Column, seed: int = 42) -> Column:
    """A hash to order rows by, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "chunk_id") -> DataFrame:
    """The n rows with the smallest seeded hashes; 0 keeps all."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(n) if n else df


def reference_distance(chunks: DataFrame, within: int = 300, column: str = "explicit_context_chunks") -> DataFrame:
    """(doc_id, n_refs, pct_near, first_rel, last_rel): share of chunks with all references near, and where such chunks lie."""
    near = F.forall(F.transform(column, X.chunk_idx), lambda x: F.abs(x - F.col("chunk_idx")) < within)
    per = chunks.withColumn("has", F.size(F.coalesce(column, F.array().cast("array<string>"))) > 0).withColumn("near", F.col("has") & near)
    place = F.when(F.col("near"), F.col("chunk_idx"))
    return per.groupBy("doc_id").agg(F.count_if("has").alias("n_refs"), F.count("*").alias("n_chunks"), F.count_if("near").alias("n_near"), F.min(place).alias("lo"), F.max(place).alias("hi")).select(
        "doc_id", "n_refs", F.round(100.0 * F.col("n_near") / F.col("n_chunks"), 6).alias("pct_near"), F.round(F.col("lo") / F.col("n_chunks"), 6).alias("first_rel"), F.round(F.col("hi") / F.col("n_chunks"), 6).alias("last_rel")
    )
