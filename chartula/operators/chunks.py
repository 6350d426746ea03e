"""Identifiers, nesting, merging, context prefixes and token windows of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CONTEXT_FAILURE


def parse_id(df: DataFrame) -> DataFrame:
    """Adds doc_id and internal_id from chunk_id; or, of chunk_ids, doc_id of the first, internal_ids and the ids as chunk_id.

    An id among several must have exactly one underscore, else the row raises. Neither column: ValueError.
    """
    if "chunk_id" in df.columns:
        return df.withColumns({"doc_id": X.doc_id(F.col("chunk_id")), "internal_id": X.internal_id(F.col("chunk_id"))})
    if "chunk_ids" not in df.columns:
        raise ValueError("chunk_id or chunk_ids is needed")
    parts = F.transform("chunk_ids", lambda i: F.split(i, "_"))
    bad = F.exists(parts, lambda p: F.size(p) != 2)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("ids need exactly one underscore: "), F.array_join("chunk_ids", ", ")))).otherwise(parts)
    return df.withColumn("_parts", checked).withColumns({"doc_id": F.col("_parts")[0][0], "internal_ids": F.transform("_parts", lambda p: p[1]), "chunk_id": F.col("chunk_ids")}).drop("_parts", "chunk_ids")


def with_chunk_idx(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_idx", X.chunk_idx(F.col("chunk_id")))


def add_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


def nest(df: DataFrame, by: str = "doc_id", order: str = "chunk_idx") -> DataFrame:
    """(doc_id, chunks, chunk_ids) with both lists in the order of chunk_idx, then chunk_id."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "chunk_id", "chunk"))).alias("rows"))
    return rows.select(by, F.transform("rows", lambda r: r["chunk"]).alias("chunks"), F.transform("rows", lambda r: r["chunk_id"]).alias("chunk_ids"))


def unnest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode(F.arrays_zip("chunks", "chunk_ids")).alias("pos", "row")).select("doc_id", "pos", F.col("row.chunk_ids").alias("chunk_id"), F.col("row.chunks").alias("chunk"))


def merge_documents(df: DataFrame, separator: str = "\n") -> DataFrame:
    return nest(df).select("doc_id", F.array_join("chunks", separator).alias("document"))


def prepend_context(df: DataFrame, context: str = "context") -> DataFrame:
    return df.withColumn("chunk", F.concat(F.col(context), F.lit(" "), F.col("chunk")))


def check_windows(window: int, overlap: int) -> None:
    if overlap >= window:
        raise ValueError("overlap must be smaller than the window")


def windows(df: DataFrame, text: Column, window: int = 32_000, overlap: int = 8_000, pieces: X.Analyzer = X.pieces) -> DataFrame:
    """One row a window of the text as it stands, with win (from 0) and n_tokens; up to ``window`` tokens are one window.

    pieces cuts the text, a token a piece (X.pieces_of for a tokenizer). A window's text has no white space at its ends; a
    text without a token has one window, which is empty.
    """
    check_windows(window, overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_pieces") - F.lit(overlap + 1), F.lit(0)), F.lit(window - overlap))
    cut = df.withColumn("_pieces", pieces(text)).select(*df.columns, "_pieces", F.posexplode(starts).alias("win", "_start"))
    mine = F.slice("_pieces", F.col("_start") + 1, F.lit(window))
    return cut.withColumns({"n_tokens": F.size(mine), "window_text": X.strip(F.array_join(mine, ""))}).drop("_pieces", "_start")


def chunk_window_pairs(chunks: DataFrame, wins: DataFrame) -> DataFrame:
    return chunks.join(wins.withColumn("cache_id", F.concat_ws("_w", "doc_id", "win")), "doc_id")


def aggregate_windows(df: DataFrame, mode: str = "all") -> DataFrame:
    """(chunk_id, context) of rows (chunk_id, win, response): valid responses, stripped, in order, joined by a blank line.

    mode all: the failure sentinel if no response is valid; any: if one is not.
    """
    ok = F.coalesce((F.col("response") != "") & ~F.col("response").startswith(CONTEXT_FAILURE[:-1]), F.lit(False))
    rows = df.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.when(ok, F.struct("win", X.strip(F.col("response")).alias("text"))))).alias("valid"), F.count("*").alias("n"),
    )
    failed = F.size("valid") == 0 if mode == "all" else F.size("valid") < F.col("n")
    return rows.select("chunk_id", F.when(failed, F.lit(CONTEXT_FAILURE)).otherwise(F.concat(F.array_join(F.transform("valid", lambda s: s["text"]), "\n\n"), F.lit("\n\n"))).alias("context"))
