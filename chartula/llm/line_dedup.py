"""Line dedup: hashed lines in ranges, first occurrences streamed, compressed bitmaps of the lines to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lower_ascii, strip, whole, written

#: Runs into which the occurrences of one line may be dealt.
SALTS = 64


def keyed_lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): 128 hash bits for each line whose key has ``least`` code points or more."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(lower_ascii(strip(x)).alias("key"), i.alias("pos")))
    rows = docs.select("doc_id", whole().alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.filter(lines, lambda x: F.length(x.key) >= least)).alias("line"))
    return rows.select("doc_id", "text_hash", "line.pos", F.xxhash64("line.key").alias("h1"), F.xxhash64(F.lit(1), "line.key").alias("h2"))


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, text_hash, keep): for documents that lose lines, a compressed bitmap: word number to 64 bits, 1: the line stays.

    A key of at least ``least`` code points goes from every document but the one with the smallest id; repeats inside
    that one stay. Hashes are range-partitioned with a salt taken from the document and sorted by document and position:
    a line that a third of all documents hold is cut into many ranges. In each run the first document is streamed ahead:
    lines of later ones go at once. Only the run's first document is undecided; one row each, at most SALTS a line, meets
    the other runs of the line. Words of all ones aren't stored, nor are
    bitmaps of nothing else.

    Null ids count as one document after all others; rows that repeat id and text share their bitmap.
    """
    lines = written(keyed_lines(docs, least)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    late = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    seen = lines.repartitionByRange("h1", "h2", "salt").withColumn("first", F.first(late).over(run)).select("doc_id", "text_hash", "pos", "h1", "h2", late.alias("own"), "first")
    seen = written(seen)
    again = seen.filter(F.col("own") > F.col("first")).select("doc_id", "text_hash", "pos")
    heads = seen.filter(F.col("own") == F.col("first")).groupBy("h1", "h2", "doc_id", "text_hash").agg(F.collect_set("pos").alias("at"), F.first("own").alias("own"))
    later = heads.withColumn("least", F.min("own").over(Window.partitionBy("h1", "h2"))).filter(F.col("own") > F.col("least")).select("doc_id", "text_hash", F.explode("at").alias("pos"))
    word = F.col("pos").cast("long")
    bits = again.unionByName(later).groupBy("doc_id", "text_hash", F.shiftright(word, 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, CAST(pos % 64 AS INT))"))).alias("bits"))
    return bits.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the text with its other lines, joined by a line feed.

    Null and empty texts are one empty line. The texts are shuffled once, not sorted: the bitmaps are the hashed side.
    """
    texts = docs.select("doc_id", whole().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    maps = keep_bitmaps(docs, least).withColumnRenamed("doc_id", "of").withColumnRenamed("text_hash", "of_hash").hint("shuffle_hash")
    joined = texts.join(maps, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left").select("doc_id", F.split("text", "\n").alias("lines"), "keep")
    bits = F.expr("CASE WHEN keep IS NULL THEN lines ELSE filter(lines, (x, i) -> (shiftright(coalesce(keep[CAST(shiftright(i, 6) AS BIGINT)], -1L), i % 64) & 1L) = 1L) END")
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), bits.alias("left")).select("doc_id", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
first AS (SELECT key, min(doc_id) AS doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
kept AS (SELECT k.*, coalesce(k.doc_id > f.doc, false) AS gone FROM keyed k LEFT JOIN first f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
