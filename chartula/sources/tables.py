"""Readers and writers of the tables between stages: JSON lines, Parquet, CSV, directory trees, embedding caches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import parse_id
from ..schemas import CHUNKS, QUERIES

CORRUPT = "_corrupt_record"
KINDS = {"queries": QUERIES, "documents": CHUNKS}


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped.

    strict: the first bad line ends the read; skip: bad lines are left out (as soon as a column is read: a bare count
    parses none); keep: they stay, with their text in
    _corrupt_record, so they can be counted.
    """
    options = {"strict": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}
    if mode == "keep":
        return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", options[mode]).json(path)


def count_malformed(kept: DataFrame) -> int:
    """Bad lines of a read in mode keep. The read is cached for it, as Spark doesn't count the bare column off a file."""
    cached = kept.cache()
    try:
        return cached.filter(F.col(CORRUPT).isNotNull()).count()
    finally:
        cached.unpersist()


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """queries or documents from JSON lines, with doc_id and internal_id; other kinds: ValueError."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}, not {kind!r}")
    return parse_id(read_jsonl(spark, path, KINDS[kind]))


def load_saved(spark: SparkSession, path: str) -> DataFrame:
    return parse_id(spark.read.parquet(path))


def write_jsonl(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    (df.orderBy(sort_by) if sort_by else df).write.mode("overwrite").json(path)


def jsonl_to_parquet(spark: SparkSession, source: str, schema: str, target: str, partition_by: tuple[str, ...] = ()) -> None:
    read_jsonl(spark, source, schema).write.mode("overwrite").partitionBy(*partition_by).parquet(target)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_tree(spark: SparkSession, pattern: str, schema: str, file: str = "chunks.jsonl") -> DataFrame:
    """Every cluster_<letter>/<dataset>/<file> below a pattern; doc_id is <letter>-<dataset>."""
    place = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(rf"cluster_([^/]+)/([^/]+)/{file}"), F.lit(0))
    parts = F.split(F.element_at(place, -1), "/")
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{pattern}/{file}")
    return raw.select("*", F.concat_ws("-", F.regexp_replace(parts[0], "^cluster_", ""), parts[1]).alias("doc_id"))


def merge(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """All rows of all files; a column that a file lacks is null there."""
    return read_jsonl(spark, paths, schema)


def cache_embeddings(df: DataFrame, path: str) -> None:
    df.select("chunk_id", "vector").write.mode("overwrite").parquet(path)


def with_cached(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks with their cached vectors, joined by id; the order of rows doesn't matter."""
    return chunks.join(chunks.sparkSession.read.parquet(path), "chunk_id", "left")


@dataclass
class Registry:
    """Named datasets: name to path, kind and format."""

    entries: dict[str, dict] = field(default_factory=dict)

    def add(self, name: str, path: str, kind: str, saved: bool = False) -> None:
        self.entries[name] = {"path": path, "kind": kind, "saved": saved}

    def load(self, spark: SparkSession, names: list[str]) -> dict[str, DataFrame]:
        """The known ones among the names, also as temporary views; unknown names are skipped."""
        out = {}
        for name in names:
            if (e := self.entries.get(name)) is not None:
                out[name] = load_saved(spark, e["path"]) if e["saved"] else load(spark, e["path"], e["kind"])
                out[name].createOrReplaceTempView(name)
        return out
