"""The engine's tables, derived from the driver's: chunks with references, known-item queries, vectors, results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import QUERY_FAILURE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents. References by arithmetic over the place i of n: (7i+3) mod n and (13i+5) mod n; neighbours."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("i", "chunk"), F.size(F.split("text", "\n")).alias("n"))
    far = F.filter(F.array_distinct(F.array(F.expr("(i * 7 + 3) % n"), F.expr("(i * 13 + 5) % n"))), lambda x: x != F.col("i"))
    near = F.filter(F.array(F.col("i") - 1, F.col("i") + 1), lambda x: (x >= 0) & (x < F.col("n")))
    name = lambda x: F.concat_ws("_", F.col("doc_id"), x.cast("string"))
    return lines.select("doc_id", name(F.col("i")).alias("chunk_id"), "chunk", F.col("i").alias("chunk_idx"), F.transform(far, name).alias("explicit_context_chunks"), F.transform(near, name).alias("implicit_context_chunks"))


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the second line (of the only one, where there is one) of every twentieth document: the stated query set
    of a search. A line without a word is a query that nothing answers."""
    lines = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select("doc_id", F.split("text", "\n").alias("s"))
    at = F.least(F.lit(2), F.size("s"))
    name = F.concat_ws("_", F.col("doc_id").cast("string"), (at - 1).cast("string"))
    return lines.select(name.alias("query_id"), F.array_join(X.tokens(F.element_at("s", at)), " ").alias("query"), name.alias("gt_chunk_id"))


def funnel_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query row for each chunk, its words; those of every seventh document failed to be generated."""
    words = F.array_join(X.tokens(F.col("chunk")), " ")
    return chunks(spark, sf_dir).select("doc_id", "chunk_id", "chunk", F.when(F.col("doc_id").cast("long") % 7 == 0, QUERY_FAILURE).otherwise(words).alias("query"))


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place for files of that name in the folder that executors share: spark.checkpoint.dir, or else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def funnel_results(spark: SparkSession, sf_dir: str, a: int, b: int) -> DataFrame:
    """Made-up ranks (doc * a) mod b + 1, null from 21 on, in two rows a query of which the later counts."""
    q = funnel_queries(spark, sf_dir).select("query", F.col("chunk_id").alias("gt_chunk_id"), F.expr(f"CAST(CAST(doc_id AS BIGINT) * {a} % {b} + 1 AS INT)").alias("r"))
    return q.select("query", "gt_chunk_id", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit(1).alias("r")), F.struct(F.lit(1).alias("seq"), F.col("r").alias("r")))).alias("x")).select("query", "gt_chunk_id", "x.seq", F.when(F.col("x.r") <= 20, F.col("x.r")).alias("gt_chunk_rank"))


def assurance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("1")).alias("chunk_id"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("passes_assurance"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector", "label")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_id, chunk_idx, weights): term counts over the length, a stand-in for learned weights."""
    t = chunks(spark, sf_dir).select("doc_id", "chunk_id", "chunk_idx", X.tokens(F.col("chunk")).alias("t"))
    per = t.select("doc_id", "chunk_id", "chunk_idx", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "chunk_id", "chunk_idx", "dl", "term").agg((F.count("*") / F.first("dl")).alias("w"))
    return per.groupBy("doc_id", "chunk_id", "chunk_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "w")))).alias("weights"))


#: DuckDB equivalents, as common table expressions.
CH = "ch AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS d, concat(doc_id, '_', i) AS chunk_id, chunk, CAST(i AS INT) AS chunk_idx, n, (i * 7 + 3) % n AS e1, (i * 13 + 5) % n AS e2 FROM (SELECT doc_id, unnest(s) AS chunk, generate_subscripts(s, 1) - 1 AS i, len(s) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"
EX = "ex AS (SELECT chunk_id, 0 AS pos, concat(doc_id, '_', e1) AS ref, e1 AS r FROM ch WHERE e1 <> chunk_idx UNION ALL SELECT chunk_id, 1 AS pos, concat(doc_id, '_', e2), e2 FROM ch WHERE e2 <> chunk_idx AND e2 <> e1)"
IM = "im AS (SELECT chunk_id, 0 AS pos, concat(doc_id, '_', chunk_idx - 1) AS ref FROM ch WHERE chunk_idx > 0 UNION ALL SELECT chunk_id, 1 AS pos, concat(doc_id, '_', chunk_idx + 1) FROM ch WHERE chunk_idx + 1 < n)"
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
WORDS = f"array_to_string({TOK.format('chunk')}, ' ')"
QA = f"qa AS (SELECT chunk_id AS query_id, {WORDS} AS query, chunk_id AS gt_chunk_id FROM ch WHERE chunk_idx = least(1, n - 1) AND d % 20 = 0)"
TK = f"tk AS (SELECT chunk_id, unnest({TOK.format('chunk')}) AS term FROM ch), dl AS (SELECT chunk_id, count(*) AS dl FROM tk GROUP BY 1), tf AS (SELECT term, chunk_id, count(*) AS tf FROM tk GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT CAST((SELECT count(*) FROM ch) AS DOUBLE) AS n, (SELECT count(*) FROM tk) AS total)"
PO = "po AS (SELECT tf.term, tf.chunk_id, tf, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / (total / n))) AS weight FROM tf JOIN df USING (term) JOIN dl USING (chunk_id), st)"
RUN = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS term FROM qa) GROUP BY 1, 2), sc AS (SELECT query_id, chunk_id, round(sum(qtf * weight), 6) AS score FROM qt JOIN po USING (term) GROUP BY 1, 2), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sc)"
BM = ", ".join([CH, QA, TK, PO, RUN])
FQ = f"fq AS (SELECT doc_id, d, chunk_id, chunk, CASE WHEN d % 7 = 0 THEN '{QUERY_FAILURE}' ELSE {WORDS} END AS query FROM ch)"
FR = "fr AS (SELECT *, CASE WHEN d * 7 % 23 + 1 <= 20 THEN CAST(d * 7 % 23 + 1 AS INT) END AS dense_rank, CASE WHEN d * 11 % 37 + 1 <= 20 THEN CAST(d * 11 % 37 + 1 AS INT) END AS sparse_rank FROM fq)"
CUM = f"tc AS (SELECT doc_id, chunk_id, chunk_idx, CAST(len({TOK.format('chunk')}) AS BIGINT) AS tok FROM ch), cum AS (SELECT *, CAST(sum(tok) OVER (PARTITION BY doc_id ORDER BY chunk_idx, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM tc)"
VEC = "v AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings), vs AS (SELECT q.item_id AS query_id, q.label AS ql, v.item_id, v.label, round(list_dot_product(q.vector, v.vector), 6) AS score FROM v q, v WHERE q.item_id % 20 = 0), vr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM vs), vn AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank) FROM vs0), vj AS (SELECT *, CAST(ql = label AS INT) AS rel FROM vn)".replace("vn AS (SELECT * REPLACE", "vs0 AS (SELECT * FROM vr WHERE query_id <> item_id), vn AS (SELECT * REPLACE")
WT = "wt AS (SELECT tf.chunk_id, ch.doc_id, ch.chunk_idx, term, tf / dl AS w FROM tf JOIN dl USING (chunk_id) JOIN ch USING (chunk_id))"
