"""Commands over files: python -m chartula.cli COMMAND …"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import funnel, generation, html, metrics, reports, retrieval
from .schemas import ASSURANCE, AUGMENTED, CHUNKS, QUERIES, RESULTS
from .sources import tables

PROVIDERS = ("echo", *generation.SERVICES)


def session() -> SparkSession:
    return SparkSession.builder.appName("chartula").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _say(report: DataFrame) -> None:
    for r in report.collect():
        print(f"{r['stage']}: {r['n_in']} in, {r['n_dropped']} dropped, {r['n_kept']} kept")


def _seq(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.monotonically_increasing_id())


def _provider(a: argparse.Namespace, kind: str) -> generation.Provider:
    return generation.Echo(kind) if a.provider == "echo" else generation.Chat(a.provider, a.model)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    chunks = tables.read_jsonl(spark, a.chunks, CHUNKS)
    raw = tables.read_jsonl(spark, a.queries, QUERIES).select("query", F.col("chunk_id").alias("gt_chunk_id"))
    queries = raw.withColumn("query_id", F.concat_ws("|", "gt_chunk_id", "query")).dropDuplicates(["query_id"])
    if a.encoder == "bm25":
        run = retrieval.bm25_top(queries, chunks, a.depth)
    else:
        model = _encoder(a.encoder)
        asked, items = (retrieval.encode(df, model, "text").drop("text") for df in (queries.select("query_id", F.col("query").alias("text")), chunks.select(F.col("chunk_id").alias("item_id"), F.col("chunk").alias("text"))))
        run = retrieval.dense_top(asked, items, a.depth).withColumnRenamed("item_id", "chunk_id")
    run = run.persist()
    took = metrics.timed({"retrieval": lambda: run, "results": lambda: metrics.result_rows(queries, run, chunks, a.keep)})
    print(", ".join(f"{name}: {seconds:.3f} s" for name, seconds in took.items()))
    metrics.mean_at(run, queries.select("query_id", F.col("gt_chunk_id").alias("chunk_id"))).orderBy("k").show()
    tables.write_jsonl(metrics.result_rows(queries, run, chunks, a.keep).drop("query_id"), a.results)


def _encoder(name: str) -> retrieval.Encoder:
    """hash, or module:name of something that makes an encoder when called."""
    if name == "hash":
        return retrieval.HashEncoder()
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


def _spent(spent: Observation) -> None:
    print(f"calls: {spent.get['calls']}, cost: {spent.get['cost']:.6f}")


def drop_failures(spark, a):
    q = tables.read_jsonl(spark, a.queries, QUERIES)
    kept = funnel.drop_items(funnel.drop_failures(q), a.drop_items or "polish" in a.queries.lower())
    _say(funnel.funnel_counts(q, failures=kept))
    tables.write_jsonl(kept, a.output)


def rank_filter(spark, a):
    q = tables.read_jsonl(spark, a.queries, QUERIES)
    dense, sparse = (_seq(tables.read_jsonl(spark, p, RESULTS)) for p in (a.dense_results, a.sparse_results))
    kept = funnel.rank_filter(q, dense, sparse, a.top_k)
    _say(funnel.funnel_counts(q, ranks=kept))
    tables.write_jsonl(kept, a.output)


def assurance_filter(spark, a):
    q = tables.read_jsonl(spark, a.queries, QUERIES)
    kept = funnel.assurance_filter(q, _seq(tables.read_jsonl(spark, a.assurance, ASSURANCE)))
    _say(funnel.funnel_counts(q, assurance=kept))
    tables.write_jsonl(kept, a.output)


def generate_queries(spark, a):
    p = _provider(a, "query")
    generation.preflight(p)
    done, spent = tables.read_jsonl(spark, a.done, QUERIES) if a.done else None, Observation("generate")
    tables.write_jsonl(generation.generate(tables.read_jsonl(spark, a.chunks, CHUNKS), p, a.template, done=done, update=a.update, spent=spent), a.output)
    _spent(spent)


def assure_queries(spark, a):
    p, spent = _provider(a, "verdict"), Observation("assure")
    generation.preflight(p)
    tables.write_jsonl(generation.assure(tables.read_jsonl(spark, a.queries, QUERIES), p, a.template, spent=spent), a.output)
    _spent(spent)


def _contextualised(spark, a, p: generation.Provider, source: str, target: str, done: DataFrame | None = None) -> None:
    chunks, spent = tables.load(spark, source, "documents"), Observation(f"contextualise {target}")
    out = generation.waterfall(chunks, p, a.window, a.overlap, a.aggregation, spent=spent) if a.waterfall else generation.contextualise(chunks, p, done, spent=spent)
    # Sorting samples its input, which would ask the model twice: so answers are written first, as they come.
    tables.write_jsonl(out, f"{target}.unsorted")
    tables.write_jsonl(tables.read_jsonl(spark, f"{target}.unsorted", AUGMENTED), target, sort_by="chunk_id")
    _spent(spent)


def contextualise(spark, a):
    p = _provider(a, "text")
    generation.preflight(p)
    _contextualised(spark, a, p, a.chunks, a.output, tables.read_jsonl(spark, a.done, AUGMENTED) if a.done else None)


def contextualise_datasets(spark, a):
    """Each named data set below a base folder (<name>/chunks.jsonl) to a data set of that name below the output."""
    p = _provider(a, "text")
    generation.preflight(p)
    for name in a.datasets:
        _contextualised(spark, a, p, f"{a.base}/{name}/chunks.jsonl", f"{a.output}/{name}")


def chunk_document(spark, a):
    pages = spark.read.text(f"{a.input}/*.html", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("stem"), F.col("value").alias("html"))
    tables.write_jsonl(html.html_chunks(pages, selector=a.selector, heading=a.heading), a.output)


def queries_to_dataset(spark, a):
    tables.jsonl_to_parquet(spark, a.queries, QUERIES, a.output)


def report(spark, a):
    with open(a.output, "w", encoding="utf-8") as out:
        if a.kind == "compare":
            q, x, y = tables.read_jsonl(spark, a.input, QUERIES, "skip"), *(tables.read_jsonl(spark, p, RESULTS, "skip") for p in a.results)
            reports.comparison(reports.compared(q, x, y, a.ignore_mismatch), out)
        elif a.kind == "results":
            reports.results(tables.read_jsonl(spark, a.input, RESULTS, "skip"), out)
        else:
            schema = QUERIES if a.kind == "queries" else ASSURANCE
            reports.records(tables.read_jsonl(spark, a.input, schema, "skip"), out, a.kind, reports.PRESETS[a.kind])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chartula")
    sub = top.add_subparsers(required=True)

    def command(name, run, *needed, **options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, value in options.items():
            kind = {"action": "store_true"} if value is False else {"choices": value, "default": value[0]} if isinstance(value, tuple) else {"nargs": "*", "default": []} if value == [] else {"default": value, "type": type(value)}
            p.add_argument(f"--{n.replace('_', '-')}", **kind)

    model = {"provider": PROVIDERS, "model": ""}
    command("eval", evaluate, "chunks", "queries", "results", encoder="bm25", depth=100, keep=10)
    command("eval-model", evaluate, "chunks", "queries", "results", encoder="hash", depth=100, keep=5)
    command("drop-failures", drop_failures, "queries", "output", drop_items=False)
    command("rank-filter", rank_filter, "queries", "dense-results", "sparse-results", "output", top_k=10)
    command("assurance-filter", assurance_filter, "queries", "assurance", "output")
    command("generate-queries", generate_queries, "chunks", "output", "template", done="", update=False, **model)
    command("assure-queries", assure_queries, "queries", "output", "template", **model)
    command("contextualise-dataset", contextualise, "chunks", "output", done="", waterfall=False, window=32_000, overlap=8_000, aggregation=("append", "consolidate"), **model)
    command("contextualise-datasets", contextualise_datasets, "base", "output", datasets=[], waterfall=False, window=32_000, overlap=8_000, aggregation=("append", "consolidate"), **model)
    command("chunk-document", chunk_document, "input", "output", selector="[data-template=xText]", heading="h3")
    command("queries-to-dataset", queries_to_dataset, "queries", "output")
    command("report", report, "input", "output", kind=("queries", "assurance_results", "results", "compare"), results=[], ignore_mismatch=False)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
