"""Reports: badges, presence of queries in several runs, and HTML pages streamed from sorted rows."""

from __future__ import annotations

from collections.abc import Iterable
from html import escape
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "body{font-family:sans-serif;margin:2em}td{vertical-align:top;padding:4px;border-bottom:1px solid #ccc}.green{background:#bdb}.amber{background:#fd9}.red{background:#f99}"
PRESETS = {"queries": ("chunk", "context_chunks", "impl_context_chunks"), "assurance_results": ("answer_to_query",)}


def badge(rank: Column) -> Column:
    return F.when(rank == 1, "green").when(rank <= 5, "amber").otherwise("red")


def presence(queries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(query, in_a, in_b, common) for each distinct query."""
    mark = lambda df, n: df.select("query").distinct().withColumn(n, F.lit(True))
    both = queries.select("query").distinct().join(mark(a, "in_a"), "query", "left").join(mark(b, "in_b"), "query", "left").fillna(False, ["in_a", "in_b"])
    return both.withColumn("common", F.col("in_a") & F.col("in_b"))


def compared(queries: DataFrame, a: DataFrame, b: DataFrame, ignore_mismatch: bool = False) -> DataFrame:
    """Rows of the queries that all three have; a query that one lacks is an error unless ignored."""
    p = presence(queries, a, b)
    if not ignore_mismatch and (n := p.filter("NOT common").count()):
        raise ValueError(f"{n} queries are not in both results")
    one = lambda df, n: df.select("query", F.struct(*[c for c in df.columns if c != "query"]).alias(n))
    return queries.join(p.filter("common").select("query"), "query", "left_semi").join(one(a, "a"), "query").join(one(b, "b"), "query").orderBy("chunk_id", "query")


def _page(out: TextIO, title: str, rows: Iterable[str]) -> int:
    n = 0
    out.write(f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1><table>\n")
    for row in rows:
        n += 1
        out.write(f"<tr>{row}</tr>\n")
    out.write("</table>\n")
    return n


def records(df: DataFrame, out: TextIO, title: str = "records", large: tuple[str, ...] = PRESETS["queries"]) -> int:
    """A row a record, large fields folded. Rows come one partition at a time."""

    def cell(name: str, value) -> str:
        text = escape(str(value))
        return f"<td><details><summary>{escape(name)}</summary>{text}</details></td>" if name in large else f"<td>{text}</td>"

    return _page(out, title, ("".join(cell(n, r[n]) for n in df.columns) for r in df.orderBy("chunk_id").toLocalIterator()))


def results(df: DataFrame, out: TextIO, title: str = "results") -> int:
    def row(r) -> str:
        preds = "".join(f"<li>{p['pred_chunk_score']:.3f} {escape(str(p['pred_chunk_id']))} {escape(str(p['pred_chunk_text']))}</li>" for p in r["pred_chunks"])
        return f"<td>{escape(r['query'])}</td><td>{escape(str(r['gt_chunk_id']))} {escape(r['gt_chunk_text'])}</td><td><ol>{preds}</ol></td>"

    return _page(out, title, map(row, df.orderBy("gt_chunk_id", "query").toLocalIterator()))


def comparison(df: DataFrame, out: TextIO, title: str = "comparison") -> int:
    """compared() in three columns, ranks (gt_chunk_rank) with their badge."""

    def mark(rank) -> str:
        return f"<span class={'green' if rank == 1 else 'amber' if rank is not None and rank <= 5 else 'red'}>{'none' if rank is None else rank}</span>"

    return _page(out, title, (f"<td>{escape(str(r['query']))}</td><td>{mark(r['a']['gt_chunk_rank'])}</td><td>{mark(r['b']['gt_chunk_rank'])}</td>" for r in df.toLocalIterator()))
