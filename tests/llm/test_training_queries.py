"""The queries of the training-data operators against their SQL, and the pipeline against brute force, on the smallest tables."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from test_edges import ROWS, brute_print, components, frame, late, words

import corpus_pipeline
from chartula.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    want = c.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted(str([r[x] for x in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_pipeline_stages(spark):
    """Each stage on what the one before it kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        seen[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    start, quality, exact, near, mixed, packed = (seen[n] for n in ["start", *names])
    assert {r.doc_id for r in quality} == {r.doc_id for r in registry.QUERIES["op3_quality_rules"](spark, SF).filter("kept").collect()} and len(quality) < len(start)
    keep = defaultdict(list)
    for r in quality:
        keep[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(max(ids, key=late) for ids in keep.values())
    of = components([(r.doc_id, brute_print(r.text)) for r in exact])
    assert sorted(r.doc_id for r in near) == sorted({of[brute_print(r.text)] for r in exact})
    times, size, texts = Counter(r.doc_id for r in mixed), Counter(), {r.doc_id: r for r in near}
    assert set(times) <= set(texts) and max(times.values()) <= 2
    for r in near:
        size[r.source] += len(words(r.text))
    taken = sum(times[i] * len(words(texts[i].text)) for i in times)
    assert abs(taken / (1.5 * sum(size.values())) - 1) < 0.15
    pieces = Counter(r.doc_id for r in packed if r.piece == 0)
    assert pieces == times
    bins = defaultdict(int)
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 1024 and len(bins) <= sum(bins.values()) / 1024 * 1.05 + 8


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_held_out_texts_cost_less_than_the_base(spark, scale):
    folder = f"/root/testdata/{scale}"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    r = registry.QUERIES["op8_context_mixing"](spark, folder).filter("held_out").selectExpr("sum(score) AS score", "sum(base_score) AS base").first()
    assert r.score > r.base


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated ids and rows, missing and extra columns: each stage on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    odd = frame(spark, ROWS)
    none = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.drop("lang", "source"), none):
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() == 0 if docs is none else out.count() >= 0
    # One row a text; the text of a repeated id is lost with no row of another.
    rows = [(1, "A", "en", "a"), (2, "A", "en", "a"), (1, "B", "en", "a"), (5, "C", "en", "a"), (5, "C", "en", "a"), (5, "C", "de", "a"), (None, "D", "en", "a"), (None, "D", "en", "a"), (None, None, "en", "a"), (7, "", "en", "a")]
    got = stages["exact_dedup"](spark, frame(spark, rows), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.lang) for r in got) == [(0, "D", "en"), (1, "B", "en"), (2, "A", "en"), (5, "C", "de"), (7, "", "en")]
    text = " ".join(f"word{i * 7 % 311}" for i in range(300))
    other = " ".join(f"term{i * 11 % 307}" for i in range(300))
    rows = [(4, text, "en", "a"), (4, text, "en", "a"), (9, text + " more", "en", "a"), (None, text, "en", "a"), (None, other, "en", "a"), (None, other, "en", "a"), (4, other + " x " * 3 + text, "en", "a")]
    got = stages["near_dedup"](spark, frame(spark, rows), SF).collect()
    of = components([(i, brute_print(t)) for i, (_, t, *_) in enumerate(rows)])
    assert len(got) == len(set(of.values())) and (4, text) in {(r.doc_id, r.text) for r in got}
    # Copies follow the row and its source, not the id alone.
    rows = [(1, "one two three", "en", s) for s in ("a", "b", None)] + [(i, "x y z", "en", "b") for i in range(2, 40)]
    mixed = stages["mix_sources"](spark, frame(spark, rows), SF).collect()
    assert max(Counter((r.doc_id, r.source) for r in mixed).values()) <= 2
    # Failing lines go, clean documents stay as they are.
    prose = "\n".join(f"The {i} first line of plain prose says {i * 37} things about word{i * 13} and term{i * 29}." for i in range(12)) + "\n\n"
    rows = [(1, prose, "en", "a"), (2, prose + "Home | News | Shop | Login | to | site\n", "en", "a")]
    got = {r.doc_id: r for r in stages["quality_rules"](spark, frame(spark, rows), SF).collect()}
    assert got[1].text == prose and "Home" not in got[2].text and all(r.n_chars == len(r.text) for r in got.values())


def test_pipeline_run(spark):
    assert zlib.crc32(b"") == 0 and corpus_pipeline.run(spark, SF).columns[:2] == ["doc_id", "piece"]
