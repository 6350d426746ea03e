import json

import pytest

from chartula import cli
from chartula.schemas import QUERY_FAILURE
from chartula.sources import tables
from chartula.streaming.resume import run_new


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_drifting_json(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", [{"chunk_id": "a_1", "u": ["x"]}, "", {"chunk_id": "a_2", "u": "str"}])
    kept = tables.read_jsonl(spark, path, "chunk_id string, u array<string>", "keep")
    rows = {r.chunk_id: r for r in kept.collect()}
    assert len(rows) == 2 and rows["a_2"].u is None and rows["a_2"]._corrupt_record and tables.count_malformed(kept) == 1
    assert len(tables.read_jsonl(spark, path, "chunk_id string, u array<string>", "skip").collect()) == 1
    with pytest.raises(Exception):
        tables.read_jsonl(spark, path, "chunk_id string, u array<string>").collect()


def test_load_and_registry(spark, tmp_path):
    path = lines(tmp_path / "c.jsonl", [{"chunk_id": "d_1", "chunk": "æø"}])
    r = tables.Registry()
    r.add("mine", path, "documents")
    got = r.load(spark, ["mine", "other"])
    assert list(got) == ["mine"] and got["mine"].first().doc_id == "d" and spark.table("mine").count() == 1
    with pytest.raises(ValueError):
        tables.load(spark, path, "pictures")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("b_1", 'quote " and\nline'), ("a_1", "é")], "chunk_id string, chunk string")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "csv"), "chunk_id string, chunk string").collect())) == sorted(map(tuple, df.collect()))
    tables.write_jsonl(df, str(tmp_path / "j"), sort_by="chunk_id")
    assert [r.chunk_id for r in tables.read_jsonl(spark, str(tmp_path / "j"), "chunk_id string, chunk string").collect()] == ["a_1", "b_1"]


def test_tree_and_merge(spark, tmp_path):
    for cluster, name in (("a", "one"), ("b", "two")):
        d = tmp_path / f"cluster_{cluster}" / name
        d.mkdir(parents=True)
        lines(d / "chunks.jsonl", [{"chunk_id": f"{name}_0"}, ""])
    got = tables.read_tree(spark, f"{tmp_path}/cluster_*/*", "chunk_id string").collect()
    assert {(r.doc_id, r.chunk_id) for r in got} == {("a-one", "one_0"), ("b-two", "two_0")}
    assert tables.merge(spark, [f"{tmp_path}/cluster_a/one", f"{tmp_path}/cluster_b/two"], "chunk_id string, more int").count() == 2


def test_resume(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    stage = lambda df: df.selectExpr("chunk_id", "upper(chunk) AS chunk")
    schema = "chunk_id string, chunk string"
    spark.createDataFrame([("a", "x")], schema).write.mode("append").parquet(src)
    assert run_new(spark, src, schema, stage, out, mark) == 1
    spark.createDataFrame([("b", "y"), ("a", "again")], schema).write.mode("append").parquet(src)
    run_new(spark, src, schema, stage, out, mark)
    assert run_new(spark, src, schema, stage, out, mark) == 0
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", "X"), ("b", "Y")]


def test_commands(spark, tmp_path):
    chunks = lines(tmp_path / "chunks.jsonl", [{"chunk_id": f"d_{i}", "chunk": f"word{i} common text", "chunk_idx": i, "explicit_context_chunks": ["d_0"] if i else [], "implicit_context_chunks": []} for i in range(4)])
    queries = lines(tmp_path / "queries.jsonl", [{"chunk_id": "d_1", "query": "word1", "chunk": "c"}, {"chunk_id": "d_2", "query": QUERY_FAILURE, "chunk": "c"}])
    run = lambda *a: cli.main([str(x) for x in a])
    run("drop-failures", "--queries", queries, "--output", tmp_path / "ok")
    assert spark.read.json(str(tmp_path / "ok")).count() == 1
    run("eval", "--chunks", chunks, "--queries", queries, "--results", tmp_path / "res")
    assert spark.read.json(str(tmp_path / "res")).filter("gt_chunk_rank = 1").count() == 1
    run("rank-filter", "--queries", queries, "--dense-results", tmp_path / "res", "--sparse-results", tmp_path / "res", "--output", tmp_path / "hard")
    assert {r["query"] for r in spark.read.json(str(tmp_path / "hard")).collect()} == {QUERY_FAILURE}
    run("generate-queries", "--chunks", chunks, "--output", tmp_path / "gen", "--template", "query_r9")
    assert spark.read.json(str(tmp_path / "gen")).count() == 3
    run("assure-queries", "--queries", tmp_path / "gen", "--output", tmp_path / "sure", "--template", "assurance_r10")
    run("assurance-filter", "--queries", tmp_path / "gen", "--assurance", tmp_path / "sure", "--output", tmp_path / "ctx")
    run("contextualise-dataset", "--chunks", chunks, "--output", tmp_path / "aug")
    assert spark.read.json(str(tmp_path / "aug")).count() == 4
    (tmp_path / "base" / "one").mkdir(parents=True)
    (tmp_path / "base" / "one" / "chunks.jsonl").write_bytes(open(chunks, "rb").read())
    run("contextualise-datasets", "--base", tmp_path / "base", "--datasets", "one", "--output", tmp_path / "all", "--waterfall")
    assert [r.chunk_id for r in spark.read.json(str(tmp_path / "all" / "one")).collect()] == [f"d_{i}" for i in range(4)]
    run("eval", "--chunks", chunks, "--queries", queries, "--results", tmp_path / "res2", "--encoder", "chartula.operators.retrieval:HashEncoder")
    assert spark.read.json(str(tmp_path / "res2")).count() == 2
    run("report", "--input", queries, "--output", tmp_path / "r.html")
    assert (tmp_path / "r.html").read_text().startswith("<!doctype html>")
    run("report", "--input", tmp_path / "res", "--output", tmp_path / "r2.html", "--kind", "results")
    assert "d_1" in (tmp_path / "r2.html").read_text()
    run("report", "--input", queries, "--output", tmp_path / "r3.html", "--kind", "compare", "--results", tmp_path / "res", tmp_path / "res", "--ignore-mismatch")
    assert "green" in (tmp_path / "r3.html").read_text()
    run("queries-to-dataset", "--queries", queries, "--output", tmp_path / "pq")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
    page = tmp_path / "pages"
    page.mkdir()
    (page / "one.html").write_text("<h1>T</h1><p data-template=xText>x</p>")
    run("chunk-document", "--input", page, "--output", tmp_path / "ch")
    assert {r.chunk_id for r in spark.read.json(str(tmp_path / "ch")).collect()} == {"one_0", "one_1"}
