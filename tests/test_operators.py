"""Hand-computed cases of the operators that SQL can't check, and invariants of those that it can."""

import io
import json
import math
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chartula.functions import text as X
from chartula.operators import analysis, chunks, context, funnel, generation, html, metrics, products, reports, retrieval
from chartula.schemas import CONTEXT_FAILURE, CONTEXT_TOO_LONG, PARSING_FAILURE, QUERY_FAILURE, query_answer, verdict_answer


def test_parse_id(spark):
    rows = [("police_1208",), ("barnetslov_§49_stk3",), ("classified_information_588",)]
    got = chunks.parse_id(spark.createDataFrame(rows, "chunk_id string")).collect()
    assert [(r.doc_id, r.internal_id) for r in got] == [("police", "1208"), ("barnetslov", "§49-stk3"), ("classified", "information-588")]
    many = chunks.parse_id(spark.createDataFrame([(["d_1", "d_2"],)], "chunk_ids array<string>")).first()
    assert (many.doc_id, many.internal_ids, many.chunk_id) == ("d", ["1", "2"], ["d_1", "d_2"])
    with pytest.raises(Exception, match="one underscore"):
        chunks.parse_id(spark.createDataFrame([(["a_b_1"],)], "chunk_ids array<string>")).collect()
    with pytest.raises(ValueError):
        chunks.parse_id(spark.createDataFrame([(1,)], "x int"))


GRAPH = [("d_0", "T0", 0, [], ["d_1"]), ("d_1", "T1", 1, [], []), ("d_2", "T2", 2, ["d_0", "d_9", "d_4"], ["d_1", "d_3"]), ("d_3", "T3", 3, None, []), ("d_4", "T4", 4, [], ["d_3", "d_1"])]


@pytest.fixture()
def graph(spark):
    return spark.createDataFrame(GRAPH, "chunk_id string, chunk string, chunk_idx int, explicit_context_chunks array<string>, implicit_context_chunks array<string>")


def test_context_graph(graph):
    assert [r.chunk_id for r in context.candidates(graph).collect()] == ["d_2"]
    assert context.explicit_context(graph).collect()[0].context_chunks == "T0 (chunk_id: d_0) \n T4 (chunk_id: d_4)"
    head, tail = "Chunks with chunk_id: ", " have the implicit context (neighboring chunks): "
    assert context.implicit_context(graph).collect()[0].impl_context_chunks == f"{head}d_0, d_4{tail}T1 \n{head}d_4{tail}T3 \n"
    assert context.implicit_context(graph, "last").collect()[0].impl_context_chunks == f"{head}d_4{tail}T1 \n{head}d_4{tail}T3 \n"
    assert {r.chunk_id: r.target_context for r in context.target_context(graph).collect()}["d_2"] == "T1 \n T3"
    assert context.assembled(graph).count() == 1 and context.assembled(graph, most_words=3).count() == 0
    assert context.sample(graph, 2).count() == 2 and context.sample(graph, 0).count() == 5


@pytest.mark.parametrize("n, starts", [(4, [0]), (5, [0, 3]), (7, [0, 3]), (8, [0, 3, 6]), (0, [0])])
def test_windows(spark, n, starts):
    df = spark.createDataFrame([("d", " ".join(f"t{i}" for i in range(n)))], "doc_id string, t string")
    got = chunks.windows(df, F.col("t"), 4, 1).orderBy("win").collect()
    assert [r.window_text.split()[:1] for r in got] == [[f"t{s}"] if n else [] for s in starts]
    assert {w for r in got for w in r.window_text.split()} == {f"t{i}" for i in range(n)}


class Letters:
    """A tokenizer of single characters other than spaces."""

    def offsets(self, text):
        return [(i, i + 1) for i, c in enumerate(text) if c != " "]


def test_windows_keep_the_text(spark):
    df = spark.createDataFrame([("d", "Hello, World! The END.\nÆ (so).  ")], "doc_id string, t string")
    got = [r.window_text for r in chunks.windows(df, F.col("t"), 3, 1).orderBy("win").collect()]
    assert got == ["Hello, World! The", "The END.\nÆ (", "Æ (so)."]
    assert "".join(df.select(X.pieces(F.col("t")).alias("p")).first().p) == "Hello, World! The END.\nÆ (so).  "
    by = X.pieces_of(Letters())
    small = spark.createDataFrame([("d", "ab, cd")], "doc_id string, t string")
    assert [r.window_text for r in chunks.windows(small, F.col("t"), 3, 1, by).orderBy("win").collect()] == ["ab,", ", cd"]
    assert small.select(X.token_count(F.col("t"), by).alias("n")).first().n == 5


def test_analyzer(spark):
    df = spark.createDataFrame([("The mice ran and Ran",)], "t string")
    words = X.analyzer(stop=("the", "and"), lemmas={"mice": "mouse"})
    assert df.select(words(F.col("t")).alias("w")).first().w == ["mouse", "ran", "ran"]


def test_queries_without_hits(spark):
    c = spark.createDataFrame([("d_0", "alpha beta"), ("d_1", "gamma")], "chunk_id string, chunk string")
    q = spark.createDataFrame([("q0", "alpha", "d_0"), ("q1", "nothing here", "d_1"), ("q2", "", "d_1")], "query_id string, query string, gt_chunk_id string")
    run = retrieval.bm25_top(q, c)
    at = {r.k: r for r in metrics.mean_at(run, q.select("query_id", F.col("gt_chunk_id").alias("chunk_id"))).collect()}
    assert at[1].recall == at[1].mrr == round(1 / 3, 5) and at[5].precision == round(1 / 15, 5)
    rows = {r.query_id: r for r in metrics.result_rows(q, run, c).collect()}
    assert rows["q1"].pred_chunks == [] and rows["q1"].gt_chunk_rank is None and rows["q1"].gt_chunk_text == "gamma"
    assert [p.pred_chunk_id for p in rows["q0"].pred_chunks] == ["d_0"] and rows["q0"].gt_chunk_rank == 1


def shuffled(node) -> list[int]:
    """Rows that each exchange of an executed plan wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(node.plan())
    own = [node.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
    return own + [n for i in range(node.children().size()) for n in shuffled(node.children().apply(i))]


def test_result_rows_shuffle_few_texts(spark):
    c = spark.range(3000).select(F.concat(F.lit("d_"), F.col("id")).alias("chunk_id"), F.concat(F.lit("text "), F.col("id")).alias("chunk"))
    q = spark.createDataFrame([("q0", "one", "d_7"), ("q1", "two", "d_9999")], "query_id string, query string, gt_chunk_id string")
    run = spark.createDataFrame([("q0", "d_2999", 2.0, 1), ("q0", "d_7", 1.0, 2), ("q1", "d_12", 1.0, 1)], "query_id string, chunk_id string, score double, rank int")
    with_rows, least = metrics.result_rows(q, run, c), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to send
    try:
        rows = {r.query_id: r for r in with_rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert [p.pred_chunk_text for p in rows["q0"].pred_chunks] == ["text 2999", "text 7"] and rows["q0"].gt_chunk_text == "text 7"
    assert [p.pred_chunk_text for p in rows["q1"].pred_chunks] == ["text 12"] and rows["q1"].gt_chunk_text == ""
    written = shuffled(with_rows._jdf.queryExecution().executedPlan())
    assert written and max(written) < 100


def test_bm25_in_blocks_and_over_postings(spark, monkeypatch):
    words = ["a", "b", "c", "dd", "e e", "b a"]
    c = spark.createDataFrame([(f"d_{i}", " ".join(words[(i * j + j) % 6] for j in range(1, 2 + i % 5))) for i in range(40)], "chunk_id string, chunk string")
    q = spark.createDataFrame([(i, w) for i, w in enumerate(["a a b", "dd", "zz", "c e a"])], "query_id long, query string")
    one = retrieval.ranked(retrieval.bm25(q, retrieval.postings(c)), 7)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 5)) for r in df.collect())
    assert key(retrieval.bm25_top(q, c, 7)) == key(one)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 120)
    assert key(retrieval.bm25_top(q, c, 7)) == key(one)


@pytest.fixture()
def lines(spark):
    """Chunks of words of which few are common, many of them equal, in an order that a seed makes; queries are some of them."""
    r = random.Random(3)
    texts = [" ".join(f"w{int(r.paretovariate(0.4)) % 300}" for _ in range(r.randint(0, 12))) for _ in range(500)]
    rows = [(f"c{i}", r.choice(texts)) for i in range(2000)] + [("null", None)]
    q = [(f"q{i}", rows[i * 37][1], rows[i * 37][0]) for i in range(50)]
    return spark.createDataFrame(q, "query_id string, query string, gt_chunk_id string"), spark.createDataFrame(rows, "chunk_id string, chunk string").repartition(3)


def key(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 100])
def test_bounded_search_against_all_pairs(lines, monkeypatch, k):
    q, c = lines
    want = key(retrieval.ranked(retrieval.bm25(q, retrieval.postings(c)), k))
    share = lambda df, name: df.select(df.columns[0], F.explode(X.tokens(F.col(name))).alias("t")).groupBy(df.columns[0], "t").agg(F.count("*").alias("n")).join(df.select(df.columns[0], F.size(X.tokens(F.col(name))).alias("dl")), df.columns[0]).groupBy(df.columns[0]).agg(F.map_from_entries(F.collect_list(F.struct("t", F.col("n") / F.col("dl")))).alias("weights"))
    products_of = retrieval.sparse_run(share(q, "query"), share(c, "chunk").withColumnRenamed("chunk_id", "item_id"))
    want_share = key(retrieval.ranked(products_of, k, item="item_id").select("query_id", "item_id", "score", "rank"))
    for few, rows in ((50_000, 1 << 16), (0, 1 << 16), (0, 64)):
        monkeypatch.setattr(retrieval, "FEW", few)
        monkeypatch.setattr(products, "ROWS", rows)
        assert key(retrieval.bm25_top(q, c, k)) == want
        assert key(retrieval.share_top(q, c, k)) == want_share


def test_search_down_to_targets(lines, monkeypatch):
    q, c = lines
    targets = q.select("query_id", F.col("gt_chunk_id").alias("chunk_id")).unionByName(q.limit(9).select("query_id", F.lit("c5").alias("chunk_id")))
    full = {(a, b): (score, rank) for a, b, score, rank in key(retrieval.bm25_top(q, c, 30))}
    asked = {(r.query_id, r.chunk_id) for r in targets.collect()}
    for few in (50_000, 0):
        monkeypatch.setattr(retrieval, "FEW", few)
        for top in (0, 10):
            got = {(a, b): (score, rank) for a, b, score, rank in key(retrieval.bm25_top(q, c, 30, targets=targets, top=top))}
            assert got.items() <= full.items()
            last = {a: max([top, *(full[a, b][1] for x, b in asked if x == a and (a, b) in full)]) for a, _ in asked}
            assert {x for x, (_, rank) in full.items() if rank <= last[x[0]]} <= set(got)


def test_tasks_give_few_rows():
    """Of a block only what may be among the k best is given: with a bound, and of many equal rows."""
    words = pa.array([[f"w{i % 97}", "all"] for i in range(20_000)])
    ids = pa.array([f"c{i}" for i in range(20_000)])
    wanted = products.Wanted(pa.array(["q"]), np.array([0, 2]), pa.array(["all", "w5"]), np.ones(2))
    batches = [pa.RecordBatch.from_arrays([ids, words], ["item", "t"])]
    weigh = lambda tf, term, length: np.where(term == 0, 0.5, 3.0)
    for least, stepped in ((None, False), (np.array([3.4]), False), (np.array([3.4]), True)):
        got = [r for b in products.best(iter(batches), wanted, 10, weigh, least, stepped) for r in b.to_pylist()]
        assert {r["item_id"] for r in got} >= set(sorted(f"c{i}" for i in range(5, 20_000, 97))[:10]) and all(r["score"] == 3.5 for r in got)
        assert len(got) <= 10 * (1 + 2 * stepped + (4 if stepped else 1)) and len(got) < 100


def test_hash_embedding_finds_places_once(spark):
    texts = ["a b a", "", "Été x1 " * 40]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(retrieval.hash_embedding(F.col("t")).alias("v"))
    assert [list(r.v) for r in df.collect()] == retrieval.HashEncoder().encode(texts).tolist()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and "md5" not in plan[plan.index("size(filter(") :]


def test_ids_that_repeat(spark):
    rows = [("d_0", "old", 0, ["d_1"], []), ("d_1", "first", 1, [], []), ("d_1", "last", 2, [], [])]
    g = spark.createDataFrame(rows, "chunk_id string, chunk string, chunk_idx int, explicit_context_chunks array<string>, implicit_context_chunks array<string>")
    assert context.explicit_context(g).first().context_chunks == "last (chunk_id: d_1)"


def test_verdicts_and_cost(spark):
    class Maybe:
        def complete(self, prompt, cache_id):
            return json.dumps({"criterion_1": "Yes", "answer_to_query": "x", "verdict": "Maybe" if cache_id == "d_0" else "No"}), 0.25

    q = spark.createDataFrame([("d_0", "q", "c", "", "", None), ("d_1", "q", "c", "", "", None)], "chunk_id string, query string, chunk string, context_chunks string, impl_context_chunks string, utilized_context_chunk_ids array<string>")
    spent = Observation("spent")
    got = {r.chunk_id: r.passes_assurance for r in generation.assure(q, Maybe(), "r10", spent=spent).collect()}
    assert got["d_1"] == "No" and got["d_0"].startswith(PARSING_FAILURE) and "Maybe" in got["d_0"]
    assert spent.get == {"cost": 0.5, "calls": 2}


def test_chat_over_http(monkeypatch):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["Authorization"]))
            body = json.dumps({"choices": [{"message": {"content": "hi" if len(seen) == 1 else ""}}], "usage": {"cost": 0.5}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setitem(generation.SERVICES, "openrouter", (f"http://127.0.0.1:{server.server_port}/v1", "SOME_KEY"))
    chat = generation.Chat("openrouter", "m")
    with pytest.raises(ValueError):
        chat.complete("p", "id")
    monkeypatch.setenv("SOME_KEY", "k")
    assert chat.complete("p", "id") == ("hi", 0.5)
    assert seen[0][0] == "/v1/chat/completions" and seen[0][1]["messages"] == [{"role": "user", "content": "p"}] and seen[0][2] == "Bearer k"
    with pytest.raises(ValueError):
        chat.complete("p", "id")
    server.shutdown()


def test_timings(spark):
    assert set(metrics.timed({"a": lambda: spark.range(3)})) == {"a"}


def test_windows_need_a_smaller_overlap():
    with pytest.raises(ValueError):
        chunks.check_windows(4, 4)


def test_window_aggregation(spark):
    rows = [("a", 0, " a\n\n"), ("a", 1, CONTEXT_FAILURE), ("a", 2, "b\n\n"), ("b", 0, CONTEXT_FAILURE), ("b", 1, "")]
    df = spark.createDataFrame(rows, "chunk_id string, win int, response string")
    assert {r.chunk_id: r.context for r in chunks.aggregate_windows(df).collect()} == {"a": "a\n\nb\n\n", "b": CONTEXT_FAILURE}
    assert {r.context for r in chunks.aggregate_windows(df, "any").collect()} == {CONTEXT_FAILURE}


def test_metrics(spark):
    run = spark.createDataFrame([("q0", "c1", 0.9), ("q0", "c2", 0.8), ("q0", "c3", 0.7), ("q1", "c2", 0.9), ("q1", "c3", 0.5), ("q1", "c1", 0.1)], "query_id string, chunk_id string, score double")
    qrels = spark.createDataFrame([("q0", "c2"), ("q1", "c1"), ("q1", "c2")], "query_id string, chunk_id string")
    got = {r.k: r for r in metrics.mean_at(retrieval.ranked(run), qrels).collect()}
    assert (got[1].recall, got[1].precision, got[1].mrr, got[5].mrr, got[5].recall, got[5].precision) == (0.25, 0.5, 0.5, 0.75, 1.0, 0.3)
    assert got[5].map == 0.66667
    assert all(got[a].recall <= got[b].recall for a, b in zip((1, 5, 10, 50), (5, 10, 50, 100)))
    metrics.check_labels(qrels, qrels)
    with pytest.raises(ValueError):
        metrics.check_labels(qrels, run.filter("chunk_id = 'c3'"))


def test_rank_filter(spark):
    ranks = [(3, None), (None, 10), (11, 40), (None, None), (2, 2)]
    q = spark.createDataFrame([(f"q{i}", f"c{i}") for i in range(5)], "query string, chunk_id string")
    results = [spark.createDataFrame([(f"q{i}", f"c{i}", r[side], 1) for i, r in enumerate(ranks)] + [(f"q{i}", f"c{i}", 1, 0) for i in range(5)], "query string, gt_chunk_id string, gt_chunk_rank int, seq int") for side in (0, 1)]
    out = {r["query"]: r.outcome for r in funnel.verdicts(funnel.with_ranks(q, *results)).collect()}
    assert out == {"q0": "dropped_dense", "q1": "dropped_sparse", "q2": "kept", "q3": "kept", "q4": "dropped_dense"}
    assert {r["query"] for r in funnel.rank_filter(q, *results).collect()} == {"q2", "q3"}
    with pytest.raises(ValueError):
        funnel.only_ids(q, spark.createDataFrame([("c0",), ("gone",)], "chunk_id string"))


def test_list_items(spark):
    bad = ["Art. 5. 1) - x", "Art. 5 - x", "- x", "ż)- x", "tekst - x", "lista:"]
    good = ["Art. 5. tekst", "dwa słowa - x", None]
    df = spark.createDataFrame([(x,) for x in bad + good], "chunk string")
    assert {r.chunk for r in funnel.drop_items(df).collect()} == set(good)
    assert funnel.drop_items(df, enabled=False).count() == 9


def test_context_before_target(spark):
    rows = [(5, [2, 9]), (5, []), (None, [7, None]), (None, [None]), (5, [1, 2])]
    got = analysis.context_before_target(spark.createDataFrame(rows, "target_rank int, context_ranks array<int>")).collect()
    assert [(r.acpt, r.allcpt) for r in got] == [(True, False), (False, False), (True, False), (False, False), (True, True)]


def test_token_distance(spark):
    rows = [(0, 10), (1, 20), (2, 30)]
    c = spark.createDataFrame([("d", f"d_{i}", i, " ".join(["x"] * n)) for i, n in rows], "doc_id string, chunk_id string, chunk_idx int, chunk string")
    q = spark.createDataFrame([("a", "d_2", ["d_0"]), ("b", "d_0", ["d_2"]), ("c", "d_1", ["d_1"]), ("e", "d_1", [])], "query_id string, chunk_id string, used array<string>")
    got = {r.query_id: (r.token_distance, r.chunk_distance) for r in analysis.distances(q, analysis.cumulative_tokens(c)).collect()}
    assert got == {"a": (60, 2), "b": (60, 2), "c": (20, 0), "e": (0, None)}


def test_power_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (63, 64, 127, 128, 262144, 262145)], "v long")
    got = {r.lo: (r.hi, r.n, r.pct) for r in analysis.power_histogram(df, F.col("v")).collect()}
    assert got == {64: (128, 2, 50.0), 128: (256, 1, 25.0), 131072: (262144, 1, 25.0)}


def test_render_keeps_braces_of_data(spark):
    df = spark.createDataFrame([("{{b}} {{a}}", None)], "a string, b string")
    assert df.select(X.render("<{{a}}|{{ b }}|{{c}}>", {"a": F.col("a"), "b": F.col("b")}).alias("x")).first().x == "<{{b}} {{a}}||>"


PAGE = """<html><body><h1> The <i>law</i></h1><div><section><h3>Part A</h3><p>skip<section><h3>1.</h3>
<div><p data-template="xText">first  text<br>goes on</div></section></section><div><p data-template="xText">no heading</div>
<script>"</p><p data-template='xText'>"</script></body></html>"""


def test_html_chunks(spark):
    got = html.page_chunks(PAGE)
    assert got[0] == "Thelaw" and got[-1] == "no heading" and len(got) == 3
    assert got[1].endswith("first textgoes on") and got[1].startswith("Part A 1.") or got[1].startswith("1.")
    assert html.page_chunks("<p data-template=xText>a") == ["a"]
    df = spark.createDataFrame([("p", "<h1>T</h1><article><p>one<p>two</article>"), ("q", None)], "stem string, html string")
    rows = html.html_chunks(df, selector="article p").collect()
    assert [tuple(r) for r in rows] == [("p_0", "T"), ("p_1", "one"), ("p_2", "two")]


def test_raw_heading(spark):
    pages = ["<h1 id=a> A &amp; b&amp </h1><h1>B</h1>", "<h1>say &quot;x\n<i>y</i></h1>", "<h1>open", "<h2>none</h2>", None]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(html.raw_heading(F.col("html"))).collect()] == ["A & b&amp", "say &quot;x\n<i>y</i>", "", None, None]


def test_heading_query_against_sql(spark, tmp_path):
    rows = [(1, "<h1>a&&amp</h1>"), (2, "<h1>x &lt; <b>y</b></h1>"), (3, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["k1a_h1"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(duck.sql(entry.oracle_sql()["k1a_h1"]).fetchall()) == [("1_0", "a&&amp"), ("2_0", "x &lt; <b>y</b>")]


def test_totals_without_words(spark):
    rows = [("a", ""), ("b", " \n"), ("c", "one two-three"), *[("d", "x " * 639 + "x-y")]]
    got = {r.doc_id: tuple(r)[1:] for r in analysis.doc_totals(spark.createDataFrame(rows, "doc_id string, chunk string")).collect()}
    assert got["a"][:3] == got["b"][:3] == (1, 0, 0) and math.isnan(got["a"][3]) and math.isnan(got["b"][3])
    assert got["c"] == (1, 2, 3, 1.5) and got["d"] == (1, 640, 641, 1.001562)


def test_heading_escalation():
    page = "<body><h3>Chapter</h3><div><div><h3>1.</h3><div><p data-template=xText>text</p></div></div></div></body>"
    assert html.page_chunks(page) == ["Chapter 1. text"]
    assert html.page_chunks(page.replace("1.", "2.")) == ["2. text"]


class Failing:
    def __init__(self, *messages):
        self.messages, self.calls = list(messages), 0

    def complete(self, prompt, cache_id):
        self.calls += 1
        if self.messages:
            raise RuntimeError(self.messages.pop(0))
        return "fine", 0.5


@pytest.mark.parametrize(
    "policy, messages, answer, calls",
    [
        (generation.CONTEXTUALISE, ["oops", "oops"], "fine", 3), (generation.CONTEXTUALISE, ["oops"] * 3, CONTEXT_FAILURE, 3), (generation.CONTEXTUALISE, ["error 403"], CONTEXT_FAILURE, 1),
        (generation.CONTEXTUALISE, ["maximum context exceeded"], CONTEXT_TOO_LONG, 1), (generation.GENERATE, ["rate limit"], "fine", 2), (generation.GENERATE, ["empty content"], QUERY_FAILURE, 1),
    ],
)
def test_policies(policy, messages, answer, calls):
    provider, waits = Failing(*messages), []
    patient = generation.Policy(**{**policy.__dict__, "sleep": waits.append})
    assert patient.call(provider, "p", "c")[0] == answer and provider.calls == calls
    assert waits == [1.0, 2.0][: len(waits)]


def test_preflight():
    generation.preflight(generation.Echo())
    with pytest.raises(RuntimeError):
        generation.preflight(Failing("no"))
    with pytest.raises(ValueError):
        generation.Chat("nobody", "m")


def test_answer_schemas():
    assert [query_answer(x)[0] for x in ("query_prompt_r8", "query_generation_prompt_r4norerun", "query_generation_prompt_r9")] == ["r8", "r4", "r9"]
    assert [verdict_answer(x)[0] for x in ("assurance_prompt_r45", "assurance_prompt_r8", "assurance_prompt_r10")] == ["r4", "r9", "r10"]
    assert verdict_answer("r10")[1].count("criterion_") == 4
    for bad in ("query_prompt", "query_prompt_r6"):
        with pytest.raises(ValueError):
            query_answer(bad)
    with pytest.raises(ValueError):
        verdict_answer("assurance_prompt_r7")


class Fixed:
    def __init__(self, said):
        self.said = said

    def complete(self, prompt, cache_id):
        return self.said, 0.0


def test_generate_and_assure(graph):
    good = generation.generate(graph, generation.Echo("query"), "r8").collect()
    assert len(good) == 1 and good[0].target_context_chunk_id == "d_2" and good[0].utilized_context_chunk_ids is None
    raw = generation.generate(graph, Fixed("no json"), "r9")
    r = raw.first()
    assert (r["query"], r.utilized_context_chunk_ids, r.target_context_chunk_id) == ("no json", [], PARSING_FAILURE)
    a = generation.assure(raw, Fixed("no json"), "r10").first()
    assert a.passes_assurance == PARSING_FAILURE + "no json" and a.criterion_1 is None
    ok = generation.assure(raw, generation.Echo("verdict"), "r10").first()
    assert ok.passes_assurance in ("Yes", "No") and ok.criterion_4 == "Yes"
    done = graph.filter("chunk_id = 'd_2'")
    assert generation.generate(graph, generation.Echo("query"), "r8", done=done).count() == 0
    assert generation.generate(graph, generation.Echo("query"), "r8", done=done, update=True).count() == 1


def test_contextualise(graph):
    df = graph.withColumn("doc_id", F.lit("d"))
    got = {r.chunk_id: r.chunk for r in generation.contextualise(df, generation.Echo()).collect()}
    assert len(got) == 5 and all(v.startswith("d: ") and v.endswith(f"\n\n T{k[-1]}") for k, v in got.items())
    assert generation.contextualise(df, generation.Echo(), done=df.limit(2)).count() == 3
    assert {r.chunk for r in generation.contextualise(df.limit(1), Fixed(CONTEXT_FAILURE)).collect()} == {CONTEXT_FAILURE + " T0"}
    for how in ("append", "consolidate"):
        out = generation.waterfall(df, generation.Echo(), window=3, overlap=1, aggregation=how).collect()
        assert len(out) == 5 and all("\n\n" in r.chunk for r in out)


def test_dense_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "item_id long, vector array<float>")
    q = df.filter("item_id < 9").withColumnRenamed("item_id", "query_id")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(retrieval.dense_top(q, df, 4)) == key(retrieval.dense_top(q, df, 4, most_queries=3))
    assert retrieval.dense_top(q.limit(0), df, 4).count() == 0


def test_zero_padding(spark):
    c = spark.createDataFrame([(f"d_{i}", "alpha beta" if i == 3 else "gamma") for i in range(6)], "chunk_id string, chunk string")
    q = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    assert retrieval.bm25_top(q, c).count() == 1
    got = retrieval.bm25_top(q, c, 4, pad_zero=True).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["d_3", "d_0", "d_1", "d_2"]


def test_presence(spark):
    q, a, b = (spark.createDataFrame([(x, f"c{x}", 1) for x in s], "query string, chunk_id string, gt_chunk_rank int") for s in ("abc", "ab", "ac"))
    assert {r["query"] for r in reports.presence(q, a, b).filter("common").collect()} == {"a"}
    with pytest.raises(ValueError):
        reports.compared(q, a, b)
    out = io.StringIO()
    assert reports.comparison(reports.compared(q, a, b, ignore_mismatch=True), out) == 1 and "green" in out.getvalue()


def test_reports(spark):
    out = io.StringIO()
    df = spark.createDataFrame([("c2", "<b>"), ("c1", "x")], "chunk_id string, chunk string")
    assert reports.records(df, out) == 2 and "&lt;b&gt;" in out.getvalue() and out.getvalue().index("c1") < out.getvalue().index("c2")


class Slow:
    def complete(self, prompt, cache_id):
        time.sleep(0.1)
        return prompt, 0.0


def test_calls_run_at_once(spark):
    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(60)], "cache_id string, prompt string").coalesce(1)
    generation.call(df.limit(1), Slow(), generation.GENERATE).collect()
    began = time.monotonic()
    assert {r.response for r in generation.call(df, Slow(), generation.GENERATE, concurrency=30).collect()} == {f"p{i}" for i in range(60)}
    assert time.monotonic() - began < 5


def test_flat_rows_nest_and_come_back(spark):
    c = spark.createDataFrame([("d", "d_1", "b", 1), ("d", "d_0", "a", 0), ("e", "e_0", "c", 0)], "doc_id string, chunk_id string, chunk string, chunk_idx int")
    flat = chunks.unnest(chunks.nest(c))
    assert sorted((r.doc_id, r.pos, r.chunk_id, r.chunk) for r in flat.collect()) == [("d", 0, "d_0", "a"), ("d", 1, "d_1", "b"), ("e", 0, "e_0", "c")]
