"""Model stages: prompts as columns, calls in Arrow batches with a thread pool, retries by policy, answers parsed by schema."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CONSOLIDATION_FAILURE, CONTEXT_FAILURE, CONTEXT_TOO_LONG, PARSING_FAILURE, QUERY_FAILURE, VERDICTS, query_answer, verdict_answer
from . import chunks as C
from . import context as G

#: Addresses of services that speak the chat protocol, and the variables that hold their keys.
SERVICES = {
    "openrouter": ("https://openrouter.ai/api/v1", "OPENROUTER_API_KEY"),
    "together": ("https://api.together.xyz/v1", "TOGETHER_API_KEY"),
    "vllm": ("http://localhost:8000/v1", None),
}


class Provider(Protocol):
    """Answers a prompt; cache_id names the shared prefix of prompts. Returns the text and its cost."""

    def complete(self, prompt: str, cache_id: str) -> tuple[str, float]: ...


@dataclass(frozen=True)
class Echo:
    """The offline provider: a deterministic answer made of the prompt's size and first words."""

    kind: str = "text"

    def complete(self, prompt: str, cache_id: str) -> tuple[str, float]:
        words = prompt.split()
        said = f"{cache_id}: {len(words)} words"
        if self.kind == "query":
            said = json.dumps({"query": f"what of {words[-1] if words else ''}", "target_context_chunk_id": cache_id, "utilized_context_chunk_ids": [cache_id]})
        elif self.kind == "verdict":
            said = json.dumps({f"criterion_{i}": "Yes" for i in range(1, 6)} | {"answer_to_query": said, "verdict": "Yes" if len(words) % 2 else "No"})
        return said, 1e-6 * len(words)


@dataclass(frozen=True)
class Chat:
    """A chat service over HTTP; the key is read on the executor."""

    service: str
    model: str
    timeout: int = 1800

    def __post_init__(self):
        if self.service not in SERVICES:
            raise ValueError(f"unknown provider {self.service!r}")

    def complete(self, prompt: str, cache_id: str) -> tuple[str, float]:
        from urllib.request import Request, urlopen

        url, variable = SERVICES[self.service]
        key = os.environ.get(variable, "") if variable else ""
        if variable and not key:
            raise ValueError(f"{variable} is not set")
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "user": cache_id}
        with urlopen(Request(f"{url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}), timeout=self.timeout) as r:
            answer = json.load(r)
        if not (text := answer["choices"][0]["message"]["content"]):
            raise ValueError("empty content")
        return text, float((answer.get("usage") or {}).get("cost") or 0)


@dataclass(frozen=True)
class Policy:
    """How calls are tried again and what stands for a failure."""

    sentinel: str
    attempts: int = 3
    wait: float = 1.0
    retryable: tuple[str, ...] = ()  # of messages in lower case; none: all
    fatal: tuple[str, ...] = ()
    too_long: tuple[str, ...] = ()
    too_long_sentinel: str = ""
    sleep: Callable[[float], None] = field(default=time.sleep)

    def call(self, provider: Provider, prompt: str, cache_id: str) -> tuple[str, float]:
        for attempt in range(self.attempts):
            try:
                return provider.complete(prompt, cache_id)
            except Exception as e:
                said = f"{type(e).__name__}: {e}".lower()
                if isinstance(e, TimeoutError) and not self.retryable:
                    break
                if any(x in said for x in self.too_long):
                    return self.too_long_sentinel, 0.0
                if any(x in said for x in self.fatal) or self.retryable and not any(x in said for x in self.retryable):
                    break
                if attempt + 1 < self.attempts:
                    self.sleep(self.wait * 2**attempt)
        return self.sentinel, 0.0


#: Status codes and words by which failures are told apart.
CONTEXTUALISE = Policy(CONTEXT_FAILURE, fatal=("400", "401", "402", "403", "404", "not set"), too_long=("context length", "maximum context", "context_length"), too_long_sentinel=CONTEXT_TOO_LONG)
GENERATE = Policy(QUERY_FAILURE, retryable=("rate limit", "429", "timeout", "timed out", "connection", "temporarily", "502", "503", "504"))
CONSOLIDATE = Policy(CONSOLIDATION_FAILURE)


def preflight(provider: Provider) -> None:
    """One call before a long run; raises RuntimeError with the reason if it fails."""
    try:
        provider.complete("Reply with OK.", "preflight")
    except Exception as e:
        raise RuntimeError(f"the provider does not answer: {e}") from e


def call(df: DataFrame, provider: Provider, policy: Policy, concurrency: int = 16, spent: Observation | None = None) -> DataFrame:
    """df (prompt, cache_id, …) with response and cost for prompt. ``concurrency`` calls run at once in each task.

    spent gets the sum of costs and the number of calls (cost, calls) once an action has run the whole plan.
    """
    keep = [c for c in df.columns if c != "prompt"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", response string, cost double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                got = list(pool.map(lambda p, c: policy.call(provider, p, c), pdf["prompt"], pdf["cache_id"]))
                yield pdf[keep].assign(response=[g[0] for g in got], cost=[g[1] for g in got])

    said = df.mapInPandas(run, schema)
    return said.observe(spent, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("*").alias("calls")) if spent is not None else said


SITUATE = "<document>\n{{document}}\n</document>\n\nThe following is one passage of it.\n<chunk>\n{{chunk}}\n</chunk>\n\nSay in one or two sentences where the passage stands in the document and what it is about. Answer with these sentences only."


def situate(document: Column, chunk: Column) -> Column:
    """The prompt that asks for a chunk's place in its document."""
    return X.render(SITUATE, {"document": document, "chunk": chunk})


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def consolidation(texts: Column) -> Column:
    return F.concat(F.lit("These descriptions of one passage come from several parts of a long document:\n"), numbered(texts), F.lit("\n\nMerge them into one description of one or two sentences. Answer with these sentences only."))


def _together(chunks: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(doc_id, document, rows): each document once, with its chunks (chunk_idx, chunk_id, chunk, todo) in order. Chunks are
    shuffled once, by document; prompts are built after that, in the tasks that send them."""
    rows = chunks.select("doc_id", "chunk_id", "chunk_idx", "chunk", F.lit(True).alias("todo"))
    if done is not None:
        rows = rows.drop("todo").join(done.select("chunk_id", F.lit(False).alias("todo")).distinct(), "chunk_id", "left").fillna(True, ["todo"])
    nested = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_id", "chunk", "todo"))).alias("rows"))
    return nested.select("doc_id", F.array_join(F.transform("rows", lambda r: r["chunk"]), "\n").alias("document"), "rows")


def contextualise(chunks: DataFrame, provider: Provider, done: DataFrame | None = None, policy: Policy = CONTEXTUALISE, spent: Observation | None = None) -> DataFrame:
    """(chunk_id, chunk): each chunk with a description of its place in the whole document before it."""
    rows = _together(chunks, done).select("doc_id", "document", F.explode("rows").alias("r")).filter("r.todo")
    asked = rows.select("r.chunk_id", "r.chunk", F.col("doc_id").alias("cache_id"), situate(F.col("document"), F.col("r.chunk")).alias("prompt"))
    said = call(asked, provider, policy, spent=spent)
    failed = F.col("response").startswith(CONTEXT_FAILURE[:-1])
    context = F.when(failed, F.col("response")).otherwise(F.concat(X.strip(F.col("response")), F.lit("\n\n")))
    return C.prepend_context(said.withColumn("context", context)).select("chunk_id", "chunk")


def waterfall(chunks: DataFrame, provider: Provider, window: int = 32_000, overlap: int = 8_000, aggregation: str = "append", mode: str = "all", policy: Policy = CONTEXTUALISE, pieces: X.Analyzer = X.pieces, spent: Observation | None = None) -> DataFrame:
    """The same by overlapping token windows of the document, whose descriptions are appended or consolidated.

    spent observes the calls about windows.
    """
    C.check_windows(window, overlap)
    if aggregation not in ("append", "consolidate"):
        raise ValueError(f"unknown aggregation {aggregation!r}")
    docs = _together(chunks)
    more = F.size(pieces(F.col("document"))) > window  # a document that fits is its own window, as it stands
    wins = C.windows(docs, F.col("document"), window, overlap, pieces)
    wins = wins.withColumn("window_text", F.when(more, F.col("window_text")).otherwise(F.col("document")))
    asked = wins.select("doc_id", "win", "window_text", F.explode("rows").alias("r")).select(
        "r.chunk_id", "win", F.concat_ws("_w", "doc_id", "win").alias("cache_id"), situate(F.col("window_text"), F.col("r.chunk")).alias("prompt")
    )
    said = call(asked, provider, policy, spent=spent)
    if aggregation == "append":
        context = C.aggregate_windows(said, mode)
    else:
        ok = said.filter((F.col("response") != "") & ~F.col("response").startswith(CONTEXT_FAILURE[:-1]))
        lists = ok.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("win", "response"))).alias("r"))
        merged = call(lists.select("chunk_id", F.col("chunk_id").alias("cache_id"), consolidation(F.transform("r", lambda x: x["response"])).alias("prompt")), provider, CONSOLIDATE)
        fine = F.when(F.col("response") == CONSOLIDATION_FAILURE, F.col("response")).otherwise(F.concat(X.strip(F.col("response")), F.lit("\n\n")))
        context = chunks.select("chunk_id").join(merged.select("chunk_id", fine.alias("context")), "chunk_id", "left").fillna(CONTEXT_FAILURE, ["context"])
    return C.prepend_context(chunks.select("chunk_id", "chunk").join(context, "chunk_id")).select("chunk_id", "chunk")


def parsed(raw: Column, schema: str) -> Column:
    """The answer as a struct, null where it isn't JSON of an object."""
    both = F.from_json(raw, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(both["_corrupt_record"].isNull() & raw.isNotNull(), both)


#: Our own wording; the variables are those that a caller's templates may use too.
QUERY_TEMPLATE = "Passage:\n{{chunk}}\n\nPassages it refers to:\n{{context_chunks}}\n\nTheir neighbours:\n{{impl_context_chunks}}\n\nWrite a question that only the passage with its context answers. Answer in JSON."
ASSURANCE_TEMPLATE = "Question:\n{{query}}\n\nPassage:\n{{chunk}}\n\nContext:\n{{context_chunks}}\n{{impl_context_chunks}}\n\nContext ids: {{context_chunk_ids}}\n\nJudge each criterion, answer the question, and give a verdict of Yes or No. Answer in JSON."


def generate(chunks: DataFrame, provider: Provider, template_name: str, template: str = QUERY_TEMPLATE, done: DataFrame | None = None, update: bool = False, policy: Policy = GENERATE, spent: Observation | None = None) -> DataFrame:
    """Queries (chunk_id, query, chunk, context_chunks, impl_context_chunks, target_context_chunk_id, utilized_context_chunk_ids).

    The template's name selects the answer's schema. done: ids of a checkpoint, left out, or with update the only ones.
    An answer that isn't JSON is the query itself, with the parsing sentinel as target.
    """
    _, schema = query_answer(template_name)
    rows = G.assembled(chunks)
    if done is not None:
        rows = rows.join(done.select("chunk_id").distinct(), "chunk_id", "left_semi" if update else "left_anti")
    rows = rows.select("chunk_id", "chunk", F.col("context").alias("context_chunks"), F.col("target_context").alias("impl_context_chunks"))
    values = {c: F.col(c) for c in ("chunk", "context_chunks", "impl_context_chunks")}
    said = call(rows.withColumns({"cache_id": F.col("chunk_id"), "prompt": X.render(template, values)}), provider, policy, spent=spent)
    a = said.withColumn("a", parsed(F.col("response"), schema))
    has = lambda c, other: F.when(F.col("a").isNull(), other).otherwise(F.col(f"a.{c}")) if c in schema else other
    none, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    return a.select(
        "chunk_id", F.when(F.col("a").isNull(), F.col("response")).otherwise(F.col("a.query")).alias("query"), "chunk", "context_chunks", "impl_context_chunks",
        F.when(F.col("a").isNull(), F.lit(PARSING_FAILURE)).otherwise(has("target_context_chunk_id", text)).alias("target_context_chunk_id"),
        F.when(F.col("a").isNull(), F.array().cast("array<string>")).otherwise(has("utilized_context_chunk_ids", none)).alias("utilized_context_chunk_ids"),
    )


def assure(queries: DataFrame, provider: Provider, template_name: str, template: str = ASSURANCE_TEMPLATE, done: DataFrame | None = None, policy: Policy = GENERATE, spent: Observation | None = None) -> DataFrame:
    """(chunk_id, passes_assurance, criterion_1 …, answer_to_query); not JSON, or a verdict other than those of VERDICTS: the
    parsing sentinel and the raw answer."""
    _, schema = verdict_answer(template_name)
    rows = queries if done is None else queries.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")
    values = {c: F.col(c) for c in ("query", "chunk", "context_chunks", "impl_context_chunks")} | {"context_chunk_ids": F.array_join(F.coalesce("utilized_context_chunk_ids", F.array().cast("array<string>")), ", ")}
    said = call(rows.select("chunk_id", F.col("chunk_id").alias("cache_id"), X.render(template, values).alias("prompt")), provider, policy, spent=spent)
    a = said.withColumn("a", parsed(F.col("response"), schema))
    fields = [x.split()[0] for x in schema.split(", ") if not x.startswith("verdict")]
    verdict = F.when(~F.coalesce(F.col("a.verdict").isin(*VERDICTS), F.lit(False)), F.concat(F.lit(PARSING_FAILURE), "response")).otherwise(F.col("a.verdict"))
    return a.select("chunk_id", verdict.alias("passes_assurance"), *[F.col(f"a.{f}").alias(f) for f in fields])
