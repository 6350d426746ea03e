"""Declared schemas of the tables between stages, and the sentinels that failed model calls leave in them."""

from __future__ import annotations

from pyspark.sql import types as T

#: What a failed call leaves in place of its result.
QUERY_FAILURE = "<QUERY_GENERATION_FAILURE>"
PARSING_FAILURE = "<PARSING_FAILURE>"
CONTEXT_FAILURE = "<CONTEXTUALISATION_FAILURE>"
CONTEXT_TOO_LONG = "<CONTEXTUALISATION_FAILURE_CONTEXT_LENGTH>"
CONSOLIDATION_FAILURE = "<CONSOLIDATION_FAILURE>"


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


CHUNKS = "chunk_id string, chunk string, chunk_idx int, explicit_context_chunks array<string>, implicit_context_chunks array<string>"
AUGMENTED = "chunk_id string, chunk string"
QUERIES = "chunk_id string, query string, chunk string, context_chunks string, impl_context_chunks string, target_context_chunk_id string, utilized_context_chunk_ids array<string>"
ASSURANCE = "chunk_id string, passes_assurance string, criterion_1 string, criterion_2 string, criterion_3 string, criterion_4 string, criterion_5 string, criterion_6 string, answer_to_query string"
RESULTS = "query string, gt_chunk_text string, gt_chunk_id string, gt_chunk_rank int, pred_chunks array<struct<pred_chunk_text: string, pred_chunk_id: string, pred_chunk_score: double, rank: int>>"

#: The fields that a model's structured answer must hold, by revision of the prompt.
QUERY_ANSWERS = {"r4": "query string", "r8": "target_context_chunk_id string, query string", "r9": "utilized_context_chunk_ids array<string>, query string"}
VERDICTS = ("Yes", "No")
VERDICT_CRITERIA = {"r4": 4, "r8": 5, "r9": 5, "r10": 4}


def query_answer(template: str) -> tuple[str, str]:
    """(revision, schema) of a query template, by the first revision whose name occurs in it; else ValueError."""
    for revision, schema in QUERY_ANSWERS.items():
        if revision in template:
            return revision, schema
    raise ValueError(f"no answer schema for the query template {template!r}")


def verdict_answer(template: str) -> tuple[str, str]:
    """The same for a template of an assurance check; r8 answers like r9, and r45 counts as r4 since it holds its name."""
    for revision, n in VERDICT_CRITERIA.items():
        if revision in template:
            return ("r9" if revision == "r8" else revision), ", ".join([*(f"criterion_{i} string" for i in range(1, n + 1)), "answer_to_query string", "verdict string"])
    raise ValueError(f"no answer schema for the assurance template {template!r}")
