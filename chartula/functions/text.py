"""Text as columns: Unicode-aware white space, words, tokens, identifiers and templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]
TOKEN = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_white(c: Column) -> Column:
    """Runs of Unicode white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("long")


def tokens(c: Column) -> Column:
    """The default analyzer: lower-case runs of letters and digits, in order, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def token_count(c: Column, analyzer: Analyzer = tokens) -> Column:
    return F.size(analyzer(c)).cast("long")


def analyzer(stop: Sequence[str] = (), lemmas: dict[str, str] | None = None, base: Analyzer = tokens) -> Analyzer:
    """base, then words replaced by their lemma where the table has one, then stop words left out."""
    table = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair]) if lemmas else None

    def run(c: Column) -> Column:
        words = base(c)
        if table is not None:
            words = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
        return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words

    return run


def pieces(c: Column) -> Column:
    """The text cut before each default token, so that its pieces joined give the text again; none without a token."""
    cut = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0))
    head = F.regexp_extract(c, r"\A[^\p{L}\p{N}]+", 0)
    return F.transform(cut, lambda x, i: F.when(i == 0, F.concat(head, x)).otherwise(x))


class Tokenizer(Protocol):
    """Where a text's tokens lie: (start, end) of each, in characters and in order. It must pickle."""

    def offsets(self, text: str) -> list[tuple[int, int]]: ...


def pieces_of(tokenizer: Tokenizer) -> Analyzer:
    """pieces() by another tokenizer, in Arrow batches; as an analyzer, the size of its result is the number of tokens."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def cut(text):
            starts = [s for s, _ in tokenizer.offsets(text)] if text else []
            return [text[a:b] for a, b in zip([0, *starts[1:]], [*starts[1:], len(text)])] if starts else []

        return texts.map(cut)

    return run


def doc_id(chunk_id: Column) -> Column:
    """What stands before the first underscore."""
    return F.split(chunk_id, "_")[0]


def internal_id(chunk_id: Column) -> Column:
    """What stands after it, with hyphens for the other underscores."""
    parts = F.split(chunk_id, "_")
    return F.concat_ws("-", F.slice(parts, F.lit(2), F.size(parts)))


def chunk_idx(chunk_id: Column) -> Column:
    """The last part of the id as a number, null where it is none."""
    return F.element_at(F.split(chunk_id, "_"), -1).try_cast("int")


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with {{name}} places, built by concatenation, so braces in the data stay as they are. Names without a
    value, and null values, render empty."""
    parts = []
    for k, piece in enumerate(re.split(r"\{\{\s*(\w+)\s*\}\}", template)):
        if k % 2 == 0:
            parts += [F.lit(piece)] if piece else []
        elif piece in values:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def joined_in_order(pairs: Column, separator: str) -> Column:
    """array<struct<order…, text>> sorted by its fields, its texts joined."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["text"]), separator)
