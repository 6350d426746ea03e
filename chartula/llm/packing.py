"""Best-fit packing: tokens of documents into sequences, with a bounded set of open bins in a bitset keyed by free space."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole

#: Tokens of a sequence, open bins, pieces that a task orders before it packs them, remembered chunks of text.
LENGTH, OPEN, BLOCK, REMEMBERED = 1024, 1 << 16, 1 << 16, 300_000
#: Characters of text that are encoded together.
TOGETHER = 1 << 20
END = 2
TWO_WHITE = re.compile(r"\s\s")
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Encoder:
    """Texts to little-endian unsigned 32-bit ids.

    Where no two white-space characters meet, no pre-token crosses a space, so a text is the sum of its chunks, each with
    the space before it. Chunks are remembered (at most REMEMBERED), and only new ones are encoded: by a rank encoder built
    from the same file if its merges are in the order of their ids (then both encode alike, and it is faster on short
    strings), else by the file's own tokenizer. Other texts go to that tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranks = self._rank_encoder(path)

    @staticmethod
    def _rank_encoder(path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        # Bytes have printable stand-ins in such files: the printable ones themselves, the others from U+0100 on in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", [])]
        ids = [model["vocab"].get(m, -1) for m in merges]
        usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and whole.get("normalizer") is None
        if not usual or ids != sorted(ids) or any(i < 256 for i in ids):
            return None
        special = {x["content"] for x in whole.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def _own(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _short(self, text: str) -> bytes:
        if self.ranks is None:
            return self._own([text])[0]
        ids = self.ranks.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if TWO_WHITE.search(text):
                out += self._own([text])
                continue
            known, (first, *rest) = self.known, text.split(" ")
            got = [*map(known.get, rest)]
            if None in got:
                if len(known) > REMEMBERED:
                    known.clear()
                for i, x in enumerate(got):
                    if x is None:
                        got[i] = known[rest[i]] = known.get(rest[i]) or self._short(" " + rest[i])
            out.append(self._short(first) + b"".join(got))
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a worker process, so tasks that follow each other there share what it remembers."""
    return Encoder(path)


class Bins:
    """Online best fit. Bit f of the bitset is set while a bin with f free places is open; the fullest closes first."""

    def __init__(self, first: int, length: int = LENGTH, most: int = OPEN):
        self.next, self.length, self.most = first, length, most
        self.bits, self.open, self.n = 0, defaultdict(list), 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        if size == self.length:
            self.next += 1
            return self.next - 1, 0
        if fits := self.bits >> size:
            free = size + (fits & -fits).bit_length() - 1
            bins = self.open[free]
            at = bins.pop()
            self.n -= 1
            if not bins:
                self.bits ^= 1 << free
        else:
            free, at = self.length, self.next
            self.next += 1
        if left := free - size:
            self.open[left].append(at)
            self.bits |= 1 << left
            self.n += 1
            if self.n > self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                bins = self.open[fullest]
                bins.pop(0)
                self.n -= 1
                if not bins:
                    self.bits ^= 1 << fullest
        return at, self.length - free


def groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a few rows at a time: TOGETHER characters, or one longer text."""
    ids, texts, held = [], [], 0
    for i in range(batch.num_rows):
        ids.append(batch.column(0)[i].as_py())
        texts.append(batch.column(1)[i].as_py())
        held += len(texts[-1])
        if held >= TOGETHER:
            yield ids, texts
            ids, texts, held = [], [], 0
    yield ids, texts


def cut(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than ``length`` where there are several."""
    start = 0
    while start < n:
        size = (n - start) % length or length
        yield start, size
        start += size


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, open_bins: int = OPEN) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences: SCHEMA.

    Each task packs what it reads: no shuffle, memory bounded by the open bins and a block of BLOCK short records, whose
    pieces are taken longest first. Sequence ids hold the task's number, so reruns of a task over the same rows agree and
    tasks never share a sequence; at most one block's last bins stay unfilled in a task. Null and empty texts are the end
    token alone; repeated rows and null ids are packed like any other; no rows give no rows. A text of any length is
    encoded at once and only cut afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, stop = encoder(tokenizer), Bins(TaskContext.get().partitionId() << 40, length, open_bins), np.asarray([end], "<u4").tobytes()
        rows: list[tuple] = []

        def placed() -> pa.RecordBatch:
            rows.sort(key=lambda r: -r[3])
            at = [bins.place(r[3]) for r in rows]
            columns = [*zip(*rows), *zip(*at)] if rows else [[] for _ in names]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for ids, texts in groups(batch):
                for doc, got in zip(ids, encode(texts)):
                    got += stop
                    for k, (start, size) in enumerate(cut(len(got) // 4, length)):
                        rows.append((doc, k, start, size, zlib.crc32(got[4 * start : 4 * (start + size)])))
            while len(rows) >= BLOCK:
                yield placed()
        yield placed()

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
