"""Suffix-array dedup: bytes covered by a string that starts in an earlier document, found in sharded suffix arrays.

A string of LENGTH bytes is dealt by its smallest hashed K-gram, which its own bytes decide, so equal strings meet wherever
they start. Neighbouring strings with one such gram form a piece. Three steps:

1. grams: pieces meet under their gram. Those of a gram that only one document has can't repeat. The others are sent for: to
   the shard of the first document that has the gram, or, where more than SHARED pieces have it, to one of the gram's own,
   or, beyond MANY pieces, string by string;
2. shards: pieces of one document that follow each other and go to one place travel as one span. A suffix array of a
   shard's spans, by induced sorting, brings equal strings together; runs of LENGTH common bytes, compared as bytes, name the
   strings that an earlier document has too;
3. documents: covered strings are cut out.

Hashes only group: a chance collision costs work, never a byte. Equal pieces of grams that have a shard of their own, from
one bucket of documents, are compared as bytes before they are sent, and one of them goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import NO_ID, ROWS, batch_of, by_bucket, home, with_texts
from .common import discard, documents, whole, written
from .induced import END, SEPARATOR, SHIFT, common, suffix_array

LENGTH, K = 50, 24
#: Bytes of text hashed together, strings in a piece, pieces under a gram beyond which it has its own shard, and beyond which its strings are dealt singly; bytes sorted at once, records dealt at once.
TOGETHER, LONGEST, SHARED, MANY, SORTED, DEALT = 1 << 21, 200, 256, 1 << 14, 1 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15

PIECE = np.dtype([("gram", "<u4"), ("doc", "<i8"), ("tag", "<u2"), ("start", "<u4"), ("size", "u1")])
#: Strings of a document that follow each other; of those sent for, their shard (-1: dealt singly), what they are sorted with there, and whether equal ones are merged first.
COVER = np.dtype([("doc", "<i8"), ("tag", "<u2"), ("start", "<u4"), ("size", "<u4")])
WANT = np.dtype([*COVER.descr, ("shard", "<i4"), ("key", "<u4"), ("hot", "u1")])
SENT = np.dtype([*COVER.descr, ("key", "<u4")])
COVERED, WANTED = 1, 2
PASSED = -1


def pack(a: np.ndarray) -> bytes:
    """Column by column and byte by byte, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(a[n]).view(np.uint8).reshape(len(a), -1).T).tobytes() for n in a.dtype.names) if len(a) else b""


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for name in kind.names if n else ():
        step = kind[name].itemsize * n
        out[name] = np.ascontiguousarray(np.frombuffer(data, np.uint8, step, at).reshape(-1, n).T).view(kind[name]).ravel()
        at += step
    return out


def dealt(a: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    a, bucket = a[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(a) else []
    return [(int(bucket[s]), kind, pack(x)) for s, x in zip(starts, np.split(a, starts[1:]))] if len(a) else []


class Dealer:
    """Gathers records of one kind over a task's buckets and deals them to their documents, so few large rows are sent."""

    def __init__(self, buckets: int, *kinds: int):
        self.buckets, self.held, self.size = buckets, {k: [] for k in kinds}, 0

    def add(self, kind: int, a: np.ndarray) -> None:
        if len(a):
            self.held[kind].append(a)
            self.size += len(a)

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.size >= least:
            rows = []
            for kind, held in self.held.items():
                if held:
                    a = np.concatenate(held)
                    rows += dealt(a, home(a["doc"], self.buckets), kind)
                    held.clear()
            self.size = 0
            yield batch_of(rows)


class Grams:
    """Hashes of substrings: a sum of random values of bytes times powers of an odd base, from sums of prefixes."""

    def __init__(self):
        rng = np.random.default_rng(20)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, TOGETHER + (TOGETHER >> 2))
            base = np.full(self.size, BASE, np.uint64)
            base[0] = 1
            self.up = np.cumprod(base)
            base[1:] = np.uint64(pow(BASE, -1, 1 << 64))
            self.down = np.cumprod(base)

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def pieces(self, raw: np.ndarray, lengths: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """PIECE records (with the whole 64-bit gram as an extra field) of texts that lie end to end in raw."""
        n, ends = len(raw), np.cumsum(lengths)
        if n < LENGTH:
            return np.empty(0, [("whole", "<u8"), *PIECE.descr])
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[:n], out=sums[1:])
        h = self.mix((sums[K:] - sums[:-K]) * self.down[: n - K + 1])
        window, done = LENGTH - K + 1, 1
        low = h
        while 2 * done <= window:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if done < window:
            low = np.minimum(low[: len(low) - (window - done)], low[window - done :])
        of = np.repeat(np.arange(len(lengths)), lengths)[: len(low)]
        good = np.arange(len(low)) + LENGTH <= ends[of]
        at = np.flatnonzero(good)
        if not len(at):
            return np.empty(0, [("whole", "<u8"), *PIECE.descr])
        low, of = low[at], of[at]
        first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
        run = np.diff(np.append(first, len(at)))
        if run.max() > LONGEST:  # periodic texts: cut where it suits, contents still tell
            more = np.repeat(first, -(-run // LONGEST))
            inside = np.arange(len(more)) - np.repeat(np.cumsum(-(-run // LONGEST)) - -(-run // LONGEST), -(-run // LONGEST))
            end = np.repeat(first + run, -(-run // LONGEST))
            first = more + inside * LONGEST
            run = np.minimum(LONGEST, end - first)
        start = at[first]
        out = np.empty(len(first), [("whole", "<u8"), *PIECE.descr])
        out["whole"], out["size"], out["doc"], out["tag"] = low[first], run, docs[of[first]], tags[of[first]]
        out["start"] = start - (ends - lengths)[of[first]]
        return out


def _as(a: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The same records under another type; fields that they lack are 0."""
    out = np.zeros(len(a), kind)
    for name in kind.names:
        if name in a.dtype.names:
            out[name] = a[name]
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(raw, lengths, docs, tags) of TOGETHER bytes, or one longer text, at a time."""
    held, docs, tags, size = [], [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_buffer()
            held.append(np.frombuffer(text, np.uint8) if text.size else np.empty(0, np.uint8))
            docs.append(batch.column(0)[i].as_py())
            tags.append(batch.column(1)[i].as_py())
            size += text.size
            if size >= TOGETHER:
                yield np.concatenate(held), np.array([*map(len, held)]), np.array(docs, np.int64), np.array(tags, np.uint16)
                held, docs, tags, size = [], [], [], 0
    if held:
        yield np.concatenate(held), np.array([*map(len, held)]), np.array(docs, np.int64), np.array(tags, np.uint16)


def find_pieces(buckets: int) -> Callable:
    """Texts to pieces, dealt by their grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for raw, lengths, docs, tags in _texts(batches):
            p = grams.pieces(raw, lengths, docs, tags)
            out = _as(p, PIECE)
            out["gram"] = p["whole"] // np.uint64(buckets)
            yield batch_of(dealt(out, (p["whole"] % np.uint64(buckets)).astype(np.int32), WANTED))

    return run


def match_pieces(buckets: int) -> Callable:
    """Pieces of a bucket to those that are sent for, dealt to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets, WANTED)
        for bucket, rows in by_bucket(batches):
            p = np.concatenate([unpack(d, PIECE) for _, d in rows])
            p = p[np.lexsort((p["doc"], p["gram"]))]
            head = np.flatnonzero(np.r_[True, p["gram"][1:] != p["gram"][:-1]])
            size = np.diff(np.append(head, len(p)))
            first = p["doc"][head]
            many = np.repeat(size, size)
            mine = np.repeat(first != p["doc"][head + size - 1], size)
            p, many, first = p[mine], many[mine], np.repeat(first, size)[mine]
            w = _as(p, WANT)
            w["hot"] = many > SHARED
            w["shard"] = np.where(many > MANY, -1, np.where(many > SHARED, bucket, home(first, buckets)))
            w["key"] = np.where(many > SHARED, p["gram"], (first.view(np.uint64) * np.uint64(BASE) >> np.uint64(32)).astype(np.uint32))
            dealer.add(WANTED, w)
            yield from dealer.out(DEALT)
        yield from dealer.out()

    return run


def spans(w: np.ndarray) -> np.ndarray:
    """WANT records with those joined that follow each other in a document and go to one place; sorted by document."""
    w = w[np.lexsort((w["start"], w["key"], w["shard"], w["tag"], w["doc"]))]
    if not len(w):
        return w
    start, end = w["start"].astype(np.int64), w["start"].astype(np.int64) + w["size"]
    new = np.ones(len(w), bool)
    new[1:] = w["hot"][1:].astype(bool) | (start[1:] != end[:-1])
    for name in ("doc", "tag", "shard", "key"):
        new[1:] |= w[name][1:] != w[name][:-1]
    head = np.flatnonzero(new)
    out = w[head]
    out["size"] = end[np.append(head[1:], len(w)) - 1] - start[head]
    return out


def send_pieces(buckets: int) -> Callable:
    """Rows of a document bucket, wanted pieces before texts, to the bytes of those pieces, dealt to shards. Of equal hot
    pieces the smallest document's goes; those of later documents are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, asked, texts in with_texts(batches):
            w = spans(np.concatenate([unpack(d, WANT) for _, d in asked] or [np.empty(0, WANT)]))
            key, plain = _key(w), w.tolist()
            out: dict[int, list] = {}
            hot: dict[tuple[int, int, bytes], list] = {}
            size = 0
            for doc, tag, text in texts:
                lo, hi = _find(key, doc, tag)
                for r in plain[lo:hi]:
                    _, _, start, n, shard, sorted_with, is_hot = r
                    x = text[start : start + n + LENGTH - 1]
                    if is_hot:
                        hot.setdefault((shard, sorted_with, x), []).append((doc, tag, start, n))
                    else:
                        out.setdefault(shard, []).append((doc, tag, start, n, sorted_with, x))
                        size += len(x)
                if size > TOGETHER:
                    yield _sent(out)
                    out, size = {}, 0
            later = []
            for (shard, sorted_with, x), found in hot.items():
                least = min(found)[0]
                later += [f for f in found if f[0] > least]
                for doc, tag, start, n in found:
                    if doc > least:
                        continue
                    if shard >= 0:
                        out.setdefault(shard, []).append((doc, tag, start, n, sorted_with, x))
                        continue
                    for i in range(n):
                        name = int.from_bytes(hashlib.blake2b(x[i : i + LENGTH], digest_size=8).digest())
                        out.setdefault(name % buckets, []).append((doc, tag, start + i, 1, name // buckets & 0xFFFFFFFF, x[i : i + LENGTH]))
            yield _sent(out)
            if later:
                yield batch_of([(bucket, PASSED, pack(np.array(later, COVER)))])

    return run


def _sent(out: dict[int, list]) -> pa.RecordBatch:
    rows = []
    for shard, found in out.items():
        a = np.array([x[:5] for x in found], SENT)
        rows.append((shard, len(a), pack(a) + b"".join(x[5] for x in found)))
    return batch_of(rows)


def _key(a: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), [("doc", "<i8"), ("tag", "<u2")])
    out["doc"], out["tag"] = a["doc"], a["tag"]
    return out


def _find(key: np.ndarray, doc: int, tag: int) -> tuple[int, int]:
    lo, hi = np.searchsorted(key["doc"], doc), np.searchsorted(key["doc"], doc, "right")
    return lo + int(np.searchsorted(key["tag"][lo:hi], tag)), lo + int(np.searchsorted(key["tag"][lo:hi], tag, "right"))


def earlier(sent: np.ndarray, raw: bytes) -> np.ndarray:
    """Of spans (SENT records, their bytes end to end): the strings that a smaller document has too, as few COVER records."""
    strings = sent["size"].astype(np.int64)
    sizes = strings + LENGTH - 1
    n = len(raw) + len(sent)
    at = np.cumsum(sizes + 1) - sizes - 1  # with a separator after each piece
    inside = np.ones(n, bool)
    inside[at + sizes] = False
    plain = np.full(n + 1, 0xFF, np.uint8)  # no byte of UTF-8
    plain[:-1][inside] = np.frombuffer(raw, np.uint8)
    t = plain.astype(np.int32) + SHIFT
    t[:-1][~inside] = SEPARATOR
    t[-1] = END
    # The place of a string has its document's rank, others none: only strings are compared.
    ranks = np.unique(sent["doc"], return_inverse=True)[1].astype(np.int32)
    doc = np.full(n + 1, -1, np.int32)
    doc[np.repeat(at - np.cumsum(strings) + strings, strings) + np.arange(strings.sum())] = np.repeat(ranks, strings)
    sa = suffix_array(t, LENGTH + 6)
    sa = sa.take(np.flatnonzero(doc.take(sa) >= 0))
    start = np.flatnonzero(~common(plain, sa, LENGTH))
    doc = doc.take(sa)
    later = np.flatnonzero(doc > np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(sa)))))
    hit = np.zeros(n + 2, np.int8)
    hit[sa.take(later) + 1] = 1
    step = np.diff(hit)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    of = np.searchsorted(at, begin, "right") - 1
    out = np.empty(len(begin), COVER)
    out["doc"], out["tag"], out["size"] = sent["doc"][of], sent["tag"][of], end - begin
    out["start"] = sent["start"][of] + (begin - at[of])
    return out


def sort_shards(buckets: int) -> Callable:
    """Sent bytes of a shard to covered strings, dealt to their documents.

    Equal strings have one key. So a shard beyond SORTED bytes is sorted in parts of whole keys, each span once. A key has
    at most MANY pieces of a gram, or SHARED spans over each place of one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets, COVERED)
        for _, rows in by_bucket(batches):
            for n, d in rows:
                if n == PASSED:
                    dealer.add(COVERED, unpack(d, COVER))
            rows = [r for r in rows if r[0] != PASSED]
            if not rows:
                continue
            sent = np.concatenate([unpack(d[: n * SENT.itemsize], SENT) for n, d in rows])
            raw = b"".join(d[n * SENT.itemsize :] for n, d in rows)
            sizes = sent["size"].astype(np.int64) + LENGTH - 1
            start = np.cumsum(sizes) - sizes
            order = np.argsort(sent["key"], kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            cut = np.flatnonzero(np.r_[True, np.diff(sent["key"][order].astype(np.int64)) != 0])
            cut = cut[np.r_[True, np.diff(before[cut] // SORTED) > 0]]
            for a, b in zip(cut, [*cut[1:], len(order)]):
                mine = np.sort(order[a:b])
                dealer.add(COVERED, earlier(sent[mine], b"".join(raw[start[i] : start[i] + sizes[i]] for i in mine)))
                yield from dealer.out(DEALT)
        yield from dealer.out()

    return run


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_bytes", "n_bytes", "n_removed", "n_spans"]
    for _, rows, texts in with_texts(batches):
        c = np.concatenate([unpack(d, COVER) for k, d in rows if k == COVERED] or [np.empty(0, COVER)])
        c = c[np.lexsort((c["start"], c["tag"], c["doc"]))]
        key, out, held = _key(c), [], 0
        for doc, tag, text in texts:
            lo, hi = _find(key, doc, tag)
            left, removed, spans = text, 0, 0
            if hi > lo:
                start = c["start"][lo:hi].astype(np.int64)
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + c["size"][lo:hi] + (LENGTH - 1), -1)
                gone = np.cumsum(depth[:-1]) > 0
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((None if doc == NO_ID else doc, left, len(text), removed, spans))
            held += len(text)
            if held > 4 * TOGETHER:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names)


def dedup_substrings(docs: DataFrame, bucket_bytes: int = 1 << 23) -> DataFrame:
    """(doc_id, text_bytes, n_bytes, n_removed, n_spans) of documents (doc_id, text): the bytes that stay.

    Null and empty texts, and those under LENGTH bytes, stay as they are. Null ids come after all others. Rows that repeat
    an id are never earlier than each other, so equal ones both stay. A text of any length is one row's work and is hashed
    whole. Buckets are as many as bucket_bytes go into all texts. No rows give no rows.
    """
    size = docs.agg(F.sum(F.octet_length(whole()) + 1)).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    tag = F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("int")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), whole().alias("text")).select("doc", tag.alias("tag"), F.col("text").cast("binary").alias("text"))
    gather = lambda df, m, *by: df.repartitionById(m, F.col("bucket")).sortWithinPartitions("bucket", *by)
    pieces = gather(texts.mapInArrow(find_pieces(n), ROWS), n)
    found = written(pieces.mapInArrow(match_pieces(n), ROWS))
    bucket = F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")
    theirs = texts.select(bucket.alias("bucket"), F.lit(9).alias("kind"), F.lit(None).cast("binary").alias("data"), "doc", "tag", "text")
    blank = [F.lit(None).cast("long").alias("doc"), F.lit(None).cast("int").alias("tag"), F.lit(None).cast("binary").alias("text")]

    def beside(rows: DataFrame) -> DataFrame:
        return gather(rows.select("bucket", "kind", "data", *blank).unionByName(theirs), n, "kind")

    sent = beside(found).mapInArrow(send_pieces(n), ROWS)
    covered = written(gather(sent, n).mapInArrow(sort_shards(n), ROWS))
    discard(found)
    return beside(covered).mapInArrow(cut_texts, "doc_id long, text_bytes binary, n_bytes long, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text_bytes", 256).alias("kept_sha256"))
