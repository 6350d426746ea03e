"""LM scoring by online logistic context mixing: every bit of every token occurrence is predicted and mixed.

A text is its tokens: lower-cased words and one end. A token is a code word: the path of a Huffman code over the training
vocabulary, where a token with at least 1 / FREQUENT of all training tokens has a leaf of its own, the others share a leaf
with those of like frequency (a power of two), below which their number in that class is coded, bit by bit. Tokens that no
other training occurrence has take an escape and are spelled, byte by byte, from hashed contexts inside the token.

Each bit has three predictors: order 0 (the share of either side in the code), order 1 (counts after the token before) and
order 2 (counts after the two tokens before). Counts are those of all training documents, an occurrence in training itself
left out. Predictions are stretched and combined by weights which a gate selects (how much either context has seen);
an adaptive map refines the result, and weights and map learn online from the bits of training documents. Where
no context has seen a prefix any more, the rest of the path costs what order 0 says.

Steps, each one shuffle: blocks of documents ask for their distinct tokens' counts; buckets of tokens number and spell them;
blocks send each occurrence to the bucket of its context; such a bucket counts, mixes, and returns sums by document;
blocks add up. Buckets are decided by ids, tokens and bytes of input alone, so scores don't depend on the cluster.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import ROWS, batch_of, by_bucket, tuples
from .common import discard, documents, whole, written
from .suffix_dedup import Grams

FOLDS, HELD = 7, 2
#: Share of training tokens from which a token has its own leaf; longest Huffman path; bits of a code word that contexts predict.
FREQUENT, MOST_BITS, DEPTH = 4096, 16, 32
#: Occurrences of a context token in one class of it; records mixed at once; bytes tokenised at once.
CAP, CHUNK, AT_ONCE = 1 << 16, 1 << 16, 1 << 20
#: What the lower order counts for in a higher one, by its number of occurrences; rate of the weights; bins of the map.
PRIOR, RATE, BINS = (2.0, 0.5), 0.25, 32
#: Contexts of spelling, bits of their slots, tokens' bytes spelled at once, counts added to both sides.
ORDERS, SLOT_BITS, SPELLED, ADD = 5, 19, 1 << 18, 0.3
CLASSES = 64
STOP = 0x20
#: ASCII bytes in lower case, and which are white space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Confidence in counts up to 31, of which gates are made.
TRUST = np.array([0, 1, 2, 2, *[3] * 8, *[4] * 20], np.int8)
GATES = 25


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD if doc_id is not None else False


def planes(a: np.ndarray) -> bytes:
    """Byte by byte of all values, which compresses better."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


class Reader:
    """Takes arrays from packed bytes, in the order they were put."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        self.at += 4
        return struct.unpack_from("<I", self.data, self.at - 4)[0]

    def take(self, n: int, kind: str) -> np.ndarray:
        step = np.dtype(kind).itemsize
        raw = np.frombuffer(self.data, np.uint8, n * step, self.at).reshape(step, n)
        self.at += n * step
        return np.ascontiguousarray(raw.T).view(kind).ravel()

    def rest(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8, offset=self.at)


def token_hashes(grams: Grams, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    grams._powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(grams.value[raw] * grams.up[: len(raw)], out=sums[1:])
    return grams.mix((sums[ends] - sums[starts]) * grams.down[starts])


class Block:
    """A block's documents by id and text, with all their tokens."""

    def __init__(self, grams: Grams, docs: list[tuple[int | None, bytes]]):
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0, d[1]))
        self.docs = docs
        self.held = np.array([held_out(d) for d, _ in docs], bool)
        self.sizes = np.array([len(t) for _, t in docs], np.int64)
        raws, hashes, starts, lengths, counts = [], [], [], [], []
        at, first, size = 0, 0, 0
        for i, (_, text) in enumerate(docs):
            size += len(text) + 1
            if size >= AT_ONCE or i == len(docs) - 1:
                raw, s, e, n = self._split([t for _, t in docs[first : i + 1]])
                raws.append(raw)
                hashes.append(token_hashes(grams, raw, s, e))
                starts.append((s + at).astype(np.uint32))
                lengths.append((e - s).astype(np.uint32))
                counts.append(n)
                at, first, size = at + len(raw), i + 1, 0
        self.raw, self.hash, self.start, self.length, self.n = (np.concatenate(x) for x in (raws, hashes, starts, lengths, counts))
        self.doc = np.repeat(np.arange(len(docs), dtype=np.uint32), self.n)
        self.order = np.argsort(self.hash)
        s = self.hash[self.order]
        self.head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        self.distinct = s[self.head]

    @staticmethod
    def _split(texts: list[bytes]):
        """(bytes in lower case with a line end after each text, starts, ends, tokens a text); that line end is the end."""
        raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        word = np.r_[False, ~WHITE[raw]]
        edge = np.flatnonzero(word[1:] != word[:-1])
        s, e = edge[0::2], edge[1::2]
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        before = np.searchsorted(s, stop)
        n = np.diff(before, prepend=0) + 1
        ends = np.cumsum(n) - 1
        starts = np.empty(len(s) + len(texts), np.int64)
        is_end = np.zeros(len(starts), bool)
        is_end[ends] = True
        stops = np.empty_like(starts)
        starts[is_end], stops[is_end] = stop, stop + 1
        starts[~is_end], stops[~is_end] = s, e
        return raw, starts, stops, n

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the distinct tokens by bucket, where each bucket's begin)"""
        of = (self.distinct >> np.uint64(40)) % np.uint64(buckets)
        by = np.argsort(of, kind="stable")
        return by, np.searchsorted(of[by], np.arange(buckets + 1, dtype=np.uint64))


def gathered(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of slices, end to end."""
    length = length.astype(np.int64)
    return raw[np.repeat(start.astype(np.int64) - np.cumsum(length) + length, length) + np.arange(length.sum())]


def blocks(batches: Iterator[pa.RecordBatch], grams: Grams) -> Iterator[tuple[int, list[tuple[int, bytes]], Block]]:
    """(block, rows for it by kind, its documents) of rows (bucket, kind, data, doc, text) sorted by bucket."""
    now, rows, docs = None, [], []
    for b, k, d, doc, text in tuples(batches):
        if b != now and docs:
            yield now, sorted(rows), Block(grams, docs)
        if b != now:
            now, rows, docs = b, [], []
        if text is None:
            rows.append((k, d))
        else:
            docs.append((doc, text))
    if docs:
        yield now, sorted(rows), Block(grams, docs)


def ask(buckets: int) -> Callable:
    """Blocks to their distinct tokens with training counts, dealt to buckets of tokens; kind names the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for block, _, b in blocks(batches, grams):
            counts = np.add.reduceat((~b.held)[b.doc[b.order]], b.head, dtype=np.uint32)
            some = b.order[b.head]
            by, cut = b.dealt(buckets)
            for k in range(buckets):
                if cut[k] < cut[k + 1]:
                    mine = by[cut[k] : cut[k + 1]]
                    length = b.length[some[mine]]
                    yield batch_of([(k, block, struct.pack("<I", len(mine)) + planes(length) + planes(counts[mine]) + gathered(b.raw, b.start[some[mine]], length).tobytes())])

    return run


# Spelling.


class Code:
    """A Huffman code of bytes from their counts: for each byte the inner nodes on its path and the bits taken there."""

    def __init__(self, counts: np.ndarray):
        paths = huffman(np.maximum(counts, max(1, int(counts.sum()) >> 14)))
        self.depth = max(n for n, _ in paths)
        self.n = np.array([n for n, _ in paths], np.int8)
        self.nodes, self.bits = np.zeros((256, self.depth), np.uint64), np.zeros((256, self.depth), np.int8)
        for b, (n, code) in enumerate(paths):
            for d in range(n):
                self.nodes[b, d], self.bits[b, d] = (1 << d) | (code >> (n - d)), code >> (n - d - 1) & 1


def huffman(weights: np.ndarray) -> list[tuple[int, int]]:
    """(length, code) of each symbol; ties by place, so that equal weights give equal codes everywhere."""
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children, node = {}, len(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[node] = (x, y)
        heapq.heappush(heap, (a + b, node))
        node += 1
    out, todo = [(0, 0)] * len(weights), [(heap[0][1], 0, 0)]
    while todo:
        x, n, code = todo.pop()
        if x in children:
            todo += [(children[x][0], n + 1, 2 * code), (children[x][1], n + 1, 2 * code + 1)]
        else:
            out[x] = (n, code)
    return out


def spelling(raw: np.ndarray, lengths: np.ndarray, seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Bits that the wanted ones of distinct tokens (bytes end to end) cost to spell, in their order.

    Counts by slot (context, place in the byte's code) come from all tokens that training has seen, each of them once and
    the token itself left out; weights and map learn online from those among the wanted ones.
    """
    grown = np.empty(len(raw) + len(lengths), np.uint8)
    stops = np.cumsum(lengths.astype(np.int64) + 1) - 1
    is_stop = np.zeros(len(grown), bool)
    is_stop[stops] = True
    grown[is_stop], grown[~is_stop] = STOP, raw
    of = np.repeat(np.arange(len(lengths)), lengths.astype(np.int64) + 1)
    code = Code(np.bincount(grown[seen[of]], minlength=256))
    cuts = [0]
    for i in np.flatnonzero(np.diff(stops // SPELLED)) + 1:
        cuts.append(int(i))
    cuts = sorted({*cuts, len(lengths)})
    parts = [(a, b, (stops[a - 1] + 1 if a else 0), stops[b - 1] + 1) for a, b in zip(cuts[:-1], cuts[1:])]
    table = np.zeros((ORDERS, 2 << SLOT_BITS), np.int32)
    pairs = table.view(np.int64)
    for _, _, x, y in parts:
        hashes = spelled(grown[x:y])
        for live, bits, slots in bit_slots(code, grown[x:y], hashes):
            good = seen[of[x:y][live]]
            for k in range(ORDERS):
                np.add.at(table[k], slots[k][good] * 2 + bits[good], np.int32(1))
    mixer, out = Mixer(ORDERS + 1, np.r_[np.linspace(0.1, 0.5, ORDERS), 0.0], ORDERS + 1), np.zeros(len(lengths))
    for a, b, x, y in parts:
        if not wanted[a:b].any():
            continue
        mine = np.flatnonzero(wanted[of[x:y]])
        part, own = grown[x:y], of[x:y]
        hashes = spelled(part)
        part, own, hashes = part[mine], own[mine], hashes[:, mine]
        for live, bits, slots in bit_slots(code, part, hashes):
            t = seen[own[live]].astype(np.float32)
            bit, gate, inputs = bits.astype(bool), np.zeros(len(live), np.int64), []
            own0, own1 = t * ~bit, t * bit
            for k in range(ORDERS):
                n = pairs[k][slots[k]].view(np.int32).reshape(-1, 2).astype(np.float32)
                zeros, ones = np.maximum(n[:, 0] - own0, 0), np.maximum(n[:, 1] - own1, 0)
                inputs.append(np.log((ones + ADD) / (zeros + ADD)))
                gate += zeros + ones >= (4 if k else 1)
            inputs.append(np.ones(len(live), np.float32))
            out += np.bincount(own[live], mixer.cost(inputs, gate, bit, t), len(out))
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def spelled(raw: np.ndarray) -> np.ndarray:
    """Hashes of each byte's contexts [ORDERS, bytes]: its place, and up to four bytes before it inside the token."""
    at = np.arange(len(raw))
    place = at - np.maximum.accumulate(np.where(np.r_[True, raw[:-1] == STOP], at, 0))
    context, hashes = np.zeros(len(raw), np.uint64), np.empty((ORDERS, len(raw)), np.uint64)
    hashes[0] = mix(np.minimum(place, 12).astype(np.uint64))
    for k in range(1, ORDERS):
        before = np.zeros(len(raw), np.uint64)
        before[k:] = raw[:-k]
        context |= np.where(place >= k, before, np.uint64(0)) << np.uint64(8 * (k - 1))
        hashes[k] = mix(context + (np.uint64(k) << np.uint64(56)))
    return hashes


def bit_slots(code: Code, raw: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each depth of the code: the bytes that reach it, their bits, their slots by order."""
    live = np.arange(len(raw))
    for d in range(code.depth):
        live = live[code.n[raw[live]] > d]
        if not len(live):
            return
        b = raw[live]
        node = code.nodes[b, d] * np.uint64(0x9E3779B97F4A7C15)
        yield live, code.bits[b, d], [(((h[live] ^ node) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)).view(np.int64) for h in hashes]


class Mixer:
    """Gated weights over stretched predictions, and a map by gate and bin of what they make; both learn after each step."""

    def __init__(self, inputs: int, weights: np.ndarray, gates: int):
        self.gates, self.weights = gates, np.tile(weights.astype(np.float32), (gates, 1)).T.copy()
        centre = 1 / (1 + np.exp(-(np.arange(BINS) + 0.5 - BINS / 2) / 2))
        self.refined = np.tile(np.stack([1 - centre, centre], 1) * 64, (gates, 1, 1)).reshape(-1, 2)

    def cost(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """Bits of information of each bit; learn: the share with which it counts for the weights."""
        dot = np.zeros(len(bit), np.float32)
        for w, x in zip(self.weights, inputs):
            dot += w.take(gate) * x
        np.clip(dot, -15.9, 15.9, out=dot)
        p = 1 / (1 + np.exp(-dot))
        cell = gate * BINS + np.clip(dot * 2 + BINS / 2, 0, BINS - 1).astype(np.int64)
        ratio = (self.refined[:, 1] / self.refined.sum(axis=1)).astype(np.float32)
        final = np.clip(0.5 * (p + ratio.take(cell)), 1e-5, 1 - 1e-5)
        out = -np.log2(np.abs(~bit - final))  # of the side that came
        counts = np.bincount(2 * cell + bit, learn, 2 * self.gates * BINS)
        n = counts.reshape(self.gates, -1).sum(axis=1)
        if n.any():
            error = (bit - p) * learn
            scale = RATE / np.maximum(n, 16)
            for w, x in zip(self.weights, inputs):
                w += np.clip(np.bincount(gate, error * x, self.gates) * scale, -0.1, 0.1)
            self.refined += counts.reshape(-1, 2)
        return out


def number(buckets: int) -> Callable:
    """A bucket's requests to replies (block, bucket, data): count, number in its class, and spelling of those seen once
    or never, in the order each block asked. Kind -1: what the bucket holds by class; kind -2: its frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for bucket, rows in by_bucket(batches):
            rows.sort(key=lambda r: r[0])
            sizes, lengths, counts, raws, hashes = [], [], [], [], []
            for _, data in rows:
                r = Reader(data)
                m = r.number()
                n, c, raw = r.take(m, "<u4"), r.take(m, "<u4"), r.rest()
                end = np.cumsum(n.astype(np.int64))
                sizes.append(m)
                lengths.append(n)
                counts.append(c)
                raws.append(raw)
                hashes.append(token_hashes(grams, raw, end - n, end))
            lengths, counts, raw, h = (np.concatenate(x) for x in (lengths, counts, raws, hashes))
            order = np.argsort(h)
            head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
            place = np.empty(len(h), np.int64)
            place[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
            total = np.add.reduceat(counts[order].astype(np.int64), head)
            kind = np.frexp(np.maximum(total, 1).astype(np.float64))[1] - 1
            by = np.argsort(kind, kind="stable")
            first = np.searchsorted(kind[by], np.arange(CLASSES))
            index = np.empty(len(total), np.uint32)
            index[by] = np.arange(len(by)) - first[kind[by]]
            some = order[head]
            starts = np.cumsum(lengths.astype(np.int64)) - lengths
            rare = total <= 1
            bits = spelling(gathered(raw, starts[some], lengths[some]), lengths[some], total > 0, rare).astype("<f4")
            at = 0
            for (block, _), m in zip(rows, sizes):
                mine = place[at : at + m]
                at += m
                yield batch_of([(block, bucket, struct.pack("<I", m) + planes(total[mine]) + planes(index[mine]) + planes(bits[mine][rare[mine]]))])
            stats = np.zeros((3, CLASSES), np.int64)
            stats[0], stats[1] = (np.bincount(kind[total > 0], w, CLASSES) for w in (None, total[total > 0]))
            stats[2] = stats[0]
            often = np.flatnonzero(total * FREQUENT >= max(1, int(total.sum())))
            yield batch_of([(-1, -1, stats.tobytes()), *((-1, -2, struct.pack(">QQ", int(total[i]), int(h[some[i]]))) for i in often)])

    return run


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros((3, CLASSES), np.int64)
    for batch in batches:
        for d in batch.column(2).to_pylist():
            x = np.frombuffer(d, np.int64).reshape(out.shape)
            out = np.stack([out[0] + x[0], out[1] + x[1], np.maximum(out[2], x[2])])
    yield batch_of([(0, 0, out.tobytes())])


@dataclass
class Vocabulary:
    """The code: leaves are the escape, frequent tokens, and classes of like frequency. At most FREQUENT + CLASSES leaves."""

    tokens: int  # training tokens
    distinct: int
    frequent: np.ndarray  # hashes, sorted
    own: np.ndarray  # leaf of each
    leaf: np.ndarray  # leaf of each class, -1: none
    size: np.ndarray  # bits of a leaf's path
    code: np.ndarray
    more: np.ndarray  # bits of the number below it
    bits: np.ndarray  # what a token of the leaf costs at order 0

    @classmethod
    def of(cls, stats: np.ndarray, found: list[tuple[int, int]], buckets: int) -> Vocabulary:
        number, mass, most = stats
        n = int(mass.sum())
        found = [(c, h) for c, h in found if c > 1 and c * FREQUENT >= n]
        number, mass = number.copy(), mass.copy()
        for c, _ in found:
            number[c.bit_length() - 1] -= 1
            mass[c.bit_length() - 1] -= c
        classes = [q for q in range(1, CLASSES) if number[q] > 0]
        weights = np.array([max(1, int(mass[0])), *(c for c, _ in found), *(int(mass[q]) for q in classes)], np.int64)
        if len(weights) == 1:
            weights = np.append(weights, 1)  # so that there is a bit
        floor = max(1, int(weights.sum()) >> 13)
        while max(s for s, _ in huffman(np.maximum(weights, floor))) > MOST_BITS:
            floor *= 2
        paths = huffman(np.maximum(weights, floor))
        more, leaf = np.zeros(len(weights), np.int64), np.full(CLASSES, -1, np.int64)
        for i, q in enumerate(classes, 1 + len(found)):
            more[i], leaf[q] = (int(most[q]) * buckets - 1).bit_length(), i
        hashes = np.array([h for _, h in found], np.uint64)
        by = np.argsort(hashes)
        size, code = np.array([s for s, _ in paths]), np.array([c for _, c in paths], np.uint64)
        return cls(n, int(stats[0].sum()), hashes[by], by + 1, leaf, size, code, more, -np.log2(weights / weights.sum()) + more)

    def words(self, hashes: np.ndarray, total: np.ndarray, index: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(the first DEPTH bits of each token's code word, left-aligned; its bits at order 0, without spelling)"""
        kind = np.frexp(np.maximum(total, 1).astype(np.float64))[1] - 1
        leaf = np.where(total > 1, self.leaf[kind], 0)
        below = index.astype(np.uint64) * np.uint64(buckets) + bucket.astype(np.uint64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            mine = (self.frequent[at] == hashes) & (total > 1)
            leaf = np.where(mine, self.own[at], leaf)
        size, more = self.size[leaf], self.more[leaf]
        below = np.where(more > 0, below, np.uint64(0))
        word = (self.code[leaf] << (64 - size).astype(np.uint64)) | (below << (64 - size - more).astype(np.uint64) if len(below) else below)
        return (word >> np.uint64(64 - DEPTH)).astype(np.uint32), self.bits[leaf]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(bits of a code word by its first MOST_BITS bits; share of the right side at each inner node, by heap place)"""
        lengths, right = np.zeros(1 << MOST_BITS, np.uint8), np.full(2 << MOST_BITS, 0.5, np.float32)
        shares = 2.0 ** -(self.bits - self.more)
        mass = np.zeros(2 << MOST_BITS)
        for s, c, m, x in zip(self.size.tolist(), self.code.tolist(), self.more.tolist(), shares.tolist()):
            lengths[c << (MOST_BITS - s) : (c + 1) << (MOST_BITS - s)] = min(DEPTH, s + m)
            node = (1 << s) | c
            while node > 1:
                mass[node] += x
                node >>= 1
        inner = np.arange(1, 1 << MOST_BITS)
        both = mass[2 * inner] + mass[2 * inner + 1]
        right[inner] = np.where(both > 0, np.clip(mass[2 * inner + 1] / np.where(both > 0, both, 1), 1e-6, 1 - 1e-6), 0.5)
        return lengths, right


def send(n: int, buckets: int, vocabulary: Vocabulary) -> Callable:
    """Blocks and the replies to them to occurrences, dealt to the buckets of their contexts, and what each block knows of
    its documents (kind below 0)."""
    norm = math.log10(vocabulary.tokens + vocabulary.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        end = token_hashes(grams, np.array([10], np.uint8), np.array([0]), np.array([1]))[0]
        for block, rows, b in blocks(batches, grams):
            by, cut = b.dealt(buckets)
            total, index, spell = np.zeros(len(by), np.int64), np.zeros(len(by), np.uint32), np.zeros(len(by))
            bucket = np.zeros(len(by), np.int64)
            for k, data in rows:
                r, mine = Reader(data), by[cut[k] : cut[k + 1]]
                m = r.number()
                total[mine], index[mine], bucket[mine] = r.take(m, "<i8"), r.take(m, "<u4"), k
                rare = mine[total[mine] <= 1]
                spell[rare] = r.take(len(rare), "<f4")
            word, bits = vocabulary.words(b.distinct, total, index, bucket, buckets)
            bits = bits + spell
            group = np.empty(len(b.hash), np.int32)
            group[b.order] = np.repeat(np.arange(len(b.head), dtype=np.int32), np.diff(np.append(b.head, len(b.hash))))
            last = np.cumsum(b.n)
            sums = lambda x: np.add.reduceat(x[group], last - b.n)
            known, base, cost = sums((total > 0).astype(np.int64)), sums(np.log10(total + 1.0) - norm), sums(bits)
            ids = np.array([d or 0 for d, _ in b.docs], np.int64)
            null = np.array([d is None for d, _ in b.docs], np.uint8)
            table = struct.pack("<I", len(ids)) + b"".join(planes(x) for x in (ids, null, b.held.astype(np.uint8), b.n.astype(np.int64), known, base, cost, b.sizes))
            out = [(block % n, -1 - block, table)]
            # The contexts of each token; ends of documents stand for what is before their first.
            one = np.r_[end, b.hash[:-1]]
            two = np.r_[end, one[:-1]]
            two[last - b.n] = end
            often = total[group]
            ends = int(total[np.searchsorted(b.distinct, end)])
            classes = 1 + np.r_[ends, often[:-1]] // CAP
            context = grams.mix(one + ((two >> np.uint64(33)) % classes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
            to = (context >> np.uint64(32)) % np.uint64(n)
            order = np.argsort((to << np.uint64(32)) | (context & np.uint64(0xFFFFFFFF)))
            to, context = to[order], (context[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            two = ((two ^ (two >> np.uint64(17))) & np.uint64(0xFFFF)).astype(np.uint16)[order]
            words, doc = word[group[order]], b.doc[order]
            doc = doc | (b.held[doc].astype(np.uint32) << np.uint32(31))
            cut = np.searchsorted(to, np.arange(n + 1, dtype=np.uint64))
            for k in range(n):
                x, y = cut[k], cut[k + 1]
                if x < y:
                    c = context[x:y]
                    new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                    run_ = np.diff(np.append(new, y - x)).astype(np.uint32)
                    head = struct.pack("<III", len(ids), len(new), y - x)
                    out.append((k, block, head + planes(np.diff(c[new], prepend=np.uint32(0)).astype(np.uint32)) + planes(run_) + planes(two[x:y]) + planes(words[x:y]) + planes(doc[x:y])))
                    if len(out) >= 64:
                        yield batch_of(out)
                        out = []
            yield batch_of(out)

    return run


class Side:
    """One order's view of records that lie sorted by context and code word: the group of each record that is still live, and
    training sums of all."""

    def __init__(self, perm: np.ndarray | None, new: np.ndarray, train: np.ndarray):
        """perm: the records in this order; new: where a context begins in it. All records are live."""
        self.perm = perm
        n = len(train)
        head = np.flatnonzero(new)
        a, b = (np.repeat(x, np.diff(np.append(head, n))) for x in (head, np.append(head[1:], n)))
        if perm is None:
            self.a, self.b = a, b
        else:
            self.a, self.b = np.empty(n, np.int64), np.empty(n, np.int64)
            self.a[perm], self.b[perm] = a, b
        self.sums = _sums(train if perm is None else train.take(perm))

    def seen(self) -> np.ndarray:
        """Training records in each live record's group."""
        return self.sums.take(self.b) - self.sums.take(self.a)

    def split(self, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each live record's group parts by this bit; training records left and right of that)"""
        before = _sums((zero if self.perm is None else zero.take(self.perm)).view(np.int8))
        m = before.take(self.b)
        m -= before.take(self.a)
        m = self.a + m
        left = self.sums.take(m)
        right = self.sums.take(self.b)
        right -= left
        left -= self.sums.take(self.a)
        return m, left, right

    def move(self, bit: np.ndarray, m: np.ndarray, keep: np.ndarray) -> None:
        """Live records go to their part of their group, and those of keep stay live."""
        if len(keep) < len(m):
            bit, m = bit.take(keep), m.take(keep)
            self.keep(keep)
        self.a, self.b = _either(bit, m, self.a), _either(bit, self.b, m)

    def keep(self, keep: np.ndarray) -> None:
        self.a, self.b = self.a.take(keep), self.b.take(keep)

    def shrink(self, keep: np.ndarray, train: np.ndarray) -> None:
        """Only the records of keep stay, among them whole groups of those that are live. train: of those that stay"""
        at = keep if self.perm is None else keep.take(self.perm)
        place = _sums(at.view(np.int8))
        self.a, self.b = place.take(self.a).astype(np.int64), place.take(self.b).astype(np.int64)
        if self.perm is not None:
            self.perm = _sums(keep.view(np.int8)).take(self.perm[at]).astype(np.int64)
        self.sums = _sums(train if self.perm is None else train.take(self.perm))


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=out[1:], dtype=np.int32)
    return out


def _either(bit: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Whole numbers by a bit; np.where takes six times as long where bits are random."""
    return zero + (one - zero) * bit


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _costs(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretched share of the right side of each node; bits that either side costs, by node and side)"""
    return _stretch(right), -np.log2(np.stack([1 - right, right], 1)).ravel()


def mixed(mixer: Mixer, lengths: np.ndarray, right: np.ndarray, new: np.ndarray, second: np.ndarray, word: np.ndarray, train: np.ndarray, costs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Bits that the contexts add to what order 0 costs, for records sorted by context and code word.

    new: where a context begins; second: the token before it, hashed; train: counts in training; costs: _costs(right), made
    once. All bits at one depth are one online step.
    """
    stretched, paid = costs or _costs(right)
    n = len(word)
    out = np.zeros(n)
    group = np.cumsum(new) - 1
    pairs = np.sort((group.astype(np.uint64) << np.uint64(44)) | (second.astype(np.uint64) << np.uint64(28)) | np.arange(n, dtype=np.uint64))
    perm = (pairs & np.uint64((1 << 28) - 1)).astype(np.int64)
    pairs >>= np.uint64(28)
    train = train.astype(np.int32)
    one, two = Side(None, new, train), Side(perm, np.r_[True, pairs[1:] != pairs[:-1]], train)
    # Of the live records: their places, words, counts in training and the bits of their words; j: which of them two has.
    size = lengths[word >> np.uint32(32 - MOST_BITS)]
    go = (one.seen() - train > 0) & (size > 0)
    at = np.flatnonzero(go)
    j = np.flatnonzero(go & (two.seen() - train > 0))
    one.keep(at)
    two.keep(j)
    j, mine, own, size = _sums(go.view(np.int8)).take(j).astype(np.int64), word.take(at), train.take(at), size.take(at)
    for d in range(DEPTH):
        if not len(at):
            break
        if 2 * len(at) < len(word):
            ends = [np.bincount(x, minlength=len(word) + 1)[:-1] for x in (one.a, one.b)]
            keep = np.cumsum(ends[0] - ends[1]) > 0
            word, train = word[keep], train[keep]
            one.shrink(keep, train)
            two.shrink(keep, train)
        zero = (word >> np.uint32(DEPTH - 1 - d) & np.uint32(1)) == 0
        bit = (mine >> np.uint32(DEPTH - 1 - d) & np.uint32(1)) != 0
        m, left, right_ = one.split(zero)
        ones = own * bit
        right_ -= ones
        left -= own - ones
        seen1 = left + right_
        node = ((1 << d) | (mine >> np.uint32(DEPTH - d)).astype(np.int64)) if 0 < d <= MOST_BITS else np.full(len(at), 1)
        p0 = right.take(node) if d <= MOST_BITS else np.full(len(at), 0.5, np.float32)
        base = (stretched.take(node), paid.take(2 * node + bit)) if d <= MOST_BITS else (np.zeros(len(at), np.float32), np.float32(1))
        p1 = (right_.astype(np.float32) + np.float32(PRIOR[0]) * p0) / (seen1.astype(np.float32) + np.float32(PRIOR[0]))
        go = (_either(bit, right_, left) > 0) & (size > d + 1)
        p2, seen2 = p1.copy(), np.zeros(len(at), np.int32)
        if len(j):
            bit2, ones = bit.take(j), ones.take(j)
            m2, left2, right2 = two.split(zero)
            right2 -= ones
            left2 -= own.take(j) - ones
            both = left2 + right2
            seen2[j] = both
            p2[j] = (right2.astype(np.float32) + np.float32(PRIOR[1]) * p1.take(j)) / (both.astype(np.float32) + np.float32(PRIOR[1]))
            keep = np.flatnonzero((_either(bit2, right2, left2) > 0) & go.take(j))
            two.move(bit2, m2, keep)
            j = j.take(keep)
        stay = np.flatnonzero(go)
        one.move(bit, m, stay)
        gate = TRUST.take(np.minimum(seen1, 31)).astype(np.int64) * 5 + TRUST.take(np.minimum(seen2, 31))
        p1, p2 = (np.clip(p, 1e-6, 1 - 1e-6) for p in (p1, p2))
        cost = mixer.cost([base[0], _stretch(p1), _stretch(p2)], gate, bit, own.astype(np.float32))
        out[at] += cost - base[1]
        if len(stay) < len(at):
            at, mine, own, size = (x.take(stay) for x in (at, mine, own, size))
            j = _sums(go.view(np.int8)).take(j).astype(np.int64)
    return out


def mix_contexts(vocabulary: Vocabulary) -> Callable:
    """Occurrences of a bucket to the bits that contexts add, summed by document, for their blocks. What blocks know of
    their documents passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, right = vocabulary.tables()
        costs = _costs(right)
        for bucket, rows in by_bucket(batches):
            yield batch_of([(-1 - k, -1, d) for k, d in rows if k < 0])
            rows = sorted((k, d) for k, d in rows if k >= 0)
            if not rows:
                continue
            docs, contexts, seconds, words, places = [], [], [], [], []
            for _, data in rows:
                r = Reader(data)
                d, c, m = r.number(), r.number(), r.number()
                step, size = r.take(c, "<u4"), r.take(c, "<u4")
                contexts.append(np.repeat(np.cumsum(step, dtype=np.uint32), size))
                seconds.append(r.take(m, "<u2"))
                words.append(r.take(m, "<u4"))
                places.append(r.take(m, "<u4"))
                docs.append(d)
            rows = [k for k, _ in rows]
            first = np.repeat((np.cumsum(docs) - docs).astype(np.int32), [len(x) for x in words])
            context, second, word, place = (np.concatenate(x) for x in (contexts, seconds, words, places))
            del contexts, seconds, words, places
            order = np.argsort((context.astype(np.uint64) << np.uint64(32)) | word, kind="stable")
            context, second, word, place, first = context[order], second[order], word[order], place[order], first[order]
            del order
            train = place >> np.uint32(31) == 0
            target = first + (place & np.uint32(0x7FFFFFFF)).astype(np.int32)
            del place, first
            new = np.r_[True, context[1:] != context[:-1]]
            head = np.flatnonzero(new)
            cuts = np.append(head[np.flatnonzero(np.diff(head // CHUNK, prepend=-1))], len(word))
            mixer, out = Mixer(3, np.array([0.0, 0.1, 0.9]), GATES), np.zeros(int(sum(docs)))
            for x, y in zip(cuts[:-1], cuts[1:]):
                out += np.bincount(target[x:y], mixed(mixer, lengths, right, new[x:y], second[x:y], word[x:y], train[x:y], costs), len(out))
            for block, part in zip(rows, np.split(out, np.cumsum(docs)[:-1])):
                yield batch_of([(block, bucket, part.astype("<f4").tobytes())])

    return run


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What blocks know of their documents, and the sums from all buckets, to rows."""
    for _, rows in by_bucket(batches):
        (_, table), *sums = sorted(rows)
        r = Reader(table)
        n = r.number()
        ids, null, held, tokens, known, base, cost, size = (r.take(n, k) for k in ("<i8", "u1", "u1", "<i8", "<i8", "<f8", "<f8", "<i8"))
        cost = cost + sum((np.frombuffer(d, "<f4").astype(np.float64) for _, d in sums), np.zeros(n))
        columns = [pa.array(ids, mask=null > 0), pa.array(held > 0), pa.array(tokens), pa.array(known), pa.array(base), pa.array(-cost * math.log10(2)), pa.array(size)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def score(docs: DataFrame, block_bytes: int = 1 << 23) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of (doc_id, text).

    Blocks and buckets of contexts are as many as ``block_bytes`` go into all texts, buckets of tokens an eighth. The driver
    holds counts by class and at most FREQUENT tokens, which go out with the code; everything that grows is dealt.
    Null and empty texts are the end alone; a null id is in training. Rows that repeat an id are texts of their own. Without a
    training document all tokens are spelled. No rows: no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), whole().cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    buckets = -(-n // 8)
    block = F.pmod(F.xxhash64(F.coalesce("doc", F.xxhash64("text"))), F.lit(n)).cast("int")
    theirs = texts.select(block.alias("bucket"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("data"), "doc", "text")
    gather = lambda df, m: df.repartitionById(m, F.pmod("bucket", F.lit(m)).cast("int")).sortWithinPartitions("bucket")
    rows = lambda df: df.select("bucket", "kind", "data")

    replies = written(gather(gather(theirs, n).mapInArrow(ask(buckets), ROWS), buckets).mapInArrow(number(buckets), ROWS))
    stats = [np.frombuffer(r.data, np.int64).reshape(3, CLASSES) for r in replies.filter("kind = -1").mapInArrow(totals, ROWS).collect()] or [np.zeros((3, CLASSES), np.int64)]
    stats = np.stack([sum(x[0] for x in stats), sum(x[1] for x in stats), np.max([x[2] for x in stats], axis=0)])
    often = replies.filter("kind = -2").select("data").orderBy(F.col("data").desc()).limit(FREQUENT).collect()
    vocabulary = Vocabulary.of(stats, [struct.unpack(">QQ", r.data) for r in often], buckets)
    blank = [F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("text")]
    both = replies.filter("kind >= 0").select("bucket", "kind", "data", *blank).unionByName(theirs)
    sums = written(gather(gather(both, n).mapInArrow(send(n, buckets, vocabulary), ROWS), n).mapInArrow(mix_contexts(vocabulary), ROWS))
    discard(replies)
    scored = gather(rows(sums), n).mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
