"""SimHash near-dedup with Golay-code fuzzy keys: fingerprints within a few bits of each other, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole, written
from .components import stars

SHINGLE, SEED, RADIUS = 4, 42, 4
#: The segments of a fingerprint (first bit, bits); the last is filled up with zeros to the code's length.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the perfect binary Golay code of length 23, dimension 12, distance 7.
GENERATOR = 0b101011100011
#: Shingles whose bits are counted at once, and fingerprints of a bucket compared at once.
AT_ONCE, WIDE = 1 << 18, 1 << 16


def _syndromes(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return v


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the errors that lead to the codewords within distance 4: one of weight 3 or less; where it has
    weight 3, five more of weight 4. And how many there are."""
    table, n = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for weight in range(4):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.uint32)
        s = _syndromes(errors)
        table[s, 0], n[s] = errors, 6 if weight == 3 else 1
    errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), 4)], np.uint32)
    s = _syndromes(errors)
    order = np.argsort(s, kind="stable")
    s, errors = s[order], errors[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    mine = n[s] == 6
    table[s[mine], place[mine] + 1] = errors[mine]
    return table, n


class Keys:
    """Keys such that any two fingerprints at most RADIUS = 4 bits apart have one in common.

    Two vectors at distance 2 or less have a codeword within distance 4 of both: the one nearest to a vector between them
    (the code is perfect: 3 errors always decode). So with at most 2 errors in each segment, a triple of codewords agrees.
    Else one segment has 3 errors or more, the other two have one at most: one of these is equal, the other one's
    codewords agree. Codewords are named by their 12 information bits.
    """

    def __init__(self):
        self.errors, self.n = _patterns()

    def _codewords(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = _syndromes(segment)
        return ((segment[:, None] ^ self.errors[s]) >> 11).astype(np.uint64), np.arange(6)[None, :] < self.n[s][:, None]

    def __call__(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, row of prints), in parts."""
        segments = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
        words, there = zip(*map(self._codewords, segments))
        spread = lambda x: [y.reshape(len(prints), *(6 if i == k else 1 for i in range(3))) for k, y in enumerate(x)]
        (a, b, c), (in_a, in_b, in_c) = spread(words), spread(there)
        fit = in_a & in_b & in_c
        keys = (a << np.uint64(24)) | (b << np.uint64(12)) | c
        yield keys[fit], np.nonzero(fit)[0]
        for kind, (x, y) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], 1):
            keys = (np.uint64(kind) << np.uint64(40)) | (segments[x].astype(np.uint64)[:, None] << np.uint64(12)) | words[y]
            yield keys[there[y]], np.nonzero(there[y])[0]


def fingerprint(words: list[bytes]) -> int:
    import xxhash

    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    hashed, n, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[i : i + AT_ONCE], ends[i : i + AT_ONCE])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, print, also) of documents (doc_id, text): the majority of each bit over the XXH64 of all 4-word shingles."""
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"), F.struct(*also, F.lit(0).alias("none_")).alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.encode().lower().split()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], ["doc_id", "print", "carried"])

    made = rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("print"), "carried").schema)
    return made.select("doc_id", "print", *[F.col("carried")[c].alias(c) for c in also])


def _small(prints: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all buckets of one small size: each member with the first of its component in the bucket."""
    p = prints[starts[:, None] + np.arange(size)]
    near = np.bitwise_count(p[:, :, None] ^ p[:, None, :]) <= RADIUS
    label = np.broadcast_to(np.arange(size), p.shape).copy()
    while True:
        least = np.where(near, label[:, None, :], size).min(axis=2)
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(size)
    return p[moved], np.take_along_axis(p, label, 1)[moved]


def _wide(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one large bucket: a search that takes from the unvisited all within reach of the front, in blocks."""
    left, us, vs = np.unique(p), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (WIDE << 4) // len(left))
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), step):
                rest = np.nonzero(~near)[0]
                if not len(rest):
                    break
                near[rest] = (np.bitwise_count(front[i : i + step, None] ^ left[rest][None, :]) <= RADIUS).any(axis=0)
            front, left = left[near], left[~near]
            us.append(front)
            vs.append(np.full(len(front), root))
    return (np.concatenate(us), np.concatenate(vs)) if us else (p[:0], p[:0])


def bucket_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that connect what is linked within each bucket of sorted keys, one less than its members at most."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    found = [_small(prints, at, size) for size in range(2, 17) if len(at := starts[sizes == size])]
    found += [_wide(prints[s : s + n]) for s, n in zip(starts[sizes > 16], sizes[sizes > 16])]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (prints[:0], prints[:0])


def links(prints: DataFrame) -> DataFrame:
    """(u, v): verified links that span the components of the distinct fingerprints (print) under distance 4 or less.

    A bucket holds distinct fingerprints only, eight bytes each, and is searched block by block: from n members come n - 1
    links at most and never all pairs, and a dense bucket costs little more than its size, as the search drops what it has
    reached.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys()
        for batch in batches:
            p = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(p), 4096):
                for k, row in keys(p[i : i + 4096]):
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(p[i : i + 4096][row].view(np.int64))], ["key", "print"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            u, v = bucket_links(keys, p.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            k, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            if k[0] == k[-1]:
                held.append((k, p))
                continue
            last = int(np.searchsorted(k, k[-1]))
            held.append((k[:last], p[:last]))
            yield out(*map(np.concatenate, zip(*held)))
            held = [(k[last:], p[last:])]
        if held:
            yield out(*map(np.concatenate, zip(*held)))

    dealt = prints.mapInArrow(emit, "key long, print long").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "u long, v long").distinct()


def near_groups(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, print, component_id, root) of documents (doc_id, text): component_id is the smallest doc_id reachable by
    links, root a fingerprint that names the component; ``also`` names columns to carry.

    Equal fingerprints are one node before any key is made, so exact copies cost one row. Null and empty texts have the
    fingerprint zero, linked like any other; a null id is never the smallest unless all of its component are null; rows
    that repeat an id each come out. No rows give no rows.
    """
    prints = written(fingerprints(docs, *also))
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = stars(links(nodes.select("print")))
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(least, "root").select("print", "component_id", "root"))
    return prints.join(classes, "print").select("doc_id", "print", "component_id", "root", *also)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
