"""Rows of packed arrays: many small records travel as few rows (bucket, kind, data), sorted by bucket after the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS = "bucket int, kind int, data binary"
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def home(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of documents: pmod(xxhash64(doc), n) as Spark has it (XXH64 of eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (np.uint64(50) + p5) ^ (turn(np.ascontiguousarray(doc, np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return ((h ^ (h >> np.uint64(32))).view(np.int64) % n).astype(np.int32)


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, [(kind, data)]) of rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append((k, d))
    if held:
        yield now, held


def tuples(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows, of which few are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, step).columns))


def with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Iterator[tuple[int, int, bytes]]]]:
    """(bucket, rows before the texts, texts) of rows (bucket, kind, data, doc, tag, text) sorted by bucket and kind."""

    def flat():
        yield from tuples(batches)

    rows, ahead = flat(), None
    ahead = next(rows, None)
    while ahead is not None:
        bucket, held = ahead[0], []
        while ahead is not None and ahead[0] == bucket and ahead[5] is None:
            held.append((ahead[1], ahead[2]))
            ahead = next(rows, None)

        def texts(bucket=bucket):
            nonlocal ahead
            while ahead is not None and ahead[0] == bucket:
                yield ahead[3], ahead[4], ahead[5]
                ahead = next(rows, None)

        mine = texts()
        yield bucket, held, mine
        for _ in mine:
            pass
