"""The k best items of each query by sums of products over shared terms: exact, with bounds that leave out what can't be among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are ranked by 6 decimals, so what lies this close below a bound may still tie with it.
MARGIN = 2e-6
#: Rows and postings of items that are compared at once, and rows of the first block of items where no bound is known.
ROWS, POSTINGS, FIRST = 1 << 16, 2 << 20, 1 << 10
#: So few candidates of a query are scored in full at once; to find one in a term's rows costs as much as to add so many of them.
FULL, LOOKUP = 8, 8
#: Terms of a block that are held as a matrix, queries that are multiplied with it at once, and what a row of a term that names
#: candidates costs, with all that follows, against one that is only added.
DENSE, GROUP, MORE = 64, 64, 2
#: Rows of a batch that is given out.
OUT = 1 << 16

Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Wanted:
    """Queries as places of terms in a vocabulary, with positive weights: those of query q from start[q] to start[q + 1]."""

    def __init__(self, ids: pa.Array, start: np.ndarray, terms: pa.Array, weight: np.ndarray):
        self.ids, self.start, self.weight = ids, start.astype(np.int64), weight.astype(np.float64)
        self.vocabulary = pc.unique(terms)
        self.term = pc.index_in(terms, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int32)
        self.norm = np.sqrt(np.add.reduceat(self.weight**2, self.start[:-1])) if len(ids) else np.empty(0)

    def postings(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each row; rows, terms and counts of the vocabulary's terms in them, by row and term)"""
        length, size = np.diff(tokens.offsets.to_numpy()), max(1, len(self.vocabulary))
        at = pc.index_in(tokens.flatten(), self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.repeat(np.arange(len(tokens), dtype=np.int64), length) * size + at
        key, n = np.unique(key[at >= 0], return_counts=True)
        return length, (key // size).astype(np.int32), (key % size).astype(np.int32), n


class Block:
    """n rows by their postings, sorted by row and term. The rows of the most frequent terms are held as a matrix too."""

    def __init__(self, wanted: Wanted, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.wanted, self.n, self.term, self.weight = wanted, n, term, weight
        self.ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
        order = np.argsort(term, kind="stable")
        self.rows, self.x, self.count = row[order], weight[order], np.bincount(term, minlength=len(wanted.vocabulary))
        self.first, has, peak = np.append(0, np.cumsum(self.count)), np.flatnonzero(self.count), np.zeros(len(self.count))
        if len(has):
            peak[has] = np.maximum.reduceat(self.x, self.first[has])
        #: The most that each query's terms, and all of them, add to a row.
        self.bound = wanted.weight * peak[wanted.term]
        norm = np.sqrt(np.bincount(row, weight**2).max()) if len(has) else 0.0
        self.most = np.minimum(np.add.reduceat(self.bound, wanted.start[:-1]), wanted.norm * norm) if len(wanted.ids) else np.empty(0)
        often = np.argsort(-self.count, kind="stable")[:DENSE]
        often = often[self.count[often] > n // 64]
        self.place = np.full(len(self.count), -1)
        self.place[often] = np.arange(len(often))
        self.dense, at = np.zeros((len(often), n), np.float32), self.place[term]
        self.dense[at[at >= 0], row[at >= 0]] = weight[at >= 0]
        self.single, self.scratch = self.x.astype(np.float32), np.zeros(len(self.count))

    def sums(self, queries: list[int]) -> Iterator[tuple[int, np.ndarray, float]]:
        """(query, each row's score in single precision, how far that may be off)"""
        w = self.wanted
        factors = np.zeros((len(queries), len(self.dense)), np.float32)
        rest = []
        for i, q in enumerate(queries):
            t, f = (y[w.start[q] : w.start[q + 1]] for y in (w.term, w.weight))
            at = self.place[t]
            factors[i, at[at >= 0]] = f[at >= 0]
            t, f = t[at < 0], f[at < 0].astype(np.float32)
            rest.append(zip(self.first[t].tolist(), self.first[t + 1].tolist(), f))
        for q, acc, terms in zip(queries, factors @ self.dense, rest):
            for lo, hi, y in terms:
                if lo < hi:
                    acc[self.rows[lo:hi]] += y * self.single[lo:hi]
            yield q, acc, (w.start[q + 1] - w.start[q] + 8) * 2.0**-22 * self.most[q]

    def scores(self, q: int, c: np.ndarray) -> np.ndarray:
        """The scores of rows c, summed in the order of the terms, so equal rows have equal ones."""
        w = self.wanted
        t, f = (y[w.start[q] : w.start[q + 1]] for y in (w.term, w.weight))
        size = self.ends[c + 1] - self.ends[c]
        at = np.repeat(self.ends[c] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        self.scratch[t] = f
        s = np.bincount(np.repeat(np.arange(len(c)), size), self.scratch[self.term[at]] * self.weight[at], minlength=len(c))
        self.scratch[t] = 0
        return s


class Search:
    """Blocks of items against all queries. least: for each query a score that k items are known to reach, 0 if there is none."""

    def __init__(self, wanted: Wanted, k: int, least: np.ndarray | None = None):
        self.wanted, self.k = wanted, k
        self.least = np.zeros(len(wanted.ids)) if least is None else least.copy()

    def block(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, place: Callable[[], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores) of what may be among the k best, of n rows by their postings, sorted by row and term.

        A term adds at most its greatest weight in the block. Those terms that together stay below the query's bound name no
        candidates: only rows with one of the others are looked at, and of the rest only what the candidates have. Where those
        others have so many rows that it is less work, all rows are summed up, with the most frequent terms as a matrix.
        place: gives the order of the rows' ids.
        """
        block, acc = Block(self.wanted, n, row, term, weight), np.zeros(n)
        go = np.flatnonzero((block.most > 0) & (block.most >= self.least - MARGIN))
        for a in range(0, len(go), GROUP):
            many = []
            for q in go[a : a + GROUP]:
                found = self._few(block, q, acc)
                if found is None:
                    many.append(q)
                elif len(found):
                    yield from self._kept(block, q, found, place)
            for q, sums, off in block.sums(many) if many else ():
                c = np.flatnonzero(sums > max(0.0, self.least[q] - MARGIN - off))
                if len(c) > self.k:
                    s = sums[c]
                    c = c[s >= np.partition(s, -self.k)[-self.k] - 2 * off - MARGIN]
                if len(c):
                    yield from self._kept(block, q, c, place)

    def _few(self, block: Block, q: int, acc: np.ndarray) -> np.ndarray | None:
        """Rows that may reach the query's bound, None where all rows had better be summed up. acc: zeros, and again at the end."""
        w, bar, (a, b) = self.wanted, max(0.0, self.least[q] - MARGIN), self.wanted.start[q : q + 2]
        by = np.argsort(block.bound[a:b])
        sums, t, f = np.cumsum(block.bound[a:b][by]), w.term[a:b][by], w.weight[a:b][by]
        i, n = int(np.searchsorted(sums, bar)), block.count[t]
        if MORE * n[i:].sum() > block.n // 2 + n[block.place[t] < 0].sum():
            return None
        first, r, x = block.first, block.rows, block.x
        for j in range(i, len(t)):
            lo, hi = first[t[j]], first[t[j] + 1]
            acc[r[lo:hi]] += f[j] * x[lo:hi]
        c = np.flatnonzero(acc > (bar - sums[i - 1] if i else bar))
        while i and len(c) > FULL:
            # Of the next term, either all its rows or those of the candidates, whichever is less to look at.
            i -= 1
            lo, hi = first[t[i]], first[t[i] + 1]
            if hi - lo < LOOKUP * len(c):
                acc[r[lo:hi]] += f[i] * x[lo:hi]
            else:
                at = np.searchsorted(r[lo:hi], c.astype(r.dtype))
                at[at == hi - lo] = 0
                mine = np.flatnonzero(r[lo:hi][at] == c)
                acc[c[mine]] += f[i] * x[lo:hi][at[mine]]
            c = c[acc[c] > (bar - sums[i - 1] if i else bar)]
        if i == 0 and len(c) > self.k:
            s = acc[c]
            c = c[s >= np.partition(s, -self.k)[-self.k] - MARGIN]
        acc.fill(0)
        return c

    def _kept(self, block: Block, q: int, c: np.ndarray, place: Callable[[], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        k, s = self.k, block.scores(q, c)
        keep = s > max(0.0, self.least[q] - MARGIN)
        if len(s) >= k:
            kth = np.partition(s, -k)[-k]
            self.least[q] = max(self.least[q], kth)
            keep &= s >= kth - MARGIN
        c, s = c[keep], s[keep]
        if len(c) > 2 * k:  # ties: of equal scores only the k first ids count
            by = np.lexsort((place()[c], s))
            c, s = c[by], s[by]
            begins = np.flatnonzero(np.diff(s, prepend=-1.0))
            keep = np.arange(len(s)) - np.repeat(begins, np.diff(np.append(begins, len(s)))) < k
            c, s = c[keep], s[keep]
        yield int(q), c, s


def blocks(batches: Iterator[pa.RecordBatch], wanted: Wanted, weigh: Weigh, stepped: bool) -> Iterator[tuple]:
    """(items, n, rows, terms, weights) of batches (item, tokens), many of them together. stepped: rows of great norm first, in
    blocks that grow, as such rows give high bounds and the others low greatest weights."""
    held: list[tuple] = []
    rows = postings = 0

    def out() -> Iterator[tuple]:
        items = pa.chunked_array([x[0] for x in held]).combine_chunks()
        at = np.append(0, np.cumsum([len(x[0]) for x in held]))
        row = np.concatenate([x[1] + np.int32(a) for x, a in zip(held, at)])
        term, weight = (np.concatenate([x[i] for x in held]) for i in (2, 3))
        if not stepped:
            yield items, len(items), row, term, weight
            return
        norm = np.bincount(row, weight**2, minlength=len(items))
        order = np.argsort(-norm, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        by = np.argsort(place[row], kind="stable")
        row, term, weight = place[row][by], term[by], weight[by]
        a, size = 0, FIRST
        while a < len(items) and norm[order[a]] > 0:
            b = min(len(items), a + size)
            lo, hi = np.searchsorted(row, (a, b))
            yield items.take(pa.array(order[a:b])), b - a, row[lo:hi] - np.int32(a), term[lo:hi], weight[lo:hi]
            a, size = b, size * 4

    for batch in batches:
        for a in range(0, batch.num_rows, ROWS // 4):
            part = batch.slice(a, ROWS // 4)
            length, row, term, n = wanted.postings(part.column(1))
            held.append((part.column(0), row, term, weigh(n, term, length[row])))
            rows, postings = rows + part.num_rows, postings + len(row)
            if rows >= ROWS or postings >= POSTINGS:
                yield from out()
                held, rows, postings = [], 0, 0
    if held:
        yield from out()


def _placed(items: pa.Array) -> Callable[[], np.ndarray]:
    made = []

    def place() -> np.ndarray:
        if not made:
            made.append(np.empty(len(items), np.int64))
            made[0][pc.array_sort_indices(items).to_numpy()] = np.arange(len(items))
        return made[0]

    return place


def best(batches: Iterator[pa.RecordBatch], wanted: Wanted, k: int, weigh: Weigh, least: np.ndarray | None, stepped: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, item_id, score) of what may be among the k best of each query."""
    search = Search(wanted, k, least)
    for items, n, row, term, weight in blocks(batches, wanted, weigh, stepped):
        found, size = [], 0

        def out(found: list, items=items) -> pa.RecordBatch:
            q = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
            return pa.RecordBatch.from_arrays([wanted.ids.take(pa.array(q)), items.take(pa.array(np.concatenate([x[1] for x in found]))), pa.array(np.concatenate([x[2] for x in found]))], ["query_id", "item_id", "score"])

        for x in search.block(n, row, term, weight, _placed(items)):
            found.append(x)
            size += len(x[1])
            if size >= OUT:
                yield out(found)
                found, size = [], 0
        if found:
            yield out(found)


def bounds(batches: Iterator[pa.RecordBatch], wanted: Wanted, k: int, weigh: Weigh) -> Iterator[pa.RecordBatch]:
    """(place, best): what the k best of the items at hand reach at least, for each query by its place."""
    least, top = np.zeros(len(wanted.ids)), {}
    for _, n, row, term, weight in blocks(batches, wanted, weigh, False):
        block = Block(wanted, n, row, term, weight)
        go = np.flatnonzero(block.most > least)
        for a in range(0, len(go), GROUP):
            for q, s, off in block.sums(go[a : a + GROUP]):
                s = s[s > least[q] + off].astype(np.float64) - off
                mine = np.append(top.get(q, ()), np.partition(s, -k)[-k:] if len(s) > k else s)
                top[q] = mine = np.partition(mine, -k)[-k:] if len(mine) > k else mine
                if len(mine) == k:
                    least[q] = mine.min()
    places = sorted(top)
    for a in range(0, len(places), 1024):
        part = places[a : a + 1024]
        ends = np.append(0, np.cumsum([len(top[q]) for q in part])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([top[q] for q in part])))], ["place", "best"])


def reached(batches: Iterator[pa.RecordBatch], wanted: Wanted, weigh: Weigh) -> Iterator[pa.RecordBatch]:
    """(place, score) of batches (item, tokens, query_id): what each row has of the query that it names."""
    for batch in batches:
        length, row, term, n = wanted.postings(batch.column(1))
        place = pc.index_in(batch.column(2).cast(wanted.ids.type), wanted.ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        # Places of (query, term) pairs, which are sorted by query, in order of both.
        size = len(wanted.vocabulary)
        pairs = np.repeat(np.arange(len(wanted.ids)), np.diff(wanted.start)) * size + wanted.term
        order = np.argsort(pairs)
        key = place[row] * size + term
        at = np.minimum(np.searchsorted(pairs[order], key), len(order) - 1)
        share = np.where((pairs[order][at] == key) & (place[row] >= 0), wanted.weight[order][at], 0.0)
        score = np.bincount(row, share * weigh(n, term, length[row]), minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(place[place >= 0]), pa.array(score[place >= 0])], ["place", "score"])
