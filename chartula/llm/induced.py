"""Suffix arrays by induced sorting, in numpy: whole buckets are induced at once instead of suffix by suffix."""

from __future__ import annotations

import numpy as np

#: Symbols that a text's bytes are shifted by, the end and the separator of texts.
SHIFT, END, SEPARATOR = 1, 0, 300


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S); t ends in the only END."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))  # of equal neighbours the type is that of the next unequal pair
    at = np.where(step != 0, np.arange(n - 1), n - 2)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[nxt] > 0, True)


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the substrings from each leftmost-smaller place to the next, ties at most where they exceed ``depth``.

    Each symbol is compared with its type after it, nine bits and one, six to a key: no substring is a prefix of another.
    """
    if not len(lms):
        return np.empty(0, np.int64)
    length = np.minimum(np.append(lms[1:], len(t) - 1) - lms + 1, depth)
    longest = int(length.max())
    six = np.zeros(len(t) + longest + 6, np.uint64)
    six[: len(t)] = (t.astype(np.uint64) << np.uint64(1)) | small
    one = six.copy()
    for _ in range(5):  # the six symbols from each place on
        one = np.append(one[1:], np.uint64(0))
        six <<= np.uint64(10)
        six |= one
    mask = np.array([~((1 << 10 * (6 - i)) - 1) & (1 << 60) - 1 for i in range(7)], np.uint64)
    # A name is the place of the first of its like in order. Substrings with one key end in it all, or go on all.
    names, mine = np.zeros(len(lms), np.int64), np.arange(len(lms))
    for at in range(0, longest, 6):
        if at:
            mine = mine.take(np.flatnonzero(length.take(mine) > at))
        key = six.take(lms.take(mine) + at) & mask.take(np.minimum(length.take(mine) - at, 6))
        order = np.argsort(key, kind="stable") if not at else np.lexsort((key, names.take(mine)))
        mine, key = mine.take(order), key.take(order)
        old = names.take(mine)
        fresh = np.r_[True, old[1:] != old[:-1]]
        head = np.flatnonzero(fresh)
        new = np.flatnonzero(fresh | np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(head, np.diff(np.append(head, len(mine))))
        names[mine] = old + np.repeat(new, np.diff(np.append(new, len(mine)))) - group
    used = np.zeros(len(lms), bool)
    used[names] = True
    return (np.cumsum(used) - 1).take(names)


def sorted_lms(t: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The leftmost-smaller places in the order of their suffixes' first ``depth`` symbols.

    The reduced string of names is sorted by naming pairs of names, pairs of pairs, and so on until all names differ or
    cover ``depth`` symbols (a substring covers at least two).
    """
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, reach = _names(t, small, lms, depth), 1
    while len(lms) and names.max() + 1 < len(lms) and 2 * reach < depth:
        after = np.zeros(len(lms), np.int64)
        after[:-reach] = names[reach:] + 1
        pair = names * (len(lms) + 1) + after
        names = np.unique(pair, return_inverse=True)[1].reshape(-1)
        reach *= 2
    return lms[np.argsort(names)]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (shifted symbols, ending in the only END) by at least their first ``depth`` symbols.

    Larger suffixes are induced from the left, bucket by bucket: those of a bucket push the suffixes one place before them
    to the heads of their buckets, in rounds while a bucket pushes into itself. Smaller ones follow from the right.
    """
    n, t = len(t), t.astype(np.int32)
    symbols = t.astype(np.uint16)  # sixteen bits are sorted by radix
    small = types(t)
    sizes = np.bincount(t, minlength=SEPARATOR + 1)
    tops = np.cumsum(sizes)
    starts = tops - sizes
    sa = np.full(n, -1, np.int32)
    lms = sorted_lms(t, small, depth)
    of = symbols[lms]
    n_lms = np.bincount(of, minlength=len(sizes))
    order = np.argsort(of, kind="stable")
    lms_by = np.split(lms[order], np.cumsum(n_lms)[:-1])
    heads = starts.copy()

    def before(found: np.ndarray, smaller: bool) -> np.ndarray:
        found = found[found > 0] - 1
        return found[small[found] == smaller]

    def push_large(found: np.ndarray) -> None:
        p = before(found, False)
        if len(p):
            c = symbols[p]
            o = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=len(sizes))
            sa[heads[c[o]] + np.arange(len(p)) - (np.cumsum(counts) - counts)[c[o]]] = p[o]
            heads[:] += counts

    used = np.flatnonzero(sizes)
    for c in used:
        at = starts[c]
        while at < heads[c]:
            at, found = heads[c], sa[at : heads[c]]
            push_large(found)
        push_large(lms_by[c])
    large_ends, tails = heads.copy(), tops.copy()
    # What the first pass put nowhere near its place, the leftmost-smaller ones, comes out of the second pass by itself.

    def push_small(found: np.ndarray) -> None:
        """found: in falling order."""
        p = before(found, True)
        if len(p):
            c = symbols[p]
            o = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=len(sizes))
            sa[tails[c[o]] - 1 - (np.arange(len(p)) - (np.cumsum(counts) - counts)[c[o]])] = p[o]
            tails[:] -= counts

    sa[0] = n - 1
    tails[END] = 0
    for c in used[::-1]:
        at = tops[c]
        while at > tails[c]:
            at, found = tails[c], sa[tails[c] : at][::-1]
            push_small(found)
        push_small(sa[starts[c] : large_ends[c]][::-1])
    return sa


def common(data: bytes | np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, all or some of them, whether it shares ``length`` bytes (8 or more) with the one before it:
    words of eight bytes are compared, only of those that agreed so far."""
    words = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(length + 16, np.uint8)]).astype(np.uint64)
    for half in (1, 2, 4):  # the eight bytes from each place on
        words = words[:-half] | (words[half:] << np.uint64(8 * half))
    alike = np.zeros(len(sa), bool)
    live = np.arange(1, len(sa))
    for at in [length - 8, *range(0, length - 8, 8)]:  # the last first: neighbours rather differ there
        live = live.take(np.flatnonzero(words.take(sa.take(live) + at) == words.take(sa.take(live - 1) + at)))
    alike[live] = True
    return alike
