"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing columns and no rows, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from chartula.llm import chaining, content_sort, context_mixing, golay, line_dedup, mixing, packing, quality, sharding, suffix_dedup

BASE = "the quick brown fox jumps over the lazy dog and runs away from every hound it meets on the long road home tonight"
LONG = " ".join(f"w{i % 977}x{i * 7919 % 1013}" for i in range(30_000))
PASSAGE = " ".join(f"pass{i * 31 % 101}age" for i in range(70))
ROWS = [
    (3, BASE, "en", "b"), (3, BASE, "en", "b"), (9, BASE, "en", "a"), (1, None, None, None), (2, "", "en", "a"), (None, BASE, "de", "a"), (None, None, None, "c"),
    (4, BASE.replace("hound", "wolf"), "en", "b"), (5, "  \n\t\n", "en", "b"), (6, LONG, "en", "b"), (7, "Home | About | Contact | Help\n" + "\n".join([BASE + "."] * 3), "en", "c"),
    (8, "ÀÉ é — 日本語 テキスト\x0b\x0c words\r\nmore", "fr", None), (10, "a b c a b c a b c", "en", "z"), (11, "x" * 300, "en", "z"), (12, "x" * 300, "en", "y"),
    (13, "before it all " + PASSAGE + " and after", "en", "z"), (14, "quite another start then " + PASSAGE.replace("pass31age", "other") + " with its own end", "en", "z"),
    (15, BASE.upper() + "\n" + BASE, "en", "q"), (16, "one two", "en", "q"), (17, "ONE  two", "en", "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, salt int, bucket string, text_hash string, h1 string, size string, kept string, print string, x0 int, unit string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "t", "h", "s", "k", "p", 0, "u", "c") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).cache()


def whole(text):
    return text or ""


def key(row):
    return tuple((x is None, str(type(x)), x) if x is None or not isinstance(x, float) else (False, "f", round(x, 6)) for x in row)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", whole(text))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in whole(text))


def late(doc):
    return (doc is None, doc or 0)


def test_content_sort(docs, none):
    got = content_sort.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = defaultdict(list)
    for doc, text, *_ in ROWS:
        groups[whole(text)].append(doc)
    want = []
    for doc, text, *_ in ROWS:
        ids = groups[whole(text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((doc, keep, len(ids), doc == keep, hashlib.sha256(whole(text).encode()).hexdigest()))
    same(got, want)
    assert content_sort.exact_groups(none).count() == 0


def test_line_dedup(docs, none):
    got = line_dedup.dedup_lines(docs).collect()
    first = {}
    lines = [(doc, whole(text).split("\n")) for doc, text, *_ in ROWS]
    norm = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for doc, ls in lines:
        for x in map(norm, ls):
            first[x] = min(first.get(x, (True, 1 << 62)), late(doc))
    want = []
    for doc, ls in lines:
        kept = [x for x in ls if len(norm(x)) < 10 or late(doc) == first[norm(x)]]
        want.append((doc, len(ls), len(ls) - len(kept), "\n".join(kept)))
    same(got, want)
    assert line_dedup.dedup_lines(none).count() == 0


def judged(text, base_failed):
    """(kept, cleaned) by a plain loop over lines."""
    q = quality
    lines = [x for x in text.split("\n") if words(x)]
    furniture = any(f in text.lower() for f in q.FURNITURE)
    menu_like = sum(c in q.MARKS for c in text) >= 3
    clean = []
    for x in lines:
        n, symbols, marks = len(words(x)), sum(c in q.SYMBOL for c in x), sum(c in q.MARKS for c in x)
        fails = symbols > q.MOST_SYMBOLS * n + 1
        fails |= menu_like and marks >= 3 and marks * 40 >= len(x) or len(x) < 60 and re.search(q.MENU, x.lower(), re.ASCII) is not None
        fails |= n >= q.SENTENCE_WORDS and x.rstrip(" \t\n\x0b\x0c\r" + q.CLOSERS)[-1:] not in [*q.TERMINAL]
        fails |= furniture and any(f in x.lower() for f in q.FURNITURE)
        clean += [] if fails else [x]
    chars = lambda t: sum(map(len, words(t)))
    left = sum(map(chars, clean))
    return not base_failed and left >= q.LEAST_KEPT * chars(text), text if left == chars(text) else "\n".join(clean)


def test_quality(docs, none):
    got = {(r.doc_id, r.text): r for r in quality.judge(docs, "text", "salt").collect()}
    for doc, text, *_ in ROWS:
        r, w = got[doc, text], words(text)
        windows = defaultdict(list)
        for i in range(len(w) - 2):
            windows[tuple(w[i : i + 3])].append(i)
        covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
        full = [x for x in whole(text).split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", whole(text))))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(full) - len(set(full)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        kept, cleaned = judged(whole(text), r.base_failed)
        assert (r.kept, r.cleaned) == (kept, cleaned)
    assert "Home |" not in got[7, ROWS[10][1]].cleaned
    assert quality.judge(none).count() == 0


def test_quality_keeps_prose_and_rejects_furniture(spark):
    rng = np.random.default_rng(1)
    prose = "\n".join(" ".join(f"word{x}" for x in rng.integers(0, 5000, 12)).capitalize() + "." for _ in range(12))
    junk = "\n".join(f"Home{i} | News{i} | Shop{i * 5} | Login{i} to{i} site{i}" for i in range(20))
    open_ends = "\n".join(f"a{i} list{i} entry {i} without{i} any{i} end to speak {i * 11} of" for i in range(20))
    df = frame(spark, [(1, prose, "en", "a"), (2, junk, "en", "a"), (3, open_ends, "en", "a")])
    assert {r.doc_id: r.kept for r in quality.judge(df).collect()} == {1: True, 2: False, 3: False}


def test_quality_rules_against_loops(spark):
    rng = np.random.default_rng(3)
    starts = ["Home", "weiter", "Lire la suite", "Nous utilisons des cookies", "A plain line of words that ends.", "One that does not end", "a | b | c | d", "## $$ %% && now", "Er sagte »gut.«", "¿Y qué?", "", "x.", "Tous droits réservés 2020."]
    rows = []
    for i in range(120):
        body = [str(rng.choice(starts)) if rng.random() < 0.5 else " ".join(f"w{x}" for x in rng.integers(0, 500, 9)) + str(rng.choice([".", "", "!)", " |"])) for _ in range(int(rng.integers(1, 30)))]
        rows.append((i, "\n".join(body), "en", "a"))
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        assert (got[i].kept, got[i].cleaned) == judged(text, got[i].base_failed)
    assert 10 < sum(r.kept for r in got.values()) < 110


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).collect()
    size = lambda t: len(whole(t).encode()) + 16
    same([r[:3] for r in got], [(doc, size(text), zlib.crc32(whole(text).encode())) for doc, text, *_ in ROWS])
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none, 4).count() == 0


def test_sharding_runs_no_python_on_executors(spark, monkeypatch):
    """Rows of the driver's go out as Arrow; parallelize() has Python workers pass them on."""
    docs = frame(spark, [(i, f"text {i % 7}" * 9, "en", "a") for i in range(60)]).localCheckpoint()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert sharding.shard(docs, 4).count() == 60
    assert sharding.local(spark, [], "text_hash long, pieces int").collect() == []
    assert [tuple(r) for r in sharding.local(spark, [(-5, 2), (1 << 62, 1)], "text_hash long, pieces int").collect()] == [(-5, 2), (1 << 62, 1)]


def test_sharding_balances_a_hot_source(spark):
    rows = [(i, f"{'x' * (i * 37 % 400)} {i if i % 3 else 'copy'}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = sharding.shard(frame(spark, rows), 10).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 10 and max(sizes) < 1.05 * min(sizes)


def test_sharding_keeps_equal_texts_together(spark):
    """Groups from a few rows to more than a shard: only the last are cut, into as few pieces as fit; sizes stay even."""
    rows = [(i, f"single {i} " + "y" * (i * 53 % 200), "en", f"s{i % 5}") for i in range(3000)]
    for g, n in enumerate((700, 300, 120, 60, 25, 9, 3, 2, 2)):
        rows += [(10_000 + 1000 * g + i, f"group {g} " + "z" * 150, ("en", "de", None)[i % 3], f"s{i % 4}") for i in range(n)]
    got = sharding.shard(frame(spark, rows), 10).collect()
    text = {r[0]: r[1] for r in rows}
    held, sizes, whole_size = defaultdict(set), Counter(), Counter()
    for r in got:
        held[text[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
        whole_size[text[r.doc_id]] += r.size
    share = sum(sizes.values()) / 10
    assert all(len(s) == max(1, math.ceil(whole_size[t] / share)) for t, s in held.items()) and max(map(len, held.values())) > 1
    assert len(got) == len(rows) and max(sizes.values()) < 1.05 * share and min(sizes.values()) > 0.95 * share


def test_sharding_cuts_at_medians(spark):
    """Each cut of a tree leaves the bytes nearest to its goal on the left, of all cuts along that dimension."""
    rng = np.random.default_rng(8)
    rows = [(int(h), int(size), *((int(d) << sharding.TIE) + (int(h) % (1 << sharding.TIE)) for d in ds)) for h, size, ds in zip(rng.integers(1, 1 << 40, 500), rng.integers(20, 900, 500), rng.integers(0, 9, (500, 3)))]
    targets = [float(t) for t in rng.integers(1, 9, 7)]
    root = sharding.grow(spark.createDataFrame(rows, "text_hash long, group_size long, x0 long, x1 long, x2 long"), targets)
    todo, leaves = [(root, rows)], 0
    while todo:
        node, mine = todo.pop()
        assert sum(r[1] for r in mine) == node.size
        if not node.halves:
            leaves += 1
            continue
        half = node.halves[0].last
        goal = node.size * sum(targets[node.first : half]) / sum(targets[node.first : node.last])
        by = sorted((r[2 + node.dim], r[1]) for r in mine)
        sums = np.cumsum([0, *(size for _, size in by)])
        assert abs(node.halves[0].size - goal) <= np.abs(sums - goal).min() + sharding.CLOSE * sum(r[1] for r in rows) / 7 + 1
        assert node.dim == max(range(3), key=lambda i: (((node.box[i][1] >> sharding.TIE) - (node.box[i][0] >> sharding.TIE)) / max(1, (root.box[i][1] >> sharding.TIE) - (root.box[i][0] >> sharding.TIE)), -i))
        todo += [(h, [r for r in mine if (r[2 + node.dim] <= node.cut) == (h is node.halves[0])]) for h in node.halves]
    assert leaves == 7


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(words(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, total = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        left -= over or left
    same([(r.doc_id, r.size, r.source_size, r.target) for r in got], [(doc, len(words(text)), sizes[source], target[source]) for doc, text, _, source in ROWS])
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 2
    same([tuple(r) for r in mixing.mix(docs).collect()], [tuple(r) for r in got])
    assert mixing.mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, " ".join("w" for _ in range(i * 13 % 50 + 1)), "en", f"s{i % 6}" if i % 3 else "hot") for i in range(6000)]
    got = mixing.mix(frame(spark, rows)).selectExpr("source", "size * copies AS t", "target").groupBy("source", "target").sum("t").collect()
    assert all(abs(r[2] - r.target) < 0.1 * r.target for r in got)


def brute_print(text):
    w = lower(text).encode().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Smallest id by distinct fingerprint, over links of 4 bits or fewer."""
    us = sorted({p for _, p in prints})
    root = {u: u for u in us}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, u in enumerate(us):
        for v in us[i + 1 :]:
            if (u ^ v).bit_count() <= 4:
                root[find(u)] = find(v)
    least = defaultdict(list)
    for doc, p in prints:
        least[find(p)].append(doc)
    return {u: min((d for d in least[find(u)] if d is not None), default=None) for u in us}


def test_golay_documents(docs, none):
    got = golay.near_groups(docs).collect()
    prints = [(doc, brute_print(text)) for doc, text, *_ in ROWS]
    of = components(prints)
    same([(r.doc_id, r["print"] & ((1 << 64) - 1), r.component_id) for r in got], [(doc, p, of[p]) for doc, p in prints])
    assert golay.near_groups(none).count() == 0


def test_golay_keys_meet_within_four_bits():
    rng, keys = np.random.default_rng(5), golay.Keys()
    p = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
    q = p.copy()
    for i in range(len(q)):
        at, bits = golay.SEGMENTS[i % 3] if i % 2 else (0, 64)
        for b in rng.choice(bits, i % 5, replace=False):
            q[i] ^= np.uint64(1) << np.uint64(at + b)
    sets = [defaultdict(set), defaultdict(set)]
    for x, out in zip((p, q), sets):
        for k, row in keys(x):
            for a, b in zip(k.tolist(), row.tolist()):
                out[b].add(a)
    assert all(sets[0][i] & sets[1][i] for i in range(len(p)))


def test_golay_links_span_components(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(x) for x in base}
    for x in base:  # chains of drift, and a dense cloud around the first
        y = x
        for _ in range(6 if x != base[0] else 400):
            y = (y if x != base[0] else x) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
            prints.add(int(y))
    rows = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    edges = golay.links(spark.createDataFrame(rows, "print long"))
    got = {r.node: r.root for r in golay.stars(edges).collect()}
    of = components([(p, p) for p in prints])
    signed = lambda p: p - (1 << 64) if p >= 1 << 63 else p
    groups = defaultdict(set)
    for p in prints:
        groups[of[p]].add(got.get(signed(p), signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, length=64).collect()
    want = Counter()
    for doc, text, *_ in ROWS:
        ids = [*t.encode(whole(text), add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, path).count() == 0


def test_packing_is_tight():
    rng, bins = np.random.default_rng(3), packing.Bins(0)
    sizes = sorted(rng.integers(1, 1025, 20_000).tolist(), reverse=True)
    for s in sizes:
        bins.place(s)
    assert bins.next < 1.01 * sum(sizes) / 1024
    few = packing.Bins(0, 100, 4)
    for s in rng.integers(1, 101, 500).tolist():
        few.place(s)
        assert few.n <= 4 and sum(map(len, few.open.values())) == few.n


@pytest.mark.parametrize("text", ["a  b", "a   b", " x", "x ", "\n\n a", "a\n \nb", "it's the 'll", "<|endoftext|> x", "a  b", "日本 語　の x", ""])
def test_encoder_agrees_with_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert packing.encoder(path)([text]) == [np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def cut_bytes(rows):
    first = {}
    texts = [(doc, whole(text).encode()) for doc, text, *_ in rows]
    for doc, t in texts:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], (True, 1 << 62)), late(doc))
    for doc, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < late(doc):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        yield doc, bytearray(c for c, g in zip(t, gone) if not g), len(t), sum(gone), spans


def test_suffix_dedup(docs, none):
    got = [(r.doc_id, bytes(r.text_bytes), *r[2:]) for r in suffix_dedup.dedup_substrings(docs).collect()]
    same(got, [(d, bytes(b), *rest) for d, b, *rest in cut_bytes(ROWS)])
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_suffix_dedup_of_mosaics(spark, monkeypatch):
    rng = np.random.default_rng(8)
    blocks = ["".join(rng.choice(list("abcde é"), 60)) for _ in range(12)] + ["ab" * 200, "q" * 500]
    rows = [(int(i), "".join(b[rng.integers(0, 20) : rng.integers(25, len(b) + 1)] for b in rng.choice(blocks, 8)), "en", "a") for i in rng.permutation(60)]
    got = [(r.doc_id, bytes(r.text_bytes), *r[2:]) for r in suffix_dedup.dedup_substrings(frame(spark, rows)).collect()]
    same(got, [(d, bytes(b), *rest) for d, b, *rest in cut_bytes(rows)])


@pytest.mark.parametrize(("shared", "many", "sorted_"), [(256, 1 << 14, 1 << 23), (3, 1 << 14, 2000), (3, 6, 500), (1, 1, 1)])
def test_suffix_dedup_on_all_paths(spark, monkeypatch, shared, many, sorted_):
    """Spans by first document, pieces by gram, strings one by one, shards in parts: all cut the same bytes."""
    rng = np.random.default_rng(21)
    blocks = ["".join(rng.choice(list("abcdefgh é"), int(rng.integers(40, 300)))) for _ in range(10)]
    rows = [(int(i), "".join(b[int(rng.integers(0, 20)) : int(rng.integers(25, len(b) + 1))] for b in rng.choice(blocks, 5)), "en", "a") for i in range(40)]
    rows += [(50 + i, blocks[3] * 2 + str(i), "en", "a") for i in range(12)] + [(50, "again " + blocks[3], "en", "a"), (None, blocks[3], "en", "a")]
    for name, value in (("SHARED", shared), ("MANY", many), ("SORTED", sorted_)):
        monkeypatch.setattr(suffix_dedup, name, value)
    want = [(d, bytes(b), *rest) for d, b, *rest in cut_bytes(rows)]
    texts = [(suffix_dedup.NO_ID if d is None else d, hash(t) % 65536, t.encode()) for d, t, *_ in rows]

    def step(f, rows, *names):
        kinds = {"bucket": pa.int32(), "kind": pa.int32(), "data": pa.binary(), "doc": pa.int64(), "tag": pa.int32(), "text": pa.binary()}
        batch = pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows), names)] if rows else [pa.array([], kinds[n]) for n in names], list(names))
        return sorted((r for b in f([batch]) for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0] is None, r[0] or 0))

    n = 5
    three, six = ("bucket", "kind", "data"), ("bucket", "kind", "data", "doc", "tag", "text")
    home = lambda d: int(suffix_dedup.home(np.array([d], np.int64), n)[0])
    theirs = [(home(d), 9, None, d, g, t) for d, g, t in texts]
    beside = lambda rows: sorted([(*r, None, None, None) for r in rows] + theirs, key=lambda r: r[:2])
    pieces = step(suffix_dedup.find_pieces(n), texts, "doc", "tag", "text")
    found = step(suffix_dedup.match_pieces(n), pieces, *three)
    sent = step(suffix_dedup.send_pieces(n), beside(found), *six)
    covered = step(suffix_dedup.sort_shards(n), sent, *three)
    got = step(suffix_dedup.cut_texts, beside(covered), *six)
    same(got, want)
    # Without the suffix arrays nothing is found but what equal hot pieces of one bucket tell.
    monkeypatch.setattr(suffix_dedup, "earlier", lambda sent, raw: np.empty(0, suffix_dedup.SENT))
    left = step(suffix_dedup.cut_texts, beside(step(suffix_dedup.sort_shards(n), sent, *three)), *six)
    assert sum(r[3] for r in left) == 0 if shared == 256 else sum(r[3] for r in left) < sum(r[3] for r in got)


def test_suffix_dedup_sends_runs_of_strings():
    """A span's strings that an earlier document has come as few records, whatever their number, and as brute force finds them."""
    rng = np.random.default_rng(6)
    shared = bytes(rng.integers(97, 100, 400).astype(np.uint8))
    texts = [(7, shared), (9, shared[100:390]), (7, bytes(rng.integers(97, 123, 90).astype(np.uint8))), (3, b"z" * 70 + shared[200:260]), (9, b"z" * 120)]
    n = suffix_dedup.LENGTH
    sent = np.array([(d, i, 10 * i, len(x) - n + 1, 0) for i, (d, x) in enumerate(texts)], suffix_dedup.SENT)
    got = suffix_dedup.earlier(sent, b"".join(x for _, x in texts))
    want = {(d, i, 10 * i + k) for i, (d, x) in enumerate(texts) for k in range(len(x) - n + 1) if any(x[k : k + n] in y for e, y in texts if e < d)}
    assert {(int(r["doc"]), int(r["tag"]), int(r["start"]) + k) for r in got for k in range(int(r["size"]))} == want and got["size"].sum() == len(want)
    assert 0 < len(got) <= 4


def test_suffix_array_order():
    from chartula.llm.induced import END, SEPARATOR, suffix_array

    rng = np.random.default_rng(9)
    for n in (1, 2, 30, 300):
        for letters in (2, 3, 250):
            t = rng.integers(1, letters + 1, n)
            t[rng.random(n) < 0.05] = SEPARATOR
            t = [*t.tolist(), END]
            assert suffix_array(np.array(t), len(t) + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_context_mixing(docs, none):
    got = context_mixing.score(docs).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*lower(t).encode().split(), None]
    c = Counter(t for doc, text, *_ in ROWS if not held(doc) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = [(doc, held(doc), len(k := tokens(text)), sum(c[t] > 0 for t in k), n, math.fsum(math.log10((c[t] + 1) / (n + v + 1)) for t in k)) for doc, text, *_ in ROWS]
    same([r[:6] for r in got], want)
    assert all(r.score < 0 and (r.bits_per_byte is None) == (r.n_bytes == 0) for r in got)
    assert context_mixing.score(none).count() == 0


def plain_scores(rows):
    """log10 probabilities of (doc_id, text) rows by loops over dictionaries: code and spelling as the operator has them, each
    bit's counts by its contexts, its prediction and the online steps anew. For tables of one bucket and one chunk."""
    c = context_mixing
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    texts = [(d, [*lower(t).encode().split(), b"\n"]) for d, t in rows]
    count = Counter(t for d, k in texts if not held(d) for t in k)
    grams = c.Grams()
    name = {t: int(c.token_hashes(grams, np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for _, k in texts for t in k}
    tokens = sorted(name, key=name.get)
    kind = lambda n: max(n, 1).bit_length() - 1
    index, number = {}, Counter()
    for t in tokens:
        index[t] = number[kind(count[t])]
        number[kind(count[t])] += 1
    total = sum(count.values())
    stats = np.zeros((3, c.CLASSES), np.int64)
    for t in tokens:
        if count[t]:
            stats[0, kind(count[t])] += 1
            stats[1, kind(count[t])] += count[t]
    stats[2] = stats[0]
    often = sorted(((count[t], name[t]) for t in tokens if count[t] * c.FREQUENT >= max(1, total)), reverse=True)
    v = c.Vocabulary.of(stats, often[: c.FREQUENT], 1)
    lengths, right = v.tables()
    spelt = c.spelling(np.frombuffer(b"".join(tokens), np.uint8), np.array([*map(len, tokens)], np.uint32), np.array([count[t] > 0 for t in tokens]), np.array([count[t] <= 1 for t in tokens]))
    word, bits = {}, {}
    for t, extra in zip(tokens, spelt):
        w, b = v.words(np.array([name[t]], np.uint64), np.array([count[t]]), np.array([index[t]], np.uint32), np.array([0]), 1)
        word[t], bits[t] = int(w[0]), float(b[0]) + (float(np.float32(extra)) if count[t] <= 1 else 0)
    path = lambda w: [w >> (31 - d) & 1 for d in range(int(lengths[w >> 16]))]
    records, cost = [], [0.0] * len(texts)
    for i, (d, k) in enumerate(texts):
        cost[i] = sum(bits[t] for t in k)
        for j, t in enumerate(k):
            one, two = (k[j - 1] if j else b"\n"), (k[j - 2] if j > 1 else b"\n")
            records.append((i, (one,), (one, two), word[t], path(word[t]), not held(d)))
    seen = Counter()
    for _, one, two, w, p, train in records:
        for d in range(len(p) + 1):
            for context in (one, two):
                seen[context, tuple(p[:d])] += train
    weights = {g: [0.0, 0.1, 0.9] for g in range(c.GATES)}
    centre = [1 / (1 + math.exp(-(b + 0.5 - 16) / 2)) for b in range(32)]
    refined = {(g, b): [64 * (1 - centre[b]), 64 * centre[b]] for g in range(c.GATES) for b in range(32)}
    for d in range(32):
        step = []
        for i, one, two, w, p, train in records:
            n1 = seen[one, tuple(p[:d])] - train
            if d >= len(p) or n1 <= 0:
                continue
            side = lambda context, s, p=p, train=train, d=d: seen[context, (*p[:d], s)] - (train and s == p[d])
            p0 = float(right[(1 << d) | (w >> (32 - d))]) if d <= 16 else 0.5
            p1 = (side(one, 1) + 2.0 * p0) / (n1 + 2.0)
            n2 = side(two, 0) + side(two, 1)
            p2 = (side(two, 1) + 0.5 * p1) / (n2 + 0.5)
            p0, p1, p2 = (min(max(q, 1e-6), 1 - 1e-6) for q in (p0, p1, p2))
            x = [math.log(q / (1 - q)) for q in (p0, p1, p2)]
            trust = lambda n: int(c.TRUST[min(n, 31)])
            g = 5 * trust(n1) + trust(n2)
            dot = max(-15.9, min(15.9, sum(a * b for a, b in zip(weights[g], x))))
            b = max(0, min(31, int(dot * 2 + 16)))
            q = 1 / (1 + math.exp(-dot))
            final = min(max(0.5 * (q + refined[g, b][1] / sum(refined[g, b])), 1e-5), 1 - 1e-5)
            cost[i] += math.log2(p0 if p[d] else 1 - p0) - math.log2(final if p[d] else 1 - final)
            step.append((g, b, p[d], q, x, train))
        for g in {s[0] for s in step}:
            mine = [s for s in step if s[0] == g and s[5]]
            for j in range(3):
                slope = sum((bit - q) * x[j] for _, _, bit, q, x, _ in mine) * 0.25 / max(len(mine), 16)
                weights[g][j] += max(-0.1, min(0.1, slope)) if mine else 0
        for g, b, bit, _, _, train in step:
            refined[g, b][bit] += train
    return [-x * math.log10(2) for x in cost]


def test_context_mixing_against_loops(spark):
    rng = np.random.default_rng(6)
    words_ = [f"w{i}" for i in range(60)]
    chain_ = {w: list(rng.choice(words_, 3)) for w in words_}

    def text():
        out = [words_[rng.integers(60)]]
        for _ in range(int(rng.integers(1, 60))):
            out.append(str(rng.choice(chain_.get(out[-1], words_))) if rng.random() < 0.8 else f"new{rng.integers(1000)}")
        return " ".join(out)

    rows = [(i, text()) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[9][1]), (102, ""), (103, None), (None, rows[4][1])]
    got = context_mixing.score(frame(spark, [(d, t, "en", "a") for d, t in rows])).collect()
    want = plain_scores([(d, whole(t)) for d, t in rows])
    assert len({r.doc_id for r in got}) == len(rows)
    of = {d: w for (d, _), w in zip(rows, want)}
    assert all(abs(r.score - of[r.doc_id]) < 2e-3 * max(1, abs(of[r.doc_id])) for r in got)


def test_context_mixing_selects_without_branches():
    """Sides are chosen by arithmetic, which random bits don't slow down; the tables made once are those each call would make."""
    rng = np.random.default_rng(4)
    bit, one, zero = rng.random(999) < 0.5, rng.integers(0, 1 << 30, 999).astype(np.int32), rng.integers(0, 1 << 30, 999).astype(np.int32)
    got = context_mixing._either(bit, one, zero)
    assert got.dtype == np.int32 and (got == np.where(bit, one, zero)).all()
    right = rng.random(64).astype(np.float32).clip(0.01, 0.99)
    stretched, paid = context_mixing._costs(right)
    assert np.allclose(stretched, np.log(right / (1 - right))) and np.allclose(paid[1::2], -np.log2(right)) and np.allclose(paid[::2], -np.log2(1 - right))


def test_context_mixing_follows_live_records_alone():
    """Groups and sums of the live records, and of no others, are those of plain loops, as bits part them and others go."""
    rng = np.random.default_rng(4)
    context = np.sort(rng.integers(0, 9, 400))
    word, train = rng.integers(0, 16, 400), rng.integers(0, 2, 400).astype(np.int32)
    order = np.lexsort((word, context))
    word = word[order]
    new = np.r_[True, context[1:] != context[:-1]]
    live = np.flatnonzero(rng.random(400) < 0.4)
    side = context_mixing.Side(None, new, train)
    side.keep(live)
    for d in range(4):
        zero = word >> 3 - d & 1 == 0
        m, left, right = side.split(zero)
        assert len(side.a) == len(live)
        for i, x, y in zip(live, left, right):
            mine = (context == context[i]) & (word >> 4 - d == word[i] >> 4 - d)
            assert (x, y) == (train[mine & zero].sum(), train[mine & ~zero].sum())
        stay = np.flatnonzero(rng.random(len(live)) < 0.8)
        side.move(~zero[live], m, stay)
        live = live[stay]


def test_context_mixing_learns_and_adds_up(spark):
    rng = np.random.default_rng(4)
    syllables = ["ba", "ko", "ri", "tun", "el", "sha", "vo"]
    text = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(120))
    rows = [(i, text(), "en", "a") for i in range(150)]
    got = context_mixing.score(frame(spark, rows)).filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "avg(bits_per_byte) AS b").first()
    assert got.b < 2.2  # seven syllables of two or three letters and a stop: about 1.4 bits a byte at best
    # A code's paths are a full tree: all bytes together have probability one, and so have all leaves of a vocabulary.
    code = context_mixing.Code(np.arange(256))
    assert abs(sum(2.0 ** -int(n) for n in code.n) - 1) < 1e-12
    stats = np.zeros((3, context_mixing.CLASSES), np.int64)
    stats[:, 0], stats[:, 1], stats[:, 2], stats[:, 9] = (50, 50, 50), (30, 70, 30), (7, 40, 7), (1, 600, 1)
    v = context_mixing.Vocabulary.of(stats, [(600, 77)], 1)
    assert abs((2.0 ** -v.size.astype(float)).sum() - 1) < 1e-12 and v.size.max() <= context_mixing.MOST_BITS
    assert abs((2.0 ** -(v.bits - v.more)).sum() - 1) < 1e-12


def test_context_mixing_knows_the_corpus(spark):
    """A held-out text that training has too costs little; scores don't depend on the partitions, but on the order of words."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"t{x}" for x in (300 * rng.random(200) ** 2).astype(int))
    rows = [(i, text(), "en", "a") for i in range(80)]
    held = [r for r in rows if context_mixing.held_out(r[0])]
    free = [i for i in range(100, 400) if not context_mixing.held_out(i)]
    mixed_up = [i for i in range(400, 600) if context_mixing.held_out(i)][0]
    rows += [(free[0], held[0][1], "en", "a"), (mixed_up, " ".join(sorted(held[0][1].split())), "en", "a")]
    df = frame(spark, rows)
    one, other = ({r.doc_id: r.score for r in context_mixing.score(d).collect()} for d in (df, df.repartition(7)))
    assert one == other
    assert one[held[0][0]] > 0.5 * one[held[1][0]] and one[held[0][0]] > 0.5 * one[mixed_up]


def test_chaining_finds_passages(docs, none):
    got = chaining.passages(docs).collect()
    pairs = {(r.doc_id, r.partner_id) for r in got}
    assert (14, 13) in pairs
    assert not {2, 5, 16, 17} & {x for p in pairs for x in p}
    for r in got:
        assert r.similarity >= 0.8 and r.doc_end - r.doc_start >= 40
    assert chaining.passages(none).count() == 0


def test_chaining_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    make = lambda n: list(rng.choice(vocabulary, n))
    rows, holders = [], defaultdict(set)
    passages = [make(60) for _ in range(5)]
    for i in range(80):
        w = make(rng.integers(20, 200))
        if i % 2:
            k = int(rng.integers(0, 5))
            p = list(passages[k])
            for at in rng.choice(60, 3, replace=False):  # 5 % of the words differ
                p[at] = str(rng.choice(vocabulary))
            w = w[:10] + p + w[10:]
            holders[k].add(i)
        rows.append((i, " ".join(w), "en", "a"))
    got = chaining.passages(frame(spark, rows)).collect()
    linked = {r.doc_id for r in got} | {r.partner_id for r in got}
    assert linked == set().union(*holders.values())
    for ids in holders.values():
        assert {r.doc_id for r in got} >= ids - {min(ids)}


def test_chaining_links_every_holder(spark):
    """Partial holders before and after the whole one, and holders of either half, don't hide an edited copy of it."""
    make = lambda name, n: [f"{name}{i}" for i in range(n)]
    p = make("p", 50)
    first, second = p[:25], p[25:]
    for parts in ([first, p, first], [first, second, p, first, second]):
        texts = [make(f"a{i}x", 20) + part + make(f"b{i}x", 20) for i, part in enumerate(parts)] + [make("c", 20) + first + ["inserted"] + second + make("d", 20)]
        got = {(r.doc_id, r.partner_id): r for r in chaining.passages(frame(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])).collect()}
        assert set(got) == {(len(parts), parts.index(p))}
        (row,) = got.values()
        assert (row.doc_start, row.doc_end, row.partner_start, row.partner_end) == (20, 71, 20, 70) and row.similarity == pytest.approx(50 / 51)


def distance(a, b):
    """The fewest words inserted, deleted or replaced."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_chaining_of_many_holders(spark):
    """A passage edited differently in 40 texts, more than are all paired: rows are true, classes hold 0.9 of all true pairs,
    and the partitions of the input don't matter. Copies beside it are one class with their first."""
    rng = np.random.default_rng(5)
    p = [f"p{i}" for i in range(60)]
    rows, holds = [], {}
    for i in range(40):
        q = list(p)
        for _ in range(int(rng.integers(0, 7))):
            at = int(rng.integers(0, len(q)))
            q[at : at + int(rng.integers(0, 2))] = [f"e{rng.integers(1000)}"] * int(rng.integers(0, 2))
        holds[i] = q
        rows.append((i, " ".join([f"a{i}x{j}" for j in range(15)] + q + [f"b{i}x{j}" for j in range(15)]), "en", "a"))
    rows += [(i, f"{' '.join(f'c{j}' for j in range(50))}", "en", "a") for i in range(100, 130)]
    rows += [(i, " ".join(f"d{i}x{j}" for j in range(90)), "en", "a") for i in range(200, 220)]
    docs = frame(spark, rows)
    got = chaining.passages(docs.repartition(1)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chaining.passages(docs.repartition(13)).collect()))
    true = {(i, j) for i in range(40) for j in range(i) if 1 - distance(holds[i], holds[j]) / max(len(holds[i]), len(holds[j])) >= 0.8}
    direct = {(r.doc_id, r.partner_id) for r in got if r.doc_id < 40}
    in_class = {x: r.class_id for r in got for x in (r.doc_id, r.partner_id)}
    assert len(true) > 500 and direct <= {(i, j) for i in range(40) for j in range(i)}
    assert sum((i, j) in direct or i in in_class and in_class[i] == in_class.get(j) for i, j in true) >= 0.9 * len(true)
    assert all(in_class[i] == 100 for i in range(100, 130)) and not set(in_class) & set(range(200, 220))


def test_chaining_links_passages_of_frequent_seeds(spark):
    """Two texts share a passage whose every seed is in more texts than are all paired; the first of them and the one before
    hold only a part of it, so neither leads to the other. Texts with a part alone stay without a link."""
    p = [f"p{i}" for i in range(50)]
    parts = [p[i : i + 20] for i in range(0, 31, 5)]
    rows = [(100 * k + i, " ".join([f"a{k}x{i}x{j}" for j in range(12)] + part + [f"b{k}x{i}x{j}" for j in range(12)]), "en", "a") for k in range(12) for i, part in enumerate(parts)]
    edited = p[:24] + ["other"] + p[25:]
    rows += [(650, " ".join([f"c{j}" for j in range(15)] + p + [f"d{j}" for j in range(15)]), "en", "a"), (5000, " ".join([f"e{j}" for j in range(9)] + edited), "en", "a")]
    got = chaining.passages(frame(spark, rows)).collect()
    assert [(r.doc_id, r.partner_id, r.class_id, r.doc_start, r.doc_end, r.partner_start, r.partner_end) for r in got] == [(5000, 650, 650, 9, 59, 15, 65)]


def test_chaining_of_runs_of_frequent_words(spark):
    """Junk of two frequent words after each other, each text with words of its own around: one class, from fewer
    rows than there are pairs of texts. Beside it a text whose runs are shorter, and one with too few of these words."""
    rows = []
    for i in range(60):
        run = ["so"] * (22 + i % 9) + ["on"] * (24 + i % 7)
        rows.append((i, " ".join([f"a{i}x{j}" for j in range(5)] + run + [f"b{i}x{j}" for j in range(45)]), "en", "a"))
    rows += [(90, " ".join(["so"] * 20 + ["on"] * 21 + [f"c{j}" for j in range(30)]), "en", "a"), (91, " ".join(["so"] * 30 + [f"d{j}" for j in range(30)]), "en", "a")]
    got = chaining.passages(frame(spark, rows)).collect()
    in_class = {x: r.class_id for r in got for x in (r.doc_id, r.partner_id)}
    assert in_class == dict.fromkeys([*range(60), 90], 0) and len(got) < 300


def test_chaining_finds_windows_that_begin_and_end_elsewhere(spark):
    """Either half of a passage is first in a text that holds it alone, with the same words around, so the places of the whole
    one repeat surroundings; and the text it is shared with has it but once."""
    first, second = [f"p{j}" for j in range(22)], [f"q{j}" for j in range(22)]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(12)] + (first if i % 2 else second) + [f"b{i}x{j}" for j in range(12)]), "en", "a") for i in range(24)]
    whole = [*first, "other", *second]
    rows += [(100, " ".join([*first, *(f"c{j}" for j in range(50)), *second, *(f"d{j}" for j in range(50)), *whole]), "en", "a"), (101, " ".join([*whole, *(f"e{j}" for j in range(50))]), "en", "a")]
    got = chaining.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.partner_id, r.class_id, r.doc_start, r.doc_end, r.partner_start, r.partner_end) for r in got} == {(101, 100, 100, 0, 45, 144, 189)}


def test_chaining_of_two_classes_needs_one_link():
    """Of 600 texts in two classes with one window, 90,000 pairs: the likeliest is sent first, none of a third class with other
    words, and windows with the same words around stand for each other."""
    rng = np.random.default_rng(12)
    row, n = np.arange(700), 700
    words = np.tile(np.arange(1, chaining.LEAST + 1, dtype=np.uint8), (n, 1))
    words[600:] = 200
    words[np.arange(300, 599), rng.integers(0, chaining.LEAST, 299)] = 99  # all but text 599 differ in a word
    root = np.where(row < 300, 0, np.where(row < 600, 300, 600))
    window = lambda around: chaining.packed([np.full(n, 5, np.uint64), root, around.astype(np.uint64), row.astype(np.uint64) + np.uint64(1), row, *np.zeros((2, n), np.uint32), np.ascontiguousarray(words).view(f"V{chaining.LEAST}").ravel()])
    links = lambda data, every: [r for b in chaining.link_windows(every)(iter([chaining.batch_of([(0, 0, data)])])) for r in b.to_pylist()]
    (best,) = links(window(row), False)
    assert (best["low"], best["high"], best["alike"], best["row"], best["other"]) == (0, 300, chaining.LEAST, 599, 0)
    assert len(links(window(row), True)) == 300 * 300 and len(links(window(root), True)) == 1


def test_links_travel_as_a_row_for_two_classes():
    """500 links of two classes each, in batches as they are found: twelve rows, which hold what a row for each link sends."""
    rng = np.random.default_rng(6)
    links = [(low, 7, 35, 9 + low, int(rng.integers(0, 5)), *rng.integers(0, 300, 4).tolist()) for low in range(3) for _ in range(500)]
    rng.shuffle(links)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["low", "high", "alike", *chaining.CHOSEN])
    (got,) = chaining.by_classes(iter)([batch(links[i : i + 150]) for i in range(0, 1500, 150)])
    assert sorted(zip(*(got.column(i).to_pylist() for i in range(2)))) == [(low, 7) for low in range(3) for _ in range(4)]

    def sent(run, batches):
        return [{k: [(r, s.tolist()) for r, s in v] for k, v in chaining.by_other(chaining.unpacked([x.column(2)[0].as_py() for x in run(iter(batches))], chaining.CHAIN)).items()}]

    assert sent(chaining.send_spots(1), [got]) == sent(chaining.send_links(1), [batch(links)])


def test_runs_that_lead_nowhere_are_not_aligned(monkeypatch):
    """Runs of one word, shorter than a passage, in two texts with words of their own: of all spots at their edges none is aligned.
    With words in common behind the runs, the passage is found from the same spots."""
    calls, extend = [], chaining.extend
    monkeypatch.setattr(chaining, "extend", lambda *a: calls.append(a[2:]) or extend(*a))
    names = ["bucket", "kind", "data", "doc", "tag", "text"]
    beside = lambda rows, text, doc: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*r, None, None, None) for r in rows], (0, 1 << 30, None, doc, 0, text.encode())), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()))], names)
    for tail, want in (([], []), ([f"t{i}" for i in range(20)], [(2, 1)])):
        x, y = (" ".join([*(f"{a}{i}" for i in range(9)), *["so"] * n, *tail, *(f"{b}{i}" for i in range(9))]) for a, b, n in (("a", "b", 36), ("c", "d", 38)))
        spots = np.array([(9, 9 + k, 9 + 31 - k, 9 + 33) for k in range(20)] + [(9 + k, 9, 9 + 31, 9 + 33 - k) for k in range(1, 20)], "<u4").T
        chains = chaining.dealt([np.full(39, 2), np.full(39, 1), *spots], np.zeros(39, np.int32))
        words = [r for b in chaining.send_words(1)(iter([beside(chains, y, 1)])) for r in zip(*(c.to_pylist() for c in b.columns))]
        got = [r for b in chaining.align_chains(iter([beside(words, x, 2)])) for r in b.to_pylist()]
        assert sorted({(r["row"], r["other"]) for r in got}) == want and bool(calls) == bool(want)


def test_spots_left_out_make_no_passage():
    rng = np.random.default_rng(21)
    found = left = 0
    for _ in range(150):
        word = lambda: [int(rng.integers(0, 4))] * int(rng.integers(1, 30)) if rng.random() < 0.5 else rng.integers(0, 50, int(rng.integers(1, 15))).tolist()
        parts = [word() for _ in range(6)]
        x, *ys = ([v for p in (parts[k] if rng.random() < 0.7 else word() for k in range(6)) for v in p] for _ in range(4))
        others = []
        for y in ys:
            low = int(rng.integers(0, 9))
            at = [(i, j + low) for i in range(len(x) - chaining.K + 1) for j in range(len(y) - chaining.K + 1) if x[i : i + chaining.K] == y[j : j + chaining.K]]
            spots = np.array([(*at[a], *at[b]) for a, b in rng.integers(0, len(at), (40, 2))] if at else np.empty((0, 4)), "<u4")
            others.append((y, low, spots))
        for (y, low, spots), kept in zip(others, chaining.promising(x, others)):
            whole = chaining.align(x, y, [tuple(s) for s in spots.tolist()], low)
            assert chaining.align(x, y, [tuple(s) for s in kept.tolist()], low) == whole
            found, left = found + len(whole), left + len(spots) - len(kept)
    assert found > 50 and left > 1000


def test_words_in_common_order():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (2, 60, chaining.LEAST)).astype(np.uint8)
    y[:20] = np.roll(x[:20], 3, axis=1)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for v in a:
            new = [0]
            for j, w in enumerate(b, 1):
                new.append(row[j - 1] + 1 if v == w else max(row[j], new[-1]))
            row = new
        return row[-1]

    assert chaining.in_order(x, y).tolist() == [longest(a, b) for a, b in zip(x.tolist(), y.tolist())]


def test_chaining_sends_anchors_together():
    """Seeds of two to eight places, and of more, give one row for a bucket of anchors, and the anchors of all pairs."""
    rng = np.random.default_rng(3)
    shared = [[f"s{k}w{i}" for i in range(12)] for k in range(12)]
    texts = {r: " ".join([f"t{r}"] + [w for k in rng.permutation(12) if r < k + 2 for w in shared[k]]).encode() for r in range(13)}
    docs = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()), pa.binary())], ["row", "text"])
    sent = [r for b in chaining.find_seeds(1)(iter([docs])) for r in zip(*(c.to_pylist() for c in b.columns))]
    got = [r for b in chaining.link_seeds(1)(iter([chaining.batch_of(sent)])) for r in zip(*(c.to_pylist() for c in b.columns))]
    (anchors,) = [d for _, kind, d in got if kind == chaining.ANCHORS]
    row, other, pos, other_pos, _ = (c.tolist() for c in chaining.unpacked([anchors], chaining.ANCHOR))
    words = {r: t.split() for r, t in texts.items()}
    assert all(words[a][i : i + chaining.K] == words[b][j : j + chaining.K] for a, b, i, j in zip(row, other, pos, other_pos))
    assert {(a, b) for a in range(8) for b in range(a)} <= set(zip(row, other)) and {(a, 0) for a in range(1, 13)} <= set(zip(row, other))


def test_chaining_workers_give_back_memory():
    """Small arrays below one that stays would be kept by the allocator until the process ends."""
    pages = lambda: int(open("/proc/self/statm").read().split()[1])
    last = []

    def run(batches):
        held = []
        for batch in batches:
            held += [np.ones(1000) for _ in range(25_000)]  # 200 MB
            last.append(np.ones(1000))
            yield batch

    before = pages()
    assert list(chaining.trimmed(run)(iter([1, 2]))) == [1, 2]
    assert (pages() - before) * 4096 < 100 << 20


def test_chaining_numbers_as_unique_does():
    rng = np.random.default_rng(4)
    for size, n in ((0, 1), (1, 1), (5, 900), (300, 40), (300, 2000), (300, 5000)):
        x = rng.integers(0, n, size).astype(np.uint32)
        for got, due in zip(chaining.numbered(x, n), np.unique(x, return_inverse=True)):
            assert got.tolist() == due.tolist()


def test_chaining_left_out_places_against_plain_loops():
    rng = np.random.default_rng(8)
    for _ in range(30):
        places = sorted({(int(r), int(p)) for r, p in zip(rng.integers(0, 4, 90), rng.integers(0, 150, 90))})
        row, pos = (np.array(x) for x in zip(*places))
        words = {(r, p + j) for r, p in places for j in range(chaining.K)}
        whole = {(r, b) for r in range(4) for b in range(-40, 200) if sum((r, b + j) in words for j in range(chaining.LEAST)) >= chaining.DENSE}
        want = [any((r, b) in whole for b in range(p - chaining.LEAST + 1, p + 1)) and any((r, b) in whole for b in range(p + chaining.K - chaining.LEAST, p + chaining.K)) for r, p in places]
        assert chaining.dense(row, pos).tolist() == want
    same = chaining.anew(np.zeros(400, np.int64), np.arange(400), np.tile(np.array([3, 5], np.uint64), 200))
    assert 2 <= same.sum() <= 4 * (1 << chaining.DOUBLED)


def test_chaining_pairs_few_holders_all(spark):
    rng = np.random.default_rng(15)
    rows, true = [], set()
    for g in range(12):
        p = [f"g{g}p{i}" for i in range(55)]
        held = []
        for i in range(int(rng.integers(2, 8))):
            q = list(p)
            for at in rng.choice(55, int(rng.integers(0, 5)), replace=False):
                q[at] = f"e{rng.integers(10**6)}"
            held.append((100 * g + i, q))
            rows.append((100 * g + i, " ".join([f"a{g}x{i}x{j}" for j in range(12)] + q), "en", "a"))
        true |= {(i, j) for i, a in held for j, b in held if j < i and 1 - distance(a, b) / 55 >= 0.84}
    got = {(r.doc_id, r.partner_id) for r in chaining.passages(frame(spark, rows)).collect()}
    assert len(true) > 100 and len(true & got) >= 0.98 * len(true)


@pytest.mark.parametrize(("length", "every"), [(50, 7), (50, 8), (60, 7), (60, 6)])
def test_chaining_finds_even_edits(spark, length, every):
    """Substitutions at even steps (likeness 0.83 to 0.88) leave runs of few words, each of which is a seed."""
    rows, want = [], set()
    for i in range(60):
        p = [f"p{i}x{j}" for j in range(length)]
        q = [f"q{i}x{j}" if j % every == every - 1 else w for j, w in enumerate(p)]
        rows += [(2 * i, " ".join([f"a{i}x{j}" for j in range(15)] + p), "en", "a"), (2 * i + 1, " ".join(q + [f"b{i}x{j}" for j in range(15)]), "en", "a")]
        want.add((2 * i + 1, 2 * i))
    assert {(r.doc_id, r.partner_id) for r in chaining.passages(frame(spark, rows)).collect()} == want


def test_chain_prefers_the_cheaper_gap():
    pos, other = np.array([0, 5, 10, 15, 20, 12]), np.array([100, 105, 110, 115, 120, 900])
    best = chaining.chain(pos, other)
    assert best[0] == (0, 100, 20, 120) and (12, 900, 12, 900) in best


def test_alignment_tries_a_run_once(monkeypatch):
    """Spots of one run of equal words, too short for a passage, lead to the same alignment."""
    calls, extend = [], chaining.extend
    monkeypatch.setattr(chaining, "extend", lambda *a: calls.append(a[2:]) or extend(*a))
    x, y = [*range(100, 130), *range(20), *range(130, 160)], [*range(200, 230), *range(20), *range(230, 260)]
    spots = [(30 + k, 30 + k, 35 + k, 35 + k) for k in range(0, 10, 2)]
    assert chaining.align(x, y, spots, 0) == [] and len(calls) == 2


def test_alignments_are_true():
    """What an alignment reports as matches is never more than the fewest edits allow; few edits are all crossed."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = [int(c) for c in rng.integers(0, 400, 60)]
        b = list(a)
        n = int(rng.integers(0, 7))
        for _ in range(n):
            k = int(rng.integers(0, len(b)))
            b[k : k + int(rng.integers(0, 2))] = [-1] * int(rng.integers(0, 2))
        u, v, span, match = chaining.extend(a, b, 0, 0)
        assert span >= max(u, v) and match <= span - distance(a[:u], b[:v]) and (not span or match >= 0.8 * span)
        if n <= 3 and a[:8] == b[:8]:
            assert u >= 52

