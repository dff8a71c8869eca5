"""The operators that compare texts with each other, against brute force, and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate, graph, ngram_join, pii, quality_rules, substring_dedup, suffix_dedup
from tidemark.llm import windows as win
from tidemark.llm.queries import queries
from tidemark.llm.suffix_sort import suffix_array

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rid int, spans string")


# ---- n-gram Jaccard join


def plain_components(rows):
    sets = []
    for _, t in rows:
        ws = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    lists, overlap = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for k in s:
            lists[k].append(i)
    for own in lists.values():
        overlap.update((own[b], own[a]) for a in range(len(own)) for b in range(a))
    for (a, b), o in overlap.items():
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            top[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def near_copies(n):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            ws[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        out.append((i, " ".join(ws[: rng.randrange(90, 121)] if i % 3 == 0 else ws)))
    out += [(n + i, " ".join(base[:20] + [f"y{rng.randrange(300)}" for _ in range(rng.randrange(2, 30))])) for i in range(60)]
    return out + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "a b c d e f"), (None, "a b"), (0, out[0][1])]


@pytest.mark.parametrize("block, short", [(32, 3), (32, 64), (256, 64)])
def test_components(spark, rows, monkeypatch, block, short):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHORT", short)
    for some in (rows, near_copies(250)):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(table(spark, some)).collect())
        assert got == plain_components(some)


def test_chain_of_texts_that_share_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(3)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    chain = [(i, " ".join(ws[8 * i : 8 * i + 60])) for i in range(90)]
    chain += [(200 + i, t[: t.rindex(" ")]) for i, t in chain[::9]] + [(300, "one very long text " * 60_000), (301, "x" * 1_000_000), (302, "x" * 1_000_000)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(table(spark, chain)).collect())
    assert got == plain_components(chain)


def test_one_row_of_each_group_stays(spark):
    some = near_copies(40)
    kept = ngram_join.keep_one(table(spark, some)).collect()
    groups = {c for d, n, c in plain_components(some)}
    assert len(kept) == len(groups) and kept[0].spans == "x"
    assert ngram_join.join(table(spark, some).limit(0)).count() == 0


def test_extra_columns_stay_as_they_are(spark):
    some = spark.createDataFrame([(i, t, f"k{i}", i, "odd") for i, t in enumerate(["a b c d e f", "a b c d e f", "g"])], "doc_id long, text string, _key string, row_key int, `x.y` string")
    bench = spark.createDataFrame([(1, "nothing of this is found anywhere at all")], "item_id long, text string")
    for out in (ngram_join.keep_one(some), decontaminate.drop_leaks(some, bench), quality_rules.clean(some), pii.redact(some)):
        assert out.columns == some.columns and all(r._key == f"k{r.doc_id}" and r.row_key == r.doc_id for r in out.collect())


def test_one_row_of_near_copies_under_one_id_or_none(spark):
    words = [f"w{i}" for i in range(80)]
    near = lambda tag, ws: [" ".join(ws[:40] + [f"{tag}{k}"] + ws[41:]) for k in range(3)]
    some = [(7, t) for t in near("a", words)] + [(None, t) for t in near("b", words[::-1])] + [(7, "far from all of the others here")]
    some += [(5, t) for t in near("c", [f"v{i}" for i in range(80)])[:1]] + [(None, t) for t in near("c", [f"v{i}" for i in range(80)])[1:]] + [(None, ""), (None, None), (8, "")]
    kept = [(r.doc_id, r.text or "") for r in ngram_join.keep_one(table(spark, some)).collect()]
    assert len(set(kept)) == len(kept) == 6 and set(kept) <= {(d, t or "") for d, t in some}
    assert sorted(str(d) for d, _ in kept) == ["5", "7", "7", "8", "None", "None"]


def test_overlaps_by_slices():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(20)]
    got = ngram_join.overlaps(sets[:8], sets[8:], width=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]


def test_graph_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    top = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == top


# ---- suffix array


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randint(0, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(a, np.int64)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])


def plain_bytes(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            k = b[i : i + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def byte_cases():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé \n") for _ in range(400)) for _ in range(5)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            x = rng.randint(0, 300)
            parts += [rng.choice(base)[x : x + rng.randint(20, 120)], "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))]
        out.append((rng.choice([i, i, rng.randint(0, 120)]), "".join(parts)))
    return out + [(500, None), (501, ""), (None, base[0]), (502, "a" * 300), (503, "a" * 200 + "b" * 60), (504, "ab" * 200), (505, "\0" * 120), (506, "x" * 30 + "\0" * 100), (507, base[2]), (507, base[2])]


def test_suffix_dedup(spark, rows):
    for some, most in ((byte_cases(), suffix_dedup.MOST), (byte_cases(), 3), (rows, suffix_dedup.MOST)):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(table(spark, some), most=most).collect())
        assert got == plain_bytes(some)
    assert suffix_dedup.digests(table(spark, rows[:1]).limit(0)).count() == 0


@pytest.mark.parametrize("length", [16, 120, 140, 200, 300])
def test_suffix_dedup_of_other_lengths(spark, length):
    rng = random.Random(length)
    shared = "".join(rng.choice("abcdé ") for _ in range(900))
    some = [(1, shared), (2, "x" + shared + "yz"), (3, shared[100:450] + "-" + shared[500 : 500 + length - 1]), (4, shared[:length])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(table(spark, some), length).collect())
    assert got == plain_bytes(some, length) and sum(r[2] for r in got) > 900


def test_suffix_dedup_keeps_bytes(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(90))
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove(table(spark, [(1, text), (2, "é" + text + "tail")])).collect()}
    assert got == {1: text.encode(), 2: "étail".encode()}


# ---- suffix trees


def plain_words(rows, length=35):
    count, texts = collections.Counter(), [re.findall(SPACE, t or "") for _, t in rows]
    for ws in texts:
        count.update(tuple(ws[i : i + length]) for i in range(len(ws) - length + 1))
    out = []
    for (d, _), ws in zip(rows, texts):
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if count[tuple(ws[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((str(d), len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def word_cases():
    rng = random.Random(4)
    base = [[f"{rng.choice('aé')}{rng.randrange(40)}" for _ in range(400)] for _ in range(5)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            x = rng.randint(0, 300)
            parts += rng.choice(base)[x : x + rng.randint(10, 90)] + [f"z{rng.randrange(40)}" for _ in range(rng.randint(0, 30))]
        out.append((i, rng.choice([" ", "\n ", " \t"]).join(parts)))
    once = " ".join(f"q{i}" for i in range(80))
    return out + [(500, None), (501, ""), (None, " ".join(base[0])), (502, "a " * 300), (503, "a " * 36), (504, "b " * 35), (505, "b " * 34), (507, once), (507, once)]


def test_substring_dedup(spark, rows):
    for some, budget, most in ((word_cases(), 40, substring_dedup.MOST), (word_cases(), 40, 3), (rows, substring_dedup.BUDGET, substring_dedup.MOST)):
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(table(spark, some), budget=budget, most=most).collect())
        assert got == plain_words(some)
    assert substring_dedup.digests(table(spark, rows[:1]).limit(0)).count() == 0
    kept = {r.doc_id: r.kept for r in substring_dedup.remove(table(spark, [(1, "x " + "r " * 40 + "y"), (2, "one two")])).collect()}
    assert kept == {1: "x y", 2: "one two"}


def test_trees_hold_all_repeats():
    rng = np.random.default_rng(3)
    right = rng.integers(1, 4, (300, 12))
    right[:, 8:][rng.random((300, 4)) < 0.5] = 0
    for budget in (10, 1000):
        order, nodes = substring_dedup.subtrees(right, budget)
        assert sorted(order) == list(range(300))
        for depth in (5, 6, 7):
            want = {frozenset(g) for g in _classes(right, depth) if len(g) > 1}
            got = {frozenset(order[lo:hi].tolist()) for d, p, lo, hi in nodes if d >= depth > p}
            assert got == want


def _classes(right, depth):
    groups = collections.defaultdict(list)
    for i, r in enumerate(right):
        if (r[:depth] > 0).all():
            groups[tuple(r[:depth])].append(i)
    return groups.values()


# ---- all together


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
    run = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in run.select("doc_id").collect()} == {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < run.count() < docs.count()


def test_names_of_queries():
    assert [n for n in sorted(queries(), key=lambda x: int(re.match(r"op(\d+)_", x)[1]))] and len(queries()) == 10


def test_hot_halves_are_told_by_range_and_hash():
    parts = 16
    bounds = win.range_bounds(parts)
    low = 64 - ngram_join.RANGE_BITS
    keys = np.array([(int(bounds[p]) << 32) | x << low for p, x in ((3, 7), (9, 7), (3, 8))], np.uint64)
    hot = np.array([parts, (3 << 32) | 7], np.uint64).tobytes()
    # the second key has the hash bits of the first, in another range
    assert win.is_hot(keys, np.zeros(3, np.int64), [hot]).tolist() == [True, False, False]
    assert win.is_hot(keys, np.array([0, 1, 1]), [hot, None]).tolist() == [True, False, False]
    assert win.is_hot(keys, np.array([0, 1, 1]), [None, hot]).tolist() == [False, False, False]
    assert not win.is_hot(keys, np.zeros(3, np.int64), [None]).any()
