"""The per-text operators against plain Python, with nulls, empty and long texts, repeats and clashing columns."""

import base64
import glob
import hashlib
import os
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, lm, pii, quality_model, quality_rules, queries, warc
from tidemark.llm import text as tx
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.text import words

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd(spark, texts):
    rows = [(i, t, "x", None, 1) for i, t in enumerate(texts)] + [(None, "null id here", None, "s", 2), (0, texts[0], "x", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, source string, rid int")


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    random.seed(3)
    long = "".join(random.choice("abcdethinoéß'") for _ in range(9000))
    texts = ["a b  c", "", None, "<|endoftext|>x<|startoftext|>", long, "x" * 5000 + " end", "日本" * 2500, "a1!" * 2000 + "<|endoftext|>" + "the" * 1500, "İ ΣΑΣ ̈é z"]

    def want(x):
        ids = t.encode(x or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    for frame in (docs, odd(spark, texts)):
        source = [(r.doc_id, r.text) for r in frame.collect()]
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame, path).collect())
        assert got == sorted((str(i), *want(x)) for i, x in source)
    one = bpe.encode(docs.limit(3), path)
    assert [r.decoded for r in bpe.decode(one, path).orderBy("doc_id").collect()] == [r.decoded for r in one.orderBy("doc_id").collect()]
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_joins_of_pieces_equal_whole_encoding():
    path = tokenizer_path()
    random.seed(1)
    for _ in range(300):
        s = "".join(random.choice(["th", "e", "in", "ing", "a", "zz", "q", "tion"]) for _ in range(random.randint(2, 60)))
        k = random.randint(1, len(s) - 1)
        joined = bpe.join_sides(path, bpe.encode_piece(path, s[:k], False), bpe.encode_piece(path, s[k:], True), True)
        assert joined == bpe.encode_piece(path, s, True)


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    def ok(kind, m):
        n = re.sub(r"\D", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(n) <= 19 and pii.luhn(n), "phone": 9 <= len(n) <= 15}[kind]

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(k, m[0]))


def test_base_spans(spark, docs):
    random.seed(1)
    for _ in range(5000):
        t = "".join(random.choice("a1.@+- (9%b2") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(t) == [(k, s, e) for s, _, e, k in plain_spans(t)]
    for frame in (docs, odd(spark, ["é a@b.co 4047054433953522", None, "", "1.2.3.4 " * 2000])):
        for r, got in zip(frame.orderBy("doc_id").collect(), pii.digests(frame).orderBy("doc_id").collect()):
            text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in plain_spans(r.text or ""))
            assert got.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(got.spans.split(","))


def test_context_finds_unseen_numbers(spark):
    cards = ["4047054433953522", "4777431686562174", "4804071098067953", "4113677509365772", "4963594216513977"]
    rows = [(i, f"w{i} my card number {random.Random(i).choice(cards)[:-4]}{i:04d} thanks bye") for i in range(300)]
    good = [(1000 + i, f"x{i} my card number {c} thanks bye") for i, c in enumerate(cards)]
    seeds = [r for r in rows if pii.base_spans(r[1])] + good
    new = next(r for r in rows if not pii.base_spans(r[1]))
    for r in pii.digests(spark.createDataFrame(seeds + [new, (5000, "order 1234567890123 shipped")], "doc_id long, text string")).collect():
        if r.doc_id == new[0]:
            assert r.spans.startswith("card:")
        if r.doc_id == 5000:
            assert r.spans == ""


def test_found_instances_induce_further_patterns(spark):
    cards = [c for c in (f"40470544339{i:05d}" for i in range(300)) if pii.luhn(c)]
    new = [f"12345678901234{i:02d}" for i in range(10, 40) if not pii.luhn(f"12345678901234{i:02d}")][:7]
    say = lambda i, a, v, b: (i, f"u{i} {a} {v} {b} v{i}")
    rows = [say(i, "my card number", c, "thanks bye") for i, c in enumerate(cards)]
    rows += [say(100 + i, "my card number", c, "thanks bye") for i, c in enumerate(new[:6])] + [say(200 + i, "please charge to", c, "right away") for i, c in enumerate(new)]
    rows += [(300, "order 1234567890123 shipped")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.mentions(df)
    once, thrice = ({r.value for r in pii.bootstrap(found, rounds=k).collect()} for k in (1, 3))
    assert len(new) == 7 and once == set(new[:6]) and thrice == set(new)
    assert {r.doc_id for r in pii.digests(df).where("spans = ''").collect()} == {300}


def test_held_out_seeds_are_found_again(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    number = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    rows, private = [], set()
    for i in range(900):
        n = number()
        if i % 3:
            n = next(x for d in range(10) if pii.luhn(x := n[:-1] + str(d)))
            rows.append((i, f"{word()} {word()} card number {n} on file {word()}"))
            private.add(n)
        else:
            rows.append((i, f"{word()} {word()} parcel tracking {n} was sent {word()}"))
    found = pii.mentions(spark.createDataFrame(rows, "doc_id long, text string"))
    held = {v for v in private if int(v) % 4 == 0}
    masked = found.withColumn("mentions", F.transform("mentions", lambda m: m.withField("seed", m["seed"] & ~m["value"].isin(list(held)))))
    got = {r.value for r in pii.bootstrap(masked).collect()}
    assert len(held) > 100 and len(got & held) >= 0.95 * len(held) and len(got & private) >= 0.95 * len(got)


def test_scans_of_unbroken_text_are_linear():
    for text in ("a" * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000, "a@" * 300_000, "1" * 1_000_000, "1-" * 400_000, "+1(" * 300_000, "1." * 400_000, "@a." * 300_000, "a@b.co" * 150_000):
        began = time.time()
        pii.candidates(text, pii.base_spans(text))
        assert time.time() - began < 8


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15, "k", 5, "s", 7), (2, None, 0, "k", 6, "s", 8)], "doc_id long, text string, n_chars long, spans string, _key int, found_spans string, ROW_KEY int")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16 and got[2].text is None
    assert (got[1].spans, got[1]._key, got[1].found_spans, got[1].ROW_KEY) == ("k", 5, "s", 7) and pii.redact(df).columns == df.columns


def plain_counts(t):
    ws = re.findall(SPACE, t or "")
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if re.search(SPACE, x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    rep = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(grams) < 3000 else None
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), dup, None if rep is None else len(rep)


def test_quality_counts_and_verdicts(spark, docs):
    small = docs.where("n_chars < 8000")
    rows = {r.doc_id: r for r in quality_rules.judge(small).collect()}
    for r in small.collect():
        got, want = rows[r.doc_id], plain_counts(r.text)
        have = (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words)
        assert have == want or want[4] is None and have[:4] == want[:4]
        assert got.base_failed == (got.n_words < 10 or 100 * got.n_repeat_words > 20 * got.n_words)
        assert not (got.kept and got.base_failed)
    assert quality_rules.judge(odd(spark, ["a b", None, "", "a b c d e " * 50])).where("kept").count() == 0
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(60, 200))) + ".", "en", "s") for i in range(400)]
    bad = [(1000 + i, " ".join(word() + "$$$" for _ in range(100)), "en", "s") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[1000 + i] for i in range(20)) and sum(kept[i] for i in range(400)) > 396


def plain_estimate(x):
    """Location and scatter by numpy alone: of two starts, that with the smaller determinant after the steps."""
    n = len(x)
    at = lambda v, share: np.sort(v)[int(np.ceil(share * n)) - 1]
    floor, fits = np.diag(np.square(quality_rules.FLOORS)), []
    for width in (1.349, 4.0):
        centre = np.array([at(c, 0.5) for c in x.T])
        cov = np.diag([((at(c, 0.75) - at(c, 0.25)) / width) ** 2 for c in x.T]) + floor
        for _ in range(quality_rules.STEPS):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[d <= at(d, quality_rules.SUPPORT)]
            centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floor
        fits.append((np.linalg.slogdet(cov)[1], centre, cov))
    return min(fits, key=lambda f: f[0])[1:]


def test_verdicts_equal_plain_estimates(spark):
    rng, rows = random.Random(9), []
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    for lang, source, n in (("en", "a", 260), ("en", "b", 220), ("en", None, 30), ("de", "a", 40), (None, "c", 25)):
        for _ in range(n):
            end = rng.choice(["$$$", "!?", "99"]) if rng.random() < 0.1 else ""
            rows.append((len(rows), " ".join(word() + end for _ in range(rng.randint(15, 200))), lang, source))
    rows += [(9000, "too short", "en", "a"), (9001, None, None, None), (9002, " ".join(word() for _ in range(20_000)), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    good = [r for r in quality_rules.measure(df).collect() if not got[r.doc_id].base_failed]
    cells = {}
    for r in good:
        for key in ((r.lang, r.source), (r.lang,), ()):
            cells.setdefault(key, []).append([r[s] for s in quality_rules.STATS])
    own = lambda r: next((k for k in ((r.lang, r.source), (r.lang,)) if len(cells[k]) >= quality_rules.LEAST), ())
    fits = {k: plain_estimate(np.array(cells[k])) for k in {own(r) for r in good}}
    assert set(fits) == {("en", "a"), ("en", "b"), ("en",), ()}
    for r in good:
        centre, cov = fits[own(r)]
        x = np.array([r[s] for s in quality_rules.STATS]) - centre
        d = x @ np.linalg.inv(cov) @ x / len(x)
        assert got[r.doc_id].distance == pytest.approx(d, rel=0.1)
        assert got[r.doc_id].kept == (d <= quality_rules.BOUND) or abs(d - quality_rules.BOUND) < 0.1 * quality_rules.BOUND
    assert not got[9000].kept and not got[9001].kept and 10 < sum(not got[r.doc_id].kept for r in good) < 120


def test_determinant_falls_with_each_step(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "c", *map(float, r)) for i, r in enumerate(rng.normal(size=(500, len(quality_rules.STATS))) * 3)]
    df = spark.createDataFrame(rows, ["rid", "cell", *quality_rules.STATS])
    dets = [quality_rules.estimates(df, steps=k)[0].first().log_det for k in (1, 3)]
    assert dets[1] <= dets[0] + 0.05


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    n, f = quality_model.BUCKETS + quality_model.N_STATS, quality_model.FACTORS
    m = quality_model.Model(0.3, rng.normal(size=n), rng.normal(size=(n, f)), np.zeros(quality_model.N_STATS), np.ones(quality_model.N_STATS))
    ids, val = np.array([1, 5, 9, 70, 5]), rng.normal(size=5)
    got = m.raw(ids, val, np.array([0, 3, 5]))[0]
    for (s, e), g in zip(((0, 3), (3, 5)), got):
        pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * val[i] * val[j] for i in range(s, e) for j in range(i + 1, e))
        assert g == pytest.approx(0.3 + m.w[ids[s:e]] @ val[s:e] + pairs)


def test_scores_equal_the_sum_over_all_pairs(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["", None, "a a b", " ".join(f"w{i % 4000}" for i in range(30_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality_model.score(df, model).collect()
    for r in out:
        ids, val, _ = quality_model.features(pa.array([texts[r.doc_id]], pa.string()))
        x = model.scaled(ids, val)
        pairs = np.triu((model.v[ids] @ model.v[ids].T) * np.outer(x, x), 1).sum()
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(model.w0 + model.w[ids] @ x + pairs, -30, 30))), abs=1e-9)
        assert r.predicted == (r.score >= quality_model.THRESHOLD)
    assert len(out) == len(texts)


def test_one_id_with_several_texts_fits_alike(spark):
    rows = [(i, f"text {i % 7} {'good words' if i % 2 else 'bad $$$'} {k}") for i in range(40) for k in range(2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (quality_model.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert (a.w == b.w).all() and (a.v == b.v).all() and a.w0 == b.w0


def test_classifier_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out.loc[out["quality"] == 1, "score"].to_numpy(), out.loc[out["quality"] == 0, "score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert quality_model.classify(odd(spark, ["a", None, ""]), labels.limit(0)).where("score between 0 and 1").count() == 5


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 10), (5, 5), (3000, 1 << 45), (3000, 4000)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        ef = lm.EliasFano.build(v)
        assert (ef.get(np.arange(len(v))) == v).all() and (ef.find(v) == np.arange(len(v))).all()
        q = rng.integers(0, 2 * top, 2000).astype(np.uint64)
        assert ((ef.find(q) >= 0) == np.isin(q, v)).all()


def test_language_model(spark, docs):
    import collections
    import math
    import zlib

    frame = docs
    texts = {r.doc_id: re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + ["\n"] for r in frame.collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c, bi = collections.Counter(), collections.Counter()
    for d, ws in texts.items():
        if not held(d):
            c.update(ws)
            bi.update(zip(["\n", *ws[:-1]], ws))
    total, known = sum(c.values()), len(c)
    for g in lm.score(frame).collect():
        ws = texts[g.doc_id]
        base = sum(math.log10((c[x] + 1) / (total + known + 1)) for x in ws)
        model = sum(math.log10((bi[h, x] + lm.MU * (c[x] + 1) / (total + known + 1)) / (c[h] + lm.MU)) for h, x in zip(["\n", *ws[:-1]], ws))
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(g.doc_id), len(ws), sum(c[x] > 0 for x in ws), total)
        assert g.base_score == pytest.approx(base) and abs(g.score - model) < 0.03 * len(ws)
    assert lm.score(odd(spark, ["a a", None, ""])).count() == 5 and lm.score(docs.limit(0)).count() == 0


def test_a_word_that_is_most_of_the_text(spark):
    import collections
    import math

    rng = random.Random(6)
    texts = [" ".join("the" if rng.random() < 0.6 else f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 60))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score(frame).collect()}
    learn = [x.split() + ["\n"] for d, x in enumerate(texts) if not out[d].held_out]
    c, bi = collections.Counter(w for ws in learn for w in ws), collections.Counter(p for ws in learn for p in zip(["\n", *ws], ws))
    total, known = sum(c.values()), len(c)
    assert c["the"] * lm.SHARE * 4 > 8 * total  # goes as many words
    for d, x in enumerate(texts):
        ws = x.split() + ["\n"]
        model = sum(math.log10((bi[h, w] + lm.MU * (c[w] + 1) / (total + known + 1)) / (c[h] + lm.MU)) for h, w in zip(["\n", *ws], ws))
        assert (out[d].n_tokens, out[d].n_known, out[d].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert out[d].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + known + 1)) for w in ws)) and abs(out[d].score - model) < 0.03 * len(ws)


def test_words_beyond_sixteen_bits():
    w = np.repeat(np.arange(70_000, dtype=np.uint64) << np.uint64(20), 2)
    h = np.tile(np.array([3, (1 << 40) - 1], np.uint64), 70_000)
    trie = lm.Trie.mapped(lm.Trie.build(w, h, np.ones(len(w), np.int64), 140_000, 70_000).dump())
    got = trie.numerator(w, h, 140_000, 70_000)
    assert np.allclose(got, np.log10(1 + lm.MU * 3 / 210_001), atol=0.02) and (trie.count(w[::2]) == 2).all()


def edits_in(p, t):
    row = [0] * (len(t) + 1)
    for c in p:
        new = [row[0] + 1]
        for j, e in enumerate(t):
            new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edits_between(p, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(p):
        new = [i + 1]
        for j, e in enumerate(t):
            new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_decontamination_against_edit_distance(spark, sf):
    norm = lambda t: " ".join(re.sub(r"[\W_]+", " ", t.lower()).split())
    random.seed(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(5).collect()] + [(900, "short item of text here ok"), (901, None), (902, "ab")]
    rows = []
    for _, t in items[:6]:
        for rate in (0, 0.05, 0.09, 0.13, 0.3):
            x = list(norm(t))
            for _ in range(int(rate * len(x))):
                p = random.randrange(len(x))
                x[p : p + random.randint(0, 1)] = random.choice(["", "a", "b "])
            rows.append((len(rows), "Some words before. " + "".join(x) + " tail"))
    rows += [(len(rows), "the cat ab sat, cab about"), (len(rows) + 1, "x AB, ab y"), (len(rows) + 2, "cab and abb")]
    df = spark.createDataFrame([*rows, (999, None), (998, ""), (0, rows[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in rows for i, v in items[:6] if edits_in(norm(v), norm(t)) <= int(decontaminate.RATE * len(norm(v)))}
    want |= {(d, 902) for d, t in rows if "ab" in norm(t).split()}
    got = decontaminate.search(df, bench, block_chars=600)
    assert len({i for _, i in want}) == 7  # all but the null
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.where("doc_id = 0").count() >= 2
    for r in got.collect():
        item, text = norm(dict(items)[r.item_id]), norm(dict(rows)[r.doc_id])
        assert edits_between(item, text[r.start : r.end]) == edits_in(item, text) == r.edits
    assert decontaminate.search(df, bench.limit(0)).count() == 0 and decontaminate.search(df.limit(0), bench).count() == 0
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == {d for d in df.toPandas()["doc_id"]} - {d for d, _ in want}


def test_decontamination_by_short_items(spark):
    items = [(1, "What is 7 times 8?"), (2, "法国的首都是哪里？"), (3, "Ada"), (4, "?!"), (5, "x"), (6, "日本の首都はどこですか")]
    rows = [
        (10, "He asked: what is 7 times 8? Nobody knew."), (11, "what is 7 timess 8"), (12, "somewhat is 7 times 8"), (13, "What is seven times 8?"),
        (20, "请回答：法国的首都是哪里？谢谢"), (21, "请回答法国的首都是哪里谢谢"), (22, "法国的首都是那里"),
        (30, "ADA, ada; Ada"), (31, "Adam and Canada"), (50, "x-ray"), (51, "xx x"), (52, "X!"), (60, "問題日本の首都はどこでかという"), (70, "?!"), (71, ""),
    ]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.search(df, bench).collect())
    assert got == [(10, 1, 9, 26, 0), (11, 1, 0, 18, 1), (20, 2, 4, 12, 0), (21, 2, 3, 11, 0), (30, 3, 0, 3, 0), (30, 3, 4, 7, 0), (30, 3, 8, 11, 0), (50, 5, 0, 1, 0), (51, 5, 3, 4, 0), (52, 5, 0, 1, 0), (60, 6, 2, 12, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()) == [12, 13, 22, 31, 70, 71]
    barred = sorted((r.doc_id, r.item_id) for r in decontaminate.search(df, bench, alone=3).where("item_id = 5").collect())
    assert barred == [(52, 5)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(df, bench, alone=3).collect()) == [12, 13, 22, 31, 50, 51, 70, 71]


@pytest.mark.parametrize("rate", [0.25, 0.4])
def test_decontamination_without_a_positive_bound(spark, rate):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n)).strip().replace("  ", " ")
    norm = lambda t: " ".join(t.split())
    items, rows = [(i, "k" + word(28) + "l") for i in range(6)], []
    for _, t in items:
        for r in (0, 0.2, 0.3, 0.5):
            x = list(t)
            for p in rng.sample(range(len(x)), int(r * len(x))):
                x[p] = rng.choice("mnopq")
            rows.append((len(rows), norm(word(40) + " " + "".join(x) + " " + word(40))))
    items = [(i, norm(t)) for i, t in items]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in rows for i, v in items if edits_in(v, t) <= int(rate * len(v))}
    assert want and {(r.doc_id, r.item_id) for r in decontaminate.search(df, bench, rate).collect()} == want


def test_warc_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    (tmp_path / "a").mkdir()
    rows = [(3, "http://a b%20\r\n", "x\r\n\r\ny"), (1, None, "x\r\n\r\ny"), (2, "u", None), (5, "v", ""), (None, "w", "only"), (7, "é", "é" * 100_000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in warc.read(spark, path, verify=True).collect()}
    assert {r.url for r in got.values()} == {u for _, u, _ in rows}
    assert (got[3].record_type, got[3].refers_to, got[1].record_type, got[5].refers_to, got[None].record_type) == ("revisit", 1, "response", 2, "response")
    assert got[7].payload == "é" * 100_000 and got[7].payload_digest == base64.b32encode(hashlib.sha1(("é" * 100_000).encode()).digest()).decode()
    hit = warc.read(spark, path, where="record_type = 'revisit' and url like 'http%'")
    assert [r.page_id for r in hit.collect()] == [3] and warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    (tmp_path / "c").mkdir()
    wide = [(1, "http://" + "x" * 70_000, "p"), (2, "http://" + "é y" * 300_000, "p"), (3, "z", "q")]
    warc.write(spark.createDataFrame(wide, "page_id long, url string, html string"), str(tmp_path / "c"))
    assert {(r.page_id, r.url, r.payload) for r in warc.read(spark, str(tmp_path / "c"), verify=True).collect()} == {(1, wide[0][1], "p"), (2, wide[1][1], None), (3, "z", "q")}
    assert [r.page_id for r in warc.read(spark, str(tmp_path / "c"), payload=False, where="refers_to = 1").collect()] == [2]
    (tmp_path / "b").mkdir()
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_words_split_like_the_pattern():
    texts = ["", " a\tb\x0b\x0c\r\nc ", "\x1ca b", None]
    flat, offsets = words(pa.array(texts, pa.string()))
    got = [flat.to_pylist()[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
    assert got == [re.findall(SPACE, t or "") for t in texts]


def test_a_flipped_payload_byte_fails_the_archive_query(spark, sf):
    out = queries.op6_warc(spark, sf)
    folder = max(glob.glob(f"{tx.shared_folder(spark)}/warc-*"), key=os.path.getmtime)
    for file in glob.glob(f"{folder}/part-*"):
        data, at = open(file, "rb").read(), 0
        while at < len(data):
            size = struct.unpack("<I", data[at + 16 : at + 20])[0]
            raw = bytearray(zlib.decompress(data[at + 24 : at + size - 8], -15))
            if b"WARC-Type: response" in raw and b"Content-Length: 0\r\n\r\n" not in raw:
                break
            at += size
        if at < len(data):
            raw[-5] ^= 1  # the last byte before the two line ends of the record
            packer = zlib.compressobj(1, zlib.DEFLATED, -15)
            packed = packer.compress(bytes(raw)) + packer.flush()
            member = data[at : at + 16] + struct.pack("<II", 32 + len(packed), len(raw)) + packed + struct.pack("<II", zlib.crc32(raw), len(raw))
            with open(file, "wb") as f:
                f.write(data[:at] + member + data[at + size :])
            break
    with pytest.raises(Exception, match="length or digest"):
        out.collect()


def test_archive_folders_by_scheme(tmp_path):
    assert warc._open(str(tmp_path))[1] == str(tmp_path) and warc._open(f"file://{tmp_path}")[1] == str(tmp_path)
    fs, root = warc._open("s3a://bucket/folder?region=us-east-1")
    assert fs.type_name == "s3" and root == "bucket/folder"
