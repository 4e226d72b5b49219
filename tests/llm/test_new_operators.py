"""Spelling variants and toxicity against their definitions, with nulls, long texts, ties, repeats, empty tables."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import decontaminate, pii, toxicity, variants

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    """With the columns of documents, and others that the operators use inside."""
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(3)
    return df.withColumns({"word": F.lit("x"), "n": F.lit(1), "key": F.lit("y"), "toxic": F.lit(1), "score": F.lit("z")})


def runs(text):
    return [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def counted(rows):
    out = Counter()
    for d, text in rows:
        for w in runs(text):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def grouped(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def spelt(rng):
    stems = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(25)] + ["x" * 300, "ÿÀÐ" * 3]
    words = []
    for stem in stems:
        for k in range(rng.randint(1, 5)):
            w = stem
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words += [w.upper() if rng.random() < 0.1 else w] * rng.choice([1, 5, 6, 40, 200, 1100])
    rng.shuffle(words)
    rows, at = [], 0
    while at < len(words):
        step = rng.randint(1, 60)
        rows.append((len(rows), rng.choice([" ", ", ", "-", "9"]).join(words[at : at + step])))
        at += step
    return rows + [(None, "abcabc abcabc"), (2, rows[3][1]), (2, rows[3][1]), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "·€ " * 400)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed, monkeypatch):
    rows = spelt(random.Random(seed))
    words = variants.word_counts(frame(spark, rows))
    assert {r["word"]: r["n"] for r in words.collect()} == counted(rows)
    want = grouped({w: n for w, n in counted(rows).items() if n >= 5})
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)
    kept = spark.createDataFrame([(r[0], r[3]) for r in want], "word string, n bigint")
    assert sorted(map(tuple, variants.spelling_variants(kept).collect())) == want
    # groups of words that a reduced word stands for, cut by larger alphabets
    monkeypatch.setattr(variants, "CELL", 4)
    assert sorted(map(tuple, variants.spelling_variants(kept).collect())) == want
    assert sorted(map(tuple, variants.spelling_variants(kept, alphabets=(2, 3, 0)).collect())) == want


def test_neighbourhoods():
    """All alphabets: a pair at one edit meets from exactly one side, or is one reduced word."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(250)})
    pairs = [(a, b) for a in range(len(words)) for b in range(a) if one_edit(words[a], words[b])]
    for alphabet in (2, 8, 0):
        keys = variants._keys(words, alphabet)
        to, of = variants.neighbours(words, alphabet)
        assert len(set(zip(to.tolist(), of.tolist()))) == len(to)
        given = {(int(t), int(o)) for t, o in zip(to, of)}
        for a, b in pairs:
            assert keys[a] == keys[b] or ((int(keys[a]), b) in given) != ((int(keys[b]), a) in given)


def test_empty_vocabulary(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert variants.spelling_variants(variants.word_counts(none)).count() == 0


def texts(rng, n):
    plain = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(300)]
    bad = ["grumblex", "snarfoid", "blorkish"]
    out = []
    for d in range(n):
        words = rng.choices(plain, k=rng.randint(1, 200))
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad).title())
        out.append((d, " ".join(words), int(toxic)))
    return out


def test_toxicity(spark):
    rows = texts(random.Random(5), 1500)
    docs = frame(spark, [(d, t) for d, t, _ in rows] + [(None, "grumblex"), (5000, None), (5001, ""), (7, rows[7][1]), (5002, "a" * 3_000_000 + " blorkish")])
    labels = spark.createDataFrame([(d, 1, x) for d, _, x in rows] + [(None, 0, 1), (3, 0, None), (9999, 0, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels, sample=400, features=500)
    out = toxicity.toxicity(docs, model).withColumn("held", toxicity.held_out()).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in out)
    truth = {d: x for d, _, x in rows}
    assert all(r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held"] and r["doc_id"] in truth]
    right = sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[5000] == scores[5001] < 0.5 and scores[5002] > scores[5001]
    assert len({r["score"] for r in out if r["doc_id"] == 7}) == 1


def test_toxicity_never_learns_held_out_labels(spark):
    rows = texts(random.Random(6), 300)
    docs = frame(spark, [(d, t) for d, t, _ in rows])
    flip = lambda on: spark.createDataFrame([(d, x ^ (on and zlib.crc32(str(d).encode()) % 5 == 0)) for d, _, x in rows], "doc_id bigint, toxic int")
    one, two = (toxicity.fit(docs, flip(on), sample=200, features=300) for on in (False, True))
    assert one.intercept == two.intercept and np.array_equal(one.weights, two.weights)


def test_class_counts(spark):
    rows = texts(random.Random(7), 40) + [(99, "", 1), (100, "Ünïcode  \n😀", 0)]
    df = spark.createDataFrame([(x, t) for _, t, x in rows], "toxic int, text string").repartition(5)
    counts, n = toxicity.class_counts(df)
    assert n.tolist() == [sum(x == k for *_, x in rows) for k in (0, 1)]
    grams, want = toxicity.Grams(), np.zeros_like(counts)
    for _, t, x in rows:
        want[x, grams(t)] += 1
        whole = re.sub(r"\s", " ", f" {t.lower()} ")
        assert abs(len({whole[i : i + k] for k in (3, 4, 5) for i in range(len(whole) - k + 1)}) - len(grams(t))) <= len(grams(t)) // 50
    assert np.array_equal(counts, want)
    ratios = toxicity.log_count_ratios(np.array([[1, 3], [4, 0]]))
    assert np.allclose(ratios, [np.log((5 / 6) / (2 / 6)), np.log((1 / 6) / (4 / 6))])


def test_regression_is_at_its_minimum():
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(200)]
    toxic, scales, weight = (rng.random(200) < 0.3).astype(int), rng.normal(size=30), rng.random(200) + 0.5
    w, b = toxicity.regression(rows, toxic, scales, weight, 0.5)
    x = np.zeros((200, 30))
    for k, r in enumerate(rows):
        x[k, r] = scales[r]
    slope = x.T @ (weight * (1 / (1 + np.exp(-(x @ w + b))) - toxic)) + 0.5 * w
    assert np.abs(slope).max() < 1e-2


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 0), (2, 0), (3, 0), (4, 0)], 0.0), ([(k, 1) for k in range(20)], 1.0)])
def test_toxicity_without_both_labels(spark, labels, score):
    docs = frame(spark, [(k, "some text") for k in range(20)])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {r["score"] for r in toxicity.toxicity(docs, model).collect()} == {score}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_templates_share_a_bucket():
    """All windows of a template begin and end alike; the tables are built and asked in time linear in their number."""
    matcher = decontaminate.WuManber(13)
    windows = [[b"a", b"b", b"c", *[b"w%d" % (k // 10**j % 10) for j in range(7)], b"x", b"y", b"z"] for k in range(100_000)]
    began = time.time()
    for k, window in enumerate(windows):
        matcher.add(window, k % 7)
    spans, items = [], set()
    matcher.search([b"q", *windows[54_321], b"q", *windows[7][:12]], spans, items)
    assert spans == [(1, 14)] and items == {54_321 % 7} and time.time() - began < 20
    assert len(matcher.bucket) == 1


def test_contexts_reach_as_far_as_asked(spark):
    """Long words before a mention: within 80 code points the contexts are one, farther they differ."""
    tail = "w" * 90
    rows = [(k, f"{'ab'[k % 2]}{tail} {'seed' + str(k) + '@mail.org' if k < 6 else 'code-' + str(k) * 4}") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = lambda p: {r["_doc"] for r in pii.pii_spans(df, p).collect() if any(s["kind"] == 0 for s in r["spans"])}
    # half of a context's instances are addresses, under a trust of 0.5 its others are too
    assert found(pii.PiiParams(support=6, trust=0.5)) == set(range(12))
    assert found(pii.PiiParams(support=6, trust=0.5, reach=200)) == set(range(6))
