"""Each operator against its definition, with nulls, empty and long texts, repeated rows, empty tables, other columns."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute

from lanewise.llm import anchors, common, decontaminate, jaccard, packing, pii, quality, sharding, suffixes, tokens, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed, n=60):
    """Texts with copies, near copies, shared passages, repeats and oddities."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghiéß", k=rng.randint(1, 7))) for _ in range(400)]
    words += ["The", "of.", "#x", "Ünï", "42", "a-b"]
    make = lambda k: " ".join(rng.choices(words, k=k))
    passage, texts = make(70), []
    for i in range(n):
        kind = i % 10
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind in (2, 3) and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // rng.choice([20, 60]))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind == 4:
            texts.append(make(rng.randint(0, 60)) + "\n" + passage + "\n" + make(rng.randint(0, 60)))
        elif kind == 5:
            line = make(rng.randint(2, 30))
            texts.append("\n".join([line, make(10), line, line, "", " ", line.upper()]))
        else:
            texts.append(make(rng.randint(1, 160)))
    texts += ["", " \t\n", "word", "the the the " * 60, passage, passage, make(3000), "x" * 5000, " a" * 900]
    rows = list(enumerate(texts)) + [(len(texts), None), (None, passage), (3, texts[3]), (3, "other text here")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """With the columns of documents, and others that the operators use inside."""
    full = [(d, t, "en", f"s{(d or 0) % 3}" if (d or 1) % 7 else None, len(t or "")) for d, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    return df.withColumns({"_doc": F.lit("x"), "n": F.lit(1), "spans": F.lit("y"), "kept": F.lit(None).cast("string"), "_text": F.lit(0), "host": F.lit("z")})


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return corpus(request.param)


def test_quality(spark, rows):
    out = quality.quality(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(out, [(d, *brute.measures(t)) for d, t in rows])


def test_quality_hosts(spark):
    """A host of failing documents takes its others with it; small hosts are drawn to the common rate."""
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    rows = [(i, bad if i % 8 else good, "en", "junk", 1) for i in range(80)] + [(100 + i, bad if i % 10 == 0 else good, "en", f"h{i % 8}", 1) for i in range(160)] + [(500, good, "en", None, 1), (501, good, "en", "tiny", 1)]
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0] == (False, False) and out[101] == (False, True) and out[500] == (False, True) and out[501] == (False, True)
    assert all(not kept for failed, kept in out.values() if failed)
    assert quality.beta_prior(0, None, None) == (1.0, 1.0)
    a, b = quality.beta_prior(10, 5_000_000, 3_000_000)
    assert a / (a + b) == pytest.approx(0.5) and a * (a + 1) / ((a + b) * (a + b + 1)) == pytest.approx(0.3)
    kept = quality.kept_documents(frame(spark, [(1, good), (2, bad)]))
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_word_dedup(spark, rows):
    out = anchors.dedup_words(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    same(out, brute.dedup_words(rows))


def test_difference_cover():
    differ = {(a - b) % anchors.PERIOD for a in anchors.COVER for b in anchors.COVER}
    assert differ == set(range(anchors.PERIOD))


def test_byte_dedup(spark, rows):
    out = suffixes.dedup_bytes(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    same(out, brute.dedup_bytes(rows))


def test_classes_in_any_batches():
    """The state between batches: every split of the sorted rows gives the same places."""
    rng = np.random.default_rng(1)
    n = 400
    k, u, text = rng.integers(0, 40, n), rng.integers(0, 3, n), rng.integers(0, 9, n)
    a = rng.integers(0, 4, n) * 10
    kind = np.where(rng.random(n) < 0.1, anchors.TELL, anchors.ASK).astype(np.int8)
    order = np.lexsort((a, text, u, k))
    cols = [k[order], u[order], text[order], a[order].astype(np.int32), (a[order] + 5).astype(np.int32), kind[order]]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "u", "_text", "a", "b", "kind"])

    def places(batches):
        return {tuple(r.values()) for out in suffixes._classes(iter(batches)) for r in out.to_pylist()}

    want = places([whole])
    for size in (1, 2, 3, 7, 50):
        assert places([whole.slice(i, size) for i in range(0, n, size)]) == want
    # by definition
    asked = {}
    for kk, uu, tt, aa, _, kd in zip(*cols, strict=True):
        asked.setdefault(kk, {}).setdefault(uu, []).append((int(tt), int(aa), kd))
    twins, dense = set(), set()
    for classes in asked.values():
        for members in classes.values():
            if len({m[:2] for m in members}) > 1 or any(m[2] == anchors.TELL for m in members):
                twins |= {m[:2] for m in members if m[2] == anchors.ASK}
    got = {r[:2] for r in want if r[3] == suffixes.TWIN}
    assert got == twins
    several = sum(len(c) for c in asked.values() if len(c) > 1)
    dense = [r for r in want if r[3] == suffixes.DENSE]
    assert 0 < len(dense) <= several


def test_jaccard(spark, rows):
    same(jaccard.jaccard_components(frame(spark, rows)).collect(), brute.components(rows))


def test_signatures_lose_no_partner():
    """Random pairs of similarity >= 3/4 share a signature, at every size; sketches never rule one out."""
    rng = np.random.default_rng(3)
    for size in [1, 2, 3, 4, 6, 9, 15, 25, 40, 80, 150, 400, 1200]:
        for _ in range(12):
            base = rng.integers(1, 1 << 63, size, dtype=np.uint64)
            spare = rng.integers(1, 1 << 63, size + 3, dtype=np.uint64)
            drop, add = int(rng.integers(0, size // 7 + 2)), int(rng.integers(0, size // 7 + 2))
            other = np.concatenate([base[drop:], spare[:add]])
            both = [np.unique(base), np.unique(other)]
            common_size = len(np.intersect1d(*both))
            if not len(both[1]) or 100 * common_size < 75 * (len(both[0]) + len(both[1]) - common_size) or np.array_equal(*both):
                continue
            found = jaccard.Shingles.__new__(jaccard.Shingles)
            found.hash, found.text = np.concatenate(both), np.repeat([0, 1], [len(both[0]), len(both[1])])
            found.size = np.array([len(b) for b in both])
            found.first = np.concatenate([[0], np.cumsum(found.size)])
            key, text = jaccard.signatures(found, 5000)
            assert np.intersect1d(key[text == 0], key[text == 1]).size, (size, drop, add)
            sk = jaccard.Sketches(found)
            bits = jaccard.folded([np.frombuffer(sk.of(i), np.uint64) for i in (0, 1)])
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= sum(found.size) // 7


def test_cells_of_a_large_group(spark):
    """One signature's group of 20,000 nodes that all have other roots: every pair is looked at, in cells of bounded size."""
    n, words = 20_000, 8
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 63, (n, words), dtype=np.uint64)
    twins = {(int(a), int(b)) for a, b in zip(range(0, 2000, 2), rng.permutation(np.arange(2001, n, 2))[:1000])}
    for a, b in twins:
        bits[b] = bits[a]
    table = pa.table({"met": np.zeros(n, np.int64), "node": np.arange(n), "root": np.arange(n), "size": np.full(n, 100), "sketch": [b.tobytes() for b in bits]})
    members = spark.createDataFrame(table.to_pandas())
    got = {tuple(r) for r in jaccard.cells(members).collect()}
    assert got == twins


def test_cells_equal_brute_force(spark, monkeypatch):
    """Groups of one main root and some strays, of many roots, of sketches of several lengths, cut into small cells."""
    monkeypatch.setattr(jaccard, "CELL", 7)
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for met, (n, roots) in enumerate([(60, 1), (40, 3), (30, 30), (2, 2), (90, 5)]):
        node = np.arange(n) + 1000 * met
        root = node[rng.integers(0, roots, n)] if roots < n else node
        root[0], root[1] = node[0], node[1]
        bits = [np.zeros(int(w), np.uint64) if i % 2 else np.full(int(w), (1 << 64) - 1, np.uint64) for i, w in enumerate(rng.choice([4, 8], n))]
        rows += [(met, int(a), int(r), 50, b.tobytes()) for a, r, b in zip(node, root, bits)]
        want |= {(int(node[i]), int(node[j])) for i in range(n) for j in range(i + 1, n) if root[i] != root[j] and i % 2 == j % 2 and len(bits[i]) == len(bits[j])}
    got = {tuple(r) for r in jaccard.cells(spark.createDataFrame(rows, "met bigint, node bigint, root bigint, size bigint, sketch binary")).collect()}
    # sketches of other lengths are folded, so such pairs may come besides
    assert want <= got and all(a < b for a, b in got)


def test_gathered_keeps_every_pair(spark):
    """Nested groups of one centre become one; a hub's groups that have nothing else in common stay apart."""
    nested = [(m, sorted({0, *range(1 + m % 3, 30)})) for m in range(20)]
    hub = [(100 + m, [1000, *range(2000 + 50 * m, 2050 + 50 * m)]) for m in range(20)]
    rows = [(m, x, x % 7) for m, g in [*nested, *hub, (900, [1, 2, 3])] for x in g]
    mixed = spark.createDataFrame([(m, len(g), g[0]) for m, g in nested + hub], "met bigint, n bigint, lead bigint")
    out = jaccard.gathered(spark.createDataFrame(rows, "met bigint, node bigint, root bigint"), mixed, len(rows)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["met"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [30] + [51] * 20 and len(out) == 30 + 51 * 20


@pytest.mark.parametrize("share", [0.02, 0.12, 0.3])
def test_jaccard_of_near_copies(spark, share):
    """Near copies of two bases that differ in a share of their words: most, some or few are linked; two bases that share a
    passage; strays that share one with the copies."""
    rng = np.random.default_rng(17)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 1 << 40, n)]
    one = words(120)
    bases, rows = [one, one[:70] + words(50)], []
    for i in range(60):
        base = list(bases[i % 2])
        for at in np.flatnonzero(rng.random(len(base)) < share * (0.2 + i % 5 / 4) / 5):
            base[at] = f"x{i}.{at}"
        rows.append((3 * i, " ".join(base)))
    rows += [(3 * i + 1, " ".join(words(60) + one[10 * i : 10 * i + 40] + words(40))) for i in range(8)]
    rows += [(1000 + i, " ".join(one[: 120 - i])) for i in range(0, 60, 3)] + [(2000, rows[4][1]), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    sets = {d: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {d: find(d) for d in sets}


def test_exchange_tells_what_chunks_decided():
    """A key that several nodes of a chunk have is told once; those nodes travel on, dealt over the buckets."""
    n = 5000
    key = np.concatenate([np.full(n, 7, np.uint64), np.array([9, 11], np.uint64)])
    parcels, several = jaccard._parcels(key, np.arange(n + 2), 64)
    assert several[:n].all() and not several[n:].any()
    rows = parcels.to_pylist()
    assert sum(len(r["tells"]) for r in rows) == 4 and sum(len(r["values"]) for r in rows) == 8
    assert max(len(r["owners"]) for r in rows) < 3 * 8 * n / 64
    other, _ = jaccard._parcels(np.array([7, 9, 13], np.uint64), np.array([90001, 90002, 90003]), 64)
    merged = pa.Table.from_batches([parcels, other])
    found = {}
    for b in set(merged["bucket"].to_pylist()):
        part = merged.filter(pa.array([x == b for x in merged["bucket"].to_pylist()]))
        for m, node in zip(*(c.to_pylist() for c in jaccard._groups(part).columns)):
            found.setdefault(m, set()).add(node)
    assert sorted(map(len, found.values())) == [2, n + 1] and {n, 90002} in found.values()


def test_near_copies_are_few_members(spark):
    """Groups by the signatures of 200 near copies, besides a hub's and some pairs: every pair of a group is in a group of
    the result, which has a few rows for each node and not one for each signature."""
    rng = np.random.default_rng(11)
    groups = [np.flatnonzero(rng.random(200) < 0.6) for _ in range(150)] + [np.sort(rng.choice(200, 2, False)) for _ in range(300)]
    groups += [np.array([1000, *range(2000 + 50 * m, 2050 + 50 * m)]) for m in range(20)] + [np.array([5000 + m, 7000 + m]) for m in range(9)]
    key, node = np.repeat(np.arange(len(groups)), [len(g) for g in groups]), np.concatenate(groups)
    parcels, _ = jaccard._parcels(jaccard.mix(key.astype(np.uint64)), node, 8, most=1 << 20)
    part, _ = jaccard._parcels(jaccard.mix(np.full(3, 9999, np.uint64)), np.array([8000, 8001, 8002]), 8)
    rows = spark.createDataFrame([tuple(r.values()) for r in [*parcels.to_pylist(), *part.to_pylist()]], jaccard.PARCELS)
    led = rows.groupBy("bucket").applyInArrow(jaccard._led, jaccard.LED).groupBy("lead", "node").agg(F.collect_list("met").alias("mets"), F.sum("pairs").alias("pairs"))
    found = {}
    for r in jaccard.united(led).collect():
        found.setdefault(r["met"], []).append(r["node"])
    pairs = {(a, b) for g in found.values() for a in g for b in g}
    assert all(len(set(g)) == len(g) for g in found.values()) and {8000, 8001, 8002} in map(set, found.values())
    assert all((a, b) in pairs for g in groups for a in g for b in g)
    assert sum(map(len, found.values())) < 2 * len(np.unique(node)) < len(node) / 8


def test_hot_join_deals_out_hot_keys(spark):
    n, keep = 100_000, {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(keep, ("false", "-1", "8")):
            spark.conf.set(c, v)
        left = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000).alias("k"))
        right = common.stage(left.filter("k < 19000").groupBy("k").agg(F.count("*").alias("n"), (F.first("k") * 2).alias("twice")), "right")
        for how, rows in (("inner", left.filter("k < 19000").count()), ("left", n)):
            out = common.hot_join(left, right, "k", "n", n, how).withColumn("p", F.spark_partition_id())
            per = [r["count"] for r in out.groupBy("p").count().collect()]
            assert sum(per) == rows and max(per) < 2 * rows / 8 and not out.filter("twice != 2 * k or (twice is null and k < 19000)").count()
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_decontamination(spark, rows):
    rng = random.Random(9)
    long = [t for _, t in rows if t and len(t.split()) > 60][:6]
    items = [(i, " ".join(t.split()[5 : 5 + rng.choice([3, 13, 14, 30])]).upper() + "!") for i, t in enumerate(long)] + [(90, None), (91, " ?"), (None, "word"), (10, "The of")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.verdicts(decontaminate.contamination(frame(spark, rows), bench)).collect()
    same(out, brute.contamination(rows, items))
    assert any(r["contaminated"] for r in out)


def test_decontamination_in_sets(spark, monkeypatch):
    rows = [(1, "a b c d e f"), (2, "c d x y"), (3, None), (4, "q")]
    items = [(1, "a b"), (2, "b c"), (3, "y"), (4, "d e")]
    monkeypatch.setattr(decontaminate, "WORDS_PER_SET", 2)
    out = decontaminate.verdicts(decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    same(out, brute.contamination(rows, items))
    none = decontaminate.contamination(frame(spark, rows), spark.createDataFrame([], "item_id bigint, text string"))
    assert [r["n_hit"] for r in decontaminate.verdicts(none).collect()] == [0] * 4


def test_decontamination_in_sets_tells_rows_of_one_id_apart(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WORDS_PER_SET", 3)
    items, rows = [(1, "one two three"), (2, "four five six")], [(None, "one two three"), (None, "no hit here"), (4, "four five six"), (4, "not this one")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(repr((r["doc_id"], r["items"])) for r in got) == sorted(map(repr, [(None, ["1"]), (None, []), (4, ["2"]), (4, [])]))


def test_pii_base(spark, rows):
    odd = rows + [
        (900, "a@b@c.de x@y.z_c@d.org 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 é 4111 1111-1111 1111 +1((((2)34567890) +12"),
        (901, "a" * 20000 + "@ 1 " * 300 + "é@x.y " + "1." * 900 + " 4111111111111111x4111111111111111+4 9 30 12 34 567"),
        (902, "+49 30 1234567 00001.2.3.4 12.34.56.78.90 me@x-.y-.z"),
    ]
    out = {(r["_doc"], r["_text"]): r for r in pii.pii_spans(frame(spark, odd)).select("_doc", "_text", "base").collect()}
    keys = {(r["_doc"], r["_text"]): r["text"] for r in common.keyed(frame(spark, odd)).collect()}
    assert set(out) == set(keys)
    for key, text in keys.items():
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in out[key]["base"]] == brute.pii(text)


def test_pii_learns_contexts(spark):
    hexes = ["%040x" % (i * 7919 + 12345) for i in range(12)]
    rows = [(i, f'some words here token = "{h}" and more') for i, h in enumerate(hexes)] + [(50, 'again token = "Zx81QqP00471kkaa9" end'), (51, "plain 12345678 words"), (52, "mail me@x.org or +49 30 1234567 now")]
    df = frame(spark, rows)
    found = {r["_doc"]: [(pii.KINDS[s["kind"]], rows[[d for d, _ in rows].index(r["_doc"])][1][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.pii_spans(df).collect()}
    assert found[50] == [("secret", "Zx81QqP00471kkaa9")] and found[51] == [] and found[0] == [("secret", hexes[0])]
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert clean[52]["text"] == "mail <EMAIL> or <PHONE> now" and clean[52]["n_chars"] == len(clean[52]["text"]) and clean[51]["text"] == rows[13][1]
    assert pii.redact(df).columns == df.columns


def test_pii_secrets_without_words_between(spark):
    one, two = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    rows = [(1, f"{one} is first"), (2, f"id 12 {two}"), (3, f"{one}\n{two}")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    found = {r["_doc"]: [(pii.KINDS[s["kind"]], dict(rows)[r["_doc"]][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.pii_spans(df).collect()}
    assert found == {1: [("secret", one)], 2: [("secret", two)], 3: [("secret", one), ("secret", two)]}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} == {1: "<SECRET> is first", 2: "id 12 <SECRET>", 3: "<SECRET>\n<SECRET>"}


def test_pii_many_matches_in_one_text(spark):
    """Places, contexts and redaction of 100,000 matches in one text take seconds, not the square of their number."""
    import time

    parts = [f"mail u{i}@host{i % 7}.org or é call +49 30 {1000000 + i} now" for i in range(50_000)]
    text = "\n".join(parts)
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "no such thing", "en", "s", 13)], SCHEMA)
    start = time.time()
    found = {r["_doc"]: r["spans"] for r in pii.pii_spans(df).collect()}
    assert len(found[1]) == 100_000 and not found[2]
    assert {text[s["start"] : s["end"]] for s in found[1]} == {x for i in range(50_000) for x in (f"u{i}@host{i % 7}.org", f"+49 30 {1000000 + i}")}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] == "\n".join(["mail <EMAIL> or é call <PHONE> now"] * 50_000) and time.time() - start < 120


def test_packing(spark, rows):
    df = frame(spark, rows)
    got = [r.asDict() for r in packing.pack(df, window=64).collect()]
    vocabulary = tokens.Vocabulary.at(tokens.vocabulary_path())
    want = []
    for d, t in rows:
        ids = np.array((vocabulary.exact.encode(t, add_special_tokens=False).ids if t else []) + [0], "<u4")
        want += [(d, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    same([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got], want)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        assert sum(n for _, n in parts) <= 64 and [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
    assert sum(r["length"] for r in got) >= 0.9 * 64 * len(used)


def test_plan_uses_every_piece():
    rng = np.random.default_rng(0)
    for _ in range(20):
        histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 30), rng.integers(1, 500, 30))}
        plan = packing.plan(histogram, 64)
        used = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(k * n for k, n in pattern) <= 64
            used.update({k: n * times for k, n in pattern})
        assert used == Counter(histogram)


def test_fast_ids_equal_the_library():
    v = tokens.Vocabulary.at(tokens.vocabulary_path())
    for start in range(0, 0x3000, 7):
        s = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 '{chr(c)} \n{chr(c)} .{chr(c)}  {chr(c)}" for c in range(start, min(start + 7, 0x3000)))
        assert v.ids(s) == v.exact.encode(s, add_special_tokens=False).ids
    assert v.ids("x<|endoftext|>y") == v.exact.encode("x<|endoftext|>y", add_special_tokens=False).ids


def test_very_long_white_space(spark):
    v = tokens.Vocabulary.at(tokens.vocabulary_path())
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "x \n" * 5), (4, " " * tokens.LONG_WHITE), (5, "<|endoftext|>" + "\t" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {d: len(v.exact.encode(t, add_special_tokens=False).ids) for d, t in rows}
    assert {r["doc_id"]: r["doc_tokens"] - 1 for r in packing.pack(df).collect()} == want
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_edited(tokens.with_line_edits(df)).collect()}
    assert got == want | {5: len(v.ordinary.encode(rows[4][1], add_special_tokens=False).ids)}


def test_packing_deals_out_repeated_rows(spark):
    """One row, many times: every bucket has its share, and each copy its own place."""
    df = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("the same words").alias("text"))
    got = packing.pack(df, window=64, rows_per_bucket=100).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3000 and len({r["length"] for r in got}) == 1


def test_many_edits_in_one_sweep():
    pre, rng = tokens.Pretokens(tokens.vocabulary_path()), random.Random(8)
    text = "".join(rng.choice(["word ", "  ", "\n\n", "a1 ", "'s", " über ", "%%", "x" * 9, "\n  "]) for _ in range(9000))
    for _ in range(12):
        cuts = sorted(rng.sample(range(len(text)), 2 * rng.choice([1, 3, 40, 700])))
        edits = [(a, b if rng.random() < 0.7 else a, rng.choice(["", "\n", " new words ", "  ", "q"])) for a, b in zip(cuts[::2], cuts[1::2])]
        want, at = [], 0
        for a, b, new in edits:
            want += [text[at:a], new]
            at = b
        tree, whole = pre.tree(text), "".join([*want, text[at:]])
        text, encoded = pre.edit_all(text, tree, edits)
        assert text == whole and tree.count == pre.count(text) and sum(tree.chars) == len(text) and encoded <= len(text)
        assert tree.sums[1] == sum(tree.counts())
    tree = pre.tree(text)
    gone, _ = pre.edit_all(text, tree, [(0, len(text), "")])
    assert gone == "" and tree.count == 0 and tree.chars == []
    far = pre.tree(long := "some words here " * 5000)
    assert pre.edit_all(long, far, [(10, 12, "y"), (70_000, 70_001, "")])[1] < 4000


def test_edit_aware_counts(spark, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary_path())
    own.encode_special_tokens = True
    count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    pre = tokens.Pretokens(tokens.vocabulary_path())
    rng = random.Random(2)
    for _, text in rows:
        text = (text or "")[:6000]
        tree = pre.tree(text)
        assert tree.count == count(text)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 9, 400]))
            text, _ = pre.edit(text, tree, a, b, rng.choice(["", "\n", "\n\n", " ", "  x", "the\n\n  ", "'s", " 12", "%%% ", "a" * 30, " w" * 200, "<|endoftext|>", "\x1c "]))
            assert tree.count == count(text) and sum(tree.chars) == len(text)
    out = tokens.count_edited(tokens.with_line_edits(frame(spark, rows))).collect()
    kept = lambda t: "".join(x for i, x in enumerate((t or "").split("\n")) for x in [("\n" if i else "") + x] if not (x.strip("\n").strip() and x.lstrip("\n") in (t or "").split("\n")[:i]))
    same([(r["doc_id"], r["n_tokens"], r["n_tokens_after"]) for r in out], [(d, count(t or ""), count(kept(t))) for d, t in rows])


def test_warc(spark, tmp_path):
    rows = [(1, "u", "äö" * 20000), (2, "u", "äö" * 20000), (3, None, None), (4, "x\r\ny", ""), (4, "z", ""), (None, "q", "w"), (7, "q", "w"), (8, "q é", "w"), (9, "r", "a\r\n\r\nWARC/1.1\r\n"), (10, "s", "x" * 16000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"_h": F.lit(1), "origin": F.lit("o")})
    warc.write_archives(pages, f"file://{tmp_path}/w", segment_bytes=1000, chunk_bytes=300)
    got = warc.payloads(spark, f"file://{tmp_path}/w").collect()
    key = lambda p: -1 if p is None else p
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), key(p))
    want = [(p, len((h or "").encode()), warc.sha1((h or "").encode()), *(("response", None) if key(p) == last[h or ""] else ("revisit", last[h or ""]))) for p, _, h in rows]
    same(got, want)
    with pytest.raises(ValueError):
        warc.assemble([{"segment": 1, "total": None, "block": b"ab"}, {"segment": 3, "total": 4, "block": b"cd"}])
    with pytest.raises(ValueError):
        warc.assemble([{"segment": 1, "total": None, "block": b"ab"}, {"segment": 2, "total": 5, "block": b"cd"}])
    assert warc.unchunked(warc.chunked(b"q" * 700, 256)) == b"q" * 700
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.payloads(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_repeated_rows_and_missing_responses(spark, tmp_path):
    long = "lorem ipsum " * 3000
    rows = [(5, "u", long)] * 40 + [(4, "u", long), (None, None, long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder, segment_bytes=1000)
    got = warc.payloads(spark, folder).collect()
    assert sum(r["record_type"] == "response" for r in got) == 40 and [r["refers_to"] for r in got if r["record_type"] == "revisit"] == [5, 5]
    parts = warc.read_archives(spark, folder).filter("segment is not null").groupBy("origin").count().collect()
    assert len(parts) == 40 and len({r["count"] for r in parts}) == 1
    lone = next(warc.records(1, 0, "u", b"x", (2, 1), 1000, 100)) + b"\r\n\r\n"
    (tmp_path / "lone").mkdir()
    (tmp_path / "lone" / "a.warc").write_bytes(lone)
    with pytest.raises(Exception, match="no response in the archives"):
        warc.payloads(spark, f"file://{tmp_path}/lone").collect()


def test_sharding(spark, rows):
    out = [r.asDict() for r in sharding.shard_by_splitters(frame(spark, rows), shards=5).collect()]
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in out], [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows])
    held = {}
    for r in out:
        held.setdefault(r["shard"], []).append(r)
    top = max(r["size"] for r in out)
    total = sum(r["size"] for r in out)
    for parts in held.values():
        assert sorted(r["slot"] for r in parts) == list(range(len(parts)))
        assert abs(sum(r["size"] for r in parts) - total / 5) <= 2 * top
    bounds = [(min((r["doc_id"] if r["doc_id"] is not None else -1) for r in held[s]), max((r["doc_id"] if r["doc_id"] is not None else -1) for r in held[s])) for s in sorted(held)]
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_sharding_splits_a_hot_key(spark):
    """Over a third of the rows under one key, with the same text: many ranges, equal shards."""
    df = spark.range(6000).select(F.when(F.col("id") % 5 < 2, 7).otherwise(F.col("id")).cast("bigint").alias("doc_id"), F.lit("abcd").alias("text"))
    sizes = sharding.shard_by_splitters(df, rows_per_range=100).groupBy("shard").count().collect()
    assert {r["count"] for r in sizes} == {250} and len(sizes) == 24


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    for out in (
        quality.quality(none), anchors.dedup_words(none), jaccard.jaccard_components(none), packing.pack(none), suffixes.dedup_bytes(none), pii.pii_spans(none), pii.redact(none),
        decontaminate.verdicts(decontaminate.contamination(none, bench)), sharding.shard_by_splitters(none), tokens.count_edited(tokens.with_line_edits(none)),
    ):
        assert out.count() == 0
