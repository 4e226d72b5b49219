"""The pipeline against its stages' definitions."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute
from test_corpus_operators import SCHEMA, corpus

import corpus_pipeline
from lanewise.llm import packing, pii, quality, tokens

PARTS = "Contact pat.lee@mail.example.org or +49 30 1234567 about 4111 1111 1111 1111 from 10.0.0.7 now"


def rows_of():
    rows = [(d, t) for d, t in corpus(4, 80) if d is not None and d != 3]
    long = [t for _, t in rows if t and len(t.split()) > 60]
    rows += [(200, long[0] + "\n" + PARTS), (201, None), (202, long[1])]
    bench = [(1, " ".join(long[2].split()[:30])), (2, "unheard of words here")]
    return [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    rows, bench = rows_of()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    rows, bench = rows_of()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality"](spark, docs, folder)
    ok = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == ok and one.columns == docs.columns and ok < {r[0] for r in rows}
    assert not [d for d, t, *_ in rows if d in ok and brute.measures(t)[-1]]
    two = stages["near_duplicates"](spark, one, folder)
    left = [(d, t) for d, t, *_ in rows if d in ok]
    firsts = {d for d, _, c in brute.components(left) if d == c}
    assert {r["doc_id"] for r in two.collect()} == firsts < ok
    three = stages["decontamination"](spark, two, folder)
    clean = {r[0] for r in brute.contamination([(d, t) for d, t in left if d in firsts], bench) if not r[-1]}
    assert {r["doc_id"] for r in three.collect()} == clean < firsts and three.columns == docs.columns
    four = {r["doc_id"]: r for r in stages["pii"](spark, three, folder).collect()}
    assert set(four) == clean
    for d, t in left:
        if d in clean:
            assert not brute.pii(four[d]["text"]) and four[d]["n_chars"] == len(four[d]["text"])
            assert brute.pii(t) or four[d]["text"] == t
    five = stages["packing"](spark, stages["pii"](spark, three, folder), folder).collect()
    vocabulary = tokens.Vocabulary.at(tokens.vocabulary_path())
    sizes = {d: len(vocabulary.exact.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in four.items()}
    got = {}
    for r in five:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, five))


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        assert out.count() == 0


def test_other_columns_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"_doc": F.lit("a"), "row": F.lit(1), "spans": F.lit(2), "note": F.col("doc_id") * 2})
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, folder)
        assert out.columns == docs.columns and out.filter("note = doc_id * 2 and _doc = 'a' and spans = 2").count() == out.count() > 0


def test_one_of_each_component_whatever_the_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    other = lambda k: " ".join([*(f"v{i}" for i in range(59)), f"y{k}"])
    rows = [(None, near(1)), (None, near(2)), (None, near(2)), (None, None), (None, None), (None, " "), (5, other(1)), (5, other(2)), (9, other(3)), (7, ""), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()]
    worded = [(d, t.split()[0]) for d, t in got if t and t.strip()]
    assert sorted(map(repr, worded)) == sorted(map(repr, [(None, "w0"), (5, "v0")]))
    assert sorted(repr(x) for x in got if not (x[1] or "").strip()) == sorted(repr(x) for x in rows if not (x[1] or "").strip())


def test_layout_ignores_the_order_of_rows(spark):
    """Pieces get the same places whatever partitions their rows come from, and rows repeated beyond a bucket get places too."""
    rows = [(d, f"words of text {d % 7} " * (1 + d % 5), "en", "s", 1) for d in range(60)] + [(900, "the same", "en", "s", 1)] * 25
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = (sorted(map(tuple, packing.pack(x, 64, rows_per_bucket=10).collect())) for x in (docs.repartition(1), docs.orderBy(F.desc("doc_id")).repartition(5)))
    assert one == two and len(one) >= len(rows) and len({r[-2:] for r in one}) == len(one)


def test_only_texts_that_may_have_spans_are_joined(spark):
    docs = spark.createDataFrame([(d, f"call +49 30 123456{d % 10} now" if d % 3 else "nothing here", "en", "s", 1) for d in range(30)], SCHEMA)
    out = pii.redact(docs)
    assert "SortMergeJoin" in out._jdf.queryExecution().sparkPlan().toString() and {r["text"] for r in out.collect()} == {"call <PHONE> now", "nothing here"}
