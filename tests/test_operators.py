"""Operators on hand-made rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.functions import scalars as S
from lanewise.kernels import signal as ks
from lanewise.operators import calls as C
from lanewise.operators import matrices as M
from lanewise.operators import samples as P
from lanewise.operators import traces as T
from lanewise.params import PipelineParams


def reads(spark, *lists):
    rows = [(t, i, q) for t, qs in enumerate(lists) for i, q in enumerate(qs)]
    return spark.createDataFrame(rows, "trace_id int, ordinal bigint, phred int")


def best(qs, q, window=20):
    """Brute force: the largest sum, of equals the first end and then the latest start."""
    n = len(qs)
    if n < window:
        return (0, n) if np.mean(qs) >= q else (0, 0)
    top = max(((sum(x - q for x in qs[i:j]), -j, i) for j in range(1, n + 1) for i in range(j)))
    return (top[2], -top[1]) if top[0] > 0 else (0, 0)


def test_segments_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    lists = [rng.integers(15, 26, int(n)).tolist() for n in rng.integers(1, 45, 60)] + [[10, 30, 30, 5, 40], [30] * 19, [30] * 20, [5] * 25]
    got = {r[0]: (r[1], r[2]) for r in C.window_trim(reads(spark, *lists)).collect()}
    assert got == {t: best(qs, 20.0) for t, qs in enumerate(lists)}
    assert [tuple(r) for r in C.window_trim(reads(spark, [10, 30, 30, 5, 40]), 20, 1).collect()] == [(0, 1, 5)]


def test_end_trim(spark):
    got = [tuple(r)[1:] for r in C.end_trim(reads(spark, [5, 20, 3, 20, 5], [1, 2])).orderBy("trace_id").collect()]
    assert got == [(1, 4), (0, 0)]


@given(st.text("ACGTNacgtnR", max_size=30))
@settings(max_examples=15, deadline=None)
def test_reverse_complement_is_an_involution(s):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session yet")
    row = spark.range(1).select(S.reverse_complement(F.lit(s)).alias("r"), S.reverse_complement(S.reverse_complement(F.lit(s))).alias("b")).first()
    assert row["b"] == s and row["r"] == s.translate(str.maketrans("ACGTacgtNn", "TGCAtgcaNn"))[::-1]


def primer_by_hand(s, p, most=2, limit=80):
    found = [(sum(a != b and "N" not in (a, b) for a, b in zip(p, s.upper()[i : i + len(p)])), i) for i in range(min(len(s) - len(p) + 1, limit))]
    return min(found)[1] + len(p) if found and min(found)[0] <= most else 0


def test_primer(spark):
    cases = ["GACT" * 10, "TTGACGTACCC", "A" * 79 + "GACGTA", "A" * 80 + "GACGTA", "GA", "", "TTNACGNATT", "ccgacgtacc"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(S.trim_primer(F.col("s"), "GACGTA", 1).getField("cut")).collect()]
    assert got == [primer_by_hand(c, "GACGTA", 1) for c in cases]


def test_numbers(spark):
    values = [2.25, 87.65, 1234.55, 0.05, 99.95, 1e6 + 0.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(S.one_decimal(F.col("x"))).collect()] == [f"{v:.1f}" for v in values]


def test_phred_by_hand(spark):
    rows = [(1.0, 1.0, 0.0, 0.0, 1.0), (100.0, 2.0, 1.0, 1.0, 0.1), (3.0, 1.2, 0.5, 0.5, 0.8), (2.0, 1.1, 2.0, -1.0, 0.9)]

    def want(snr, iso, shape, spacing, f):
        from math import log10

        base = min(max(20 * log10(max(snr, 1)) + 18, 0), 40)
        pen = 3.0 if iso < 1.05 else 1.5 * (1.25 - iso) / 0.2 if iso < 1.25 else 0
        pen += 1.5 * (1 - min(max(shape, 0), 1)) + (1 - min(max(spacing, 0), 1))
        pen += 6 * (f - 0.88) / 0.12 if f > 0.88 else 2.5 * (f - 0.75) / 0.13 if f > 0.75 else 0
        return min(max(round(base - pen), 5), 40)

    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert [r[0] for r in df.select(S.phred_score(*map(F.col, "abcde"))).collect()] == [want(*r) for r in rows]


def test_clusters(spark):
    df = spark.createDataFrame([(1, p, 0, a) for p, a in ((0, 1.0), (2, 2.0), (4, 3.0), (6, 3.0))], "trace_id int, pos bigint, ch int, amp double")
    got = [tuple(r)[1:] for r in C.resolve(C.clusters(df, 3)).orderBy("cluster").collect()]
    assert got == [(0, 2, 0, 2.0), (1, 4, 0, 3.0)]


def test_twins_of_array_and_window_forms(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 60, (4, 90)).astype(float)
    wide = spark.createDataFrame([(1, i, *map(float, y[:, i])) for i in range(90)], "trace_id int, i bigint, g double, a double, t double, c double")
    sql = P.moving_percentile(P.long(wide), 21, 0.5, True).orderBy("ch", "i").collect()
    assert np.allclose(np.array([r["p"] for r in sql]).reshape(4, 90), ks.moving_median(y, 21))
    low = P.moving_percentile(P.long(wide), 11, 0.05, False).orderBy("ch", "i").collect()
    assert np.allclose(np.maximum(np.array([r["p"] for r in low]).reshape(4, 90), y.max(1)[:, None] * 0.0005), ks.running_noise(y, 11, 5.0))
    assert P.blob_end(wide).first()["blob_end"] == ks.blob_end(y)
    back = P.wide(P.long(wide)).orderBy("i").collect()
    assert [r["t"] for r in back] == y[2].tolist()
    assert np.allclose(np.array(T.baseline(T.traces(wide), "morph", 21).first()["y"]), ks.baseline(y, "morph", 21)[0])


def test_matrices(spark):
    rng = np.random.default_rng(4)
    rows = [(k, r, c, float(v)) for k in range(20) for (r, c), v in np.ndenumerate(rng.normal(0.3, 0.6, (4, 4)))]
    m = spark.createDataFrame(rows, "matrix_id int, row int, col int, v double")
    assert {round(r[1], 9) for r in M.plausibility(M.constrain(m)).collect()} == {24.0}  # any constrained matrix
    assert M.plausibility(m.filter("row < 3")).first()[1] == -999.0
    assert M.compare(m, m).agg(F.max("frobenius")).first()[0] == 0
    assert M.describe(np.eye(4))["condition"] == 1.0 and M.array_of(m, 3).shape == (4, 4)
    assert np.allclose(P.unmixing(np.ones((4, 4)) + 1e-9 * np.eye(4)), np.linalg.pinv(np.ones((4, 4)) + 1e-9 * np.eye(4)))


def test_presets():
    assert PipelineParams.library().dist == 2 and PipelineParams.interactive().baseline_method == "morph"
    assert PipelineParams.library(sg_win=20, nonsense=1).sg_win == 19


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT reverse_complement('ACGTN') a, trim_n('NNANN') b, readiness(96, 250) c, error_probability(20) d").first()
    assert tuple(row) == ("NACGT", "A", "green", 0.01)


def test_partition_count_does_not_matter(spark):
    df = reads(spark, *[[10, 30, 25, 18] * 9 for _ in range(5)])
    one = sorted(map(tuple, C.window_trim(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, C.window_trim(df.repartition(7)).collect()))


def test_envelope_by_kernel_equals_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(t, i, *(float(x) for x in rng.integers(0, 500, 4))) for t, n in ((1, 700), (2, 90), (3, 1)) for i in range(n)]
    s = spark.createDataFrame(rows, "trace_id int, i bigint, g double, a double, t double, c double")
    one = {(r["trace_id"], r["ch"], r["i"]): (r["envelope"], r["normal"]) for r in P.envelope(P.long(s)).collect()}
    two = {(r["trace_id"], r["ch"], r["i"]): (r["envelope"], r["normal"]) for r in T.envelope_lanes(s).collect()}
    assert one == two


def test_sql_functions_equal_columns(spark):
    S.register(spark)
    df = spark.range(400).selectExpr("id", "id * 0.37D AS snr", "0.9D + id % 50 * 0.01D AS iso", "id % 7 / 5.0D AS shape", "id % 5 / 3.0D AS gap", "id % 101 / 100.0D AS place", "concat('/a/b.c/f', id, '.ab1') AS path")
    df.createOrReplaceTempView("made")
    want = df.select("id", S.phred_score(*[F.col(c) for c in ("snr", "iso", "shape", "gap", "place")]), F.round(S.raw_score(*[F.col(c) for c in ("snr", "iso", "shape", "gap")]), 9), S.hit_band(F.col("snr")), S.one_decimal(F.col("snr")), S.file_stem(F.col("path")), S.isolation_ratio(*[F.col(c) for c in ("snr", "iso", "shape", "gap")]))
    got = spark.sql("SELECT id, phred_score(snr, iso, shape, gap, place), round(raw_score(snr, iso, shape, gap), 9), hit_band(snr), one_decimal(snr), file_stem(path), isolation_ratio(snr, iso, shape, gap) FROM made")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_matrix_problems_and_score(spark):
    good = [[1.2, 0.1, 0, 0], [0.1, 1.3, 0, 0], [0, 0, 1.1, 0.2], [0, 0, 0.1, 1.5]]
    assert M.problems(good) == [] and M.problems(np.eye(3)) == ["shape (3, 3)"]
    bad = [[-1.0, 0.1, 0, 0], [2.0, 1.01, 0, 0], [0, 0, 1.1, 0], [0, 0, 0, 1e-9]]
    assert any("not positive in row 0" in x for x in M.problems(bad)) and any("condition" in x for x in M.problems(bad)) and any("not leading in row 1" in x for x in M.problems(bad))
    rows = [("m", r, c, float(good[r][c])) for r in range(4) for c in range(4)]
    assert M.describe(good)["plausibility"] == pytest.approx(M.plausibility(spark.createDataFrame(rows, "matrix_id string, row int, col int, v double")).first()["plausibility"])


def test_sql_functions_equal_the_columns(spark):
    S.register(spark)
    rng = np.random.default_rng(31)
    rows = [(*map(float, rng.integers(0, 6, 4)), float(rng.random()), "".join(rng.choice(list("ACGTN"), rng.integers(0, 30))), bool(rng.random() < 0.5), int(rng.integers(0, 4))) for _ in range(200)]
    df = spark.createDataFrame(rows, "g double, a double, t double, c double, place double, seq string, rescued boolean, ch int")
    ours = ("heterozygote(g, a, t, c, 0.45D)", "trim_primer(seq, 'GACTN')", "trim_primer(seq, '')", "late_min_snr(place, 1.5D)", "late_min_isolation(place, 1.2D)", "called_letter(ch, rescued, false)", "called_letter(ch, rescued, true)")
    late = S.late_thresholds(F.col("place"), 1.5, 1.2)
    theirs = (S.heterozygote(*map(F.col, "gatc")), S.trim_primer(F.col("seq"), "GACTN"), S.trim_primer(F.col("seq"), ""), *late, S.called_letter(F.col("ch"), F.col("rescued"), False), S.called_letter(F.col("ch"), F.col("rescued")))
    got, want = df.selectExpr(*ours).collect(), df.select(*theirs).collect()
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]


def test_residuals_show_what_is_wrong(spark):
    rows = [(0, 0, i, float(y), float(z), 1.0) for i, (y, z) in enumerate(zip([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]))] + [(0, 1, i, 0.0, float(z), 1.0) for i, z in enumerate([0, 1, 0, 0])]
    got = {r["ch"]: (r["n"], r["worst"]) for r in P.smoother_residual(spark.createDataFrame(rows, "trace_id int, ch int, i long, y double, z double, w double"), 10.0).collect()}
    assert got == {0: (5, 0.0), 1: (4, 51.0)}
    s = [[1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [0.0, 0.0]]
    eye = [[float(a == b) for b in range(4)] for a in range(4)]
    good, bad = (spark.createDataFrame([(0, s, w, eye)], "trace_id int, s array<array<double>>, w array<array<double>>, h array<array<double>>") for w in (s, [[-1.0, 0.0], *s[1:]]))
    assert P.factor_residual(good).first()[1:] == (2, 0.0, 0.0)
    assert P.factor_residual(bad).first()[1:] == (2, 0.8, -1.0)


def test_residuals_of_whole_curves_need_no_shuffle(spark):
    rng = np.random.default_rng(6)
    curves = [(t, *([rng.random(n).tolist() for _ in range(4)] for _ in range(3))) for t, n in enumerate((1, 2, 3, 4, 40))] + [(9, [[]] * 4, [[]] * 4, [[]] * 4)]
    df = spark.createDataFrame(curves, "trace_id int, y array<array<double>>, z array<array<double>>, w array<array<double>>")
    got = P.curve_residual(df, 10.0)
    want = P.smoother_residual(T.lanes(df, "y", "z", "w"), 10.0)
    assert {tuple(r)[:3]: pytest.approx(r[3]) for r in want.collect()} == {tuple(r)[:3]: r[3] for r in got.collect()} and got.count() == 20
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_als_residual_sorts_no_samples(spark):
    from lanewise.plans.queries import QUERIES

    plan = QUERIES["als_residual"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 1  # the one that numbers the samples


def test_kernels_get_portions_of_a_batch():
    """Whatever an Arrow batch holds, a kernel's results leave after about BATCH numbers."""
    import pyarrow as pa

    sizes = [600] * 500 + [0, 3, 200_000, 1]
    keys, values = pa.array(range(len(sizes))), T.nested([np.full((4, n), k, float) for k, n in enumerate(sizes)])
    parts = [(k.to_pylist(), some) for k, some in T.portions(keys, values)]
    assert [k for ks_, _ in parts for k in ks_] == keys.to_pylist() and len(parts) > 3
    assert all(len(k) == len(some) and sum(y.size for y in some[:-1]) < T.BATCH for k, some in parts)
    assert [y.shape for _, some in parts for y in some] == [(4, n) for n in sizes]


def test_matrices_from_many_traces_hold_no_windows():
    """What dominant() keeps of a batch's baselines: a few times the traces, not 101 times."""
    import tracemalloc

    ys = [np.random.default_rng(k).integers(0, 50, (4, 600)).astype(float) for k in range(60)]
    tracemalloc.start()
    kept = [ks.baseline(y, "rolling", 101) for y in ys]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(kept) == 60 and held < 4 * sum(y.nbytes for y in ys)
