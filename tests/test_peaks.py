"""Peaks, spacing, imputation and mobility as rows: hand-made vectors, and the kernels that do the same in arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions.arrays import doubled, percentile, scan
from lanewise.kernels import basecall as kb
from lanewise.kernels import peaks as kp
from lanewise.kernels import signal as ks
from lanewise.operators import peaks as K


def lanes(spark, *values):
    return spark.createDataFrame([(0, ch, i, float(y)) for ch, ys in enumerate(values) for i, y in enumerate(ys)], "trace_id long, ch int, i long, y double").repartition(3)


def wide(spark, *traces):
    return spark.createDataFrame([(t, i, *map(float, y[:, i])) for t, y in enumerate(traces) for i in range(y.shape[1])], "trace_id long, i long, g double, a double, t double, c double").repartition(3)


def by_lane(rows, *columns):
    out = {}
    for r in sorted(rows):
        out.setdefault((r["trace_id"], r["ch"]), []).append(tuple(r[c] for c in columns))
    return out


def test_maxima_of_plateaus_and_ends(spark):
    shapes = ([0, 1, 0], [3, 3, 1, 2, 2, 2, 1], [1, 2, 2, 1, 5, 5], [2, 2, 2], [1], [0, 4, 4, 4, 4, 0, 4, 4, 0], [5, 1, 2, 3, 3, 4])
    found = by_lane(K.find_peaks(lanes(spark, *shapes)).collect(), "pos")
    want = {(0, ch): [(int(p),) for p in kp.maxima(np.array(y, float))] for ch, y in enumerate(shapes)}
    assert found == {k: v for k, v in want.items() if v}
    assert found[0, 1] == [(4,)] and found[0, 5] == [(2,), (6,)]


def test_prominence_by_hand(spark):
    """Equal peaks don't bound each other; a higher one does; the ends count as they are."""
    y = [2, 5, 1, 5, 0, 9, 3, 4, 3, 8, 7]
    got = {r["pos"]: r["prominence"] for r in K.find_peaks(lanes(spark, y)).collect()}
    assert got == {1: 3.0, 3: 4.0, 5: 6.0, 7: 1.0, 9: 1.0}


def test_distance_ties_go_to_the_later_peak(spark):
    y = [0, 5, 0, 5, 0, 5, 0, 7, 0, 6, 0]
    assert [r["pos"] for r in K.find_peaks(lanes(spark, y), 3).orderBy("pos").collect()] == [3, 7]


@pytest.mark.parametrize("distance, prom", [(1, 0.0), (4, 0.2), (9, 0.1)])
def test_peaks_equal_the_kernel(spark, distance, prom):
    rng = np.random.default_rng(distance)
    values = [rng.integers(0, 12, n).astype(float) for n in (1, 2, 3, 17, 64, 65, 200)] + [rng.normal(size=150), np.zeros(20), -np.ones(5)]
    plain = by_lane(K.plain_peaks(lanes(spark, *values), prom, distance).collect(), "pos", "prominence")
    adaptive = by_lane(K.adaptive_peaks(lanes(spark, *[np.maximum(v, 0) for v in values]), max(prom, 0.01), distance).collect(), "pos")
    for ch, y in enumerate(values):
        at = kp.find(y, max(prom * y.max(), 1e-6), distance)
        assert plain.get((0, ch), []) == list(zip(at.tolist(), kp.prominences(y, at).tolist()))
        assert adaptive.get((0, ch), []) == [(int(p),) for p in kp.find_adaptive(np.maximum(y, 0), max(prom, 0.01), distance)]


def test_spacing_model_equals_the_kernel(spark):
    rng = np.random.default_rng(2)
    places = {t: np.cumsum(rng.integers(2, 19, n)) for t, n in enumerate([5, 6, 7, 8, 9, 11, 20, 21, 22, 23, 24, 60])}
    sure = spark.createDataFrame([(t, int(p)) for t, ps in places.items() for p in ps], "trace_id long, pos long").repartition(4)
    got = {}
    for r in sorted(K.spacing_model(K.spacing_knots(sure)).collect()):
        got.setdefault(r["trace_id"], []).append(r["due"])
    assert 0 not in got
    for t in range(1, len(places)):
        assert np.allclose(got[t], kb.spacing_model(places[t])) and len(got[t]) == len(kb.spacing_model(places[t]))


def calls_of(at, n):
    zero = np.zeros(len(at))
    return kb.Calls(pos=np.array(at), channel=np.zeros(len(at), int), amplitude=zero, noise=zero, snr=zero, isolation=zero, shape=zero, place=zero, spacing=zero, tail_rescued=zero > 0, imputed=zero > 0, score=zero, phred=np.zeros(len(at), int))


def imputed(spark, traces, called, models, blobs=None):
    model = spark.createDataFrame([(t, i, float(d)) for t, m in enumerate(models) for i, d in enumerate(m)], "trace_id long, i long, due double")
    calls = spark.createDataFrame([(t, int(p)) for t, ps in enumerate(called) for p in ps], "trace_id long, pos long")
    ends = None if blobs is None else spark.createDataFrame(list(enumerate(blobs)), "trace_id long, blob_end long")
    return K.imputed_calls(calls, model, wide(spark, *traces), ends).collect()


def test_two_imputations_may_share_a_peak(spark):
    """The bands of one gap overlap and don't see each other."""
    y = np.zeros((4, 60))
    y[2, [4, 10, 16, 22, 28]] = 50
    y[1, 34] = 40
    called = [4, 10, 16, 22, 28, 40]
    got = imputed(spark, [y], [called], [np.full(60, 4.2)])
    assert [(r["after"], r["k"], r["pos"], r["channel"], r["amplitude"]) for r in sorted(got)] == [(28, 1, 34, 1, 40.0), (28, 2, 34, 1, 40.0)]


@pytest.mark.parametrize("blobs", [None, (0, 55, 10, 0)])
def test_imputation_equals_the_kernel(spark, blobs):
    rng = np.random.default_rng(9)
    traces = [np.maximum(rng.normal(size=(4, 220)) * 20, 0).round() for _ in range(3)] + [np.zeros((4, 40))]
    called = [np.unique(rng.choice(220, 45)) for _ in range(2)] + [np.arange(10, 200, 11), np.arange(4)]
    models = [np.full(120, 4.0), 3 + np.arange(220) / 90, np.full(220, 4.9), np.full(40, 4.0)]
    got = imputed(spark, traces, called, models, blobs)
    for t, y in enumerate(traces):
        c = calls_of(called[t], 220)
        full = kb.filled(c, y, models[t], np.ones_like(y), blobs[t] if blobs else 0)
        want = sorted((int(p), int(k)) for p, k, new in zip(full.pos, full.channel, full.imputed) if new)
        assert sorted((r["pos"], r["channel"]) for r in got if r["trace_id"] == t) == want
    assert got


def test_contested_peak_goes_to_the_first_mark(spark):
    """20 is nearest to both 18 and 21; the second mark takes what is left within reach, the third finds nothing."""
    marks = spark.createDataFrame([(0, p) for p in (18, 21, 60, 100)], "trace_id long, pos long")
    peaks = spark.createDataFrame([(0, 0, p) for p in (2, 20, 33, 101)] + [(0, 1, p) for p in (18, 21, 60)], "trace_id long, ch int, pos long")
    assert sorted(map(tuple, K.mobility_pairs(marks, peaks).collect())) == [(0, 0, 18, 2), (0, 0, 21, 12), (0, 0, 100, 1)]
    assert K.mobility_pairs(marks.filter("pos < 100"), peaks).count() == 0
    at, by = kp.matched_drift(np.array([18, 21, 60, 100, 140]), np.array([2, 20, 33, 101, 141]))
    assert list(zip(at.tolist(), by.tolist())) == [(18, 2), (21, 12), (100, 1), (140, 1)]


def test_mobility_equals_the_kernel(spark):
    rng = np.random.default_rng(11)
    traces = []
    for n in (9, 60, 140):
        y = np.maximum(rng.normal(size=(4, n)) * 9, 0).round()
        traces.append(np.stack([ks.shifted(row, s) for row, s in zip(y, (0, 3, -4, 40))]))
    samples = wide(spark, *traces, np.zeros((4, 12)))
    lags = K.mobility_lags(samples)
    got = {(r["trace_id"], r["ch"]): r["lag"] for r in lags.collect()}
    marks, peaks = K.mobility_peaks(samples, lags, 0.2)
    pairs = by_lane(K.mobility_pairs(marks, peaks).collect(), "mark", "offset")
    shifted = by_lane(K.moved(K.long(samples), lags).collect(), "i", "y")
    for t, y in enumerate([*traces, np.zeros((4, 12))]):
        n, total = y.shape[1], y.sum(0)
        for ch in range(4):
            lag = int(np.clip(int(np.argmax(np.correlate(y[ch], total, "full"))) - (n - 1), -n // 10, n // 10))
            assert got[t, ch] == lag
            row = ks.shifted(y[ch], -lag)
            assert [v for _, v in shifted[t, ch]] == row.tolist()
            at = kp.find(total, 0.2 * np.percentile(total, 90))
            drift = kp.matched_drift(at, kp.find(row, 0.2 * np.percentile(row, 90))) if len(at) >= 4 else None
            if drift is not None:
                assert pairs[t, ch] == list(zip(*(x.tolist() for x in drift)))


def test_array_blocks(spark):
    values = [float(x) for x in np.random.default_rng(1).integers(0, 99, 150)]
    row = spark.createDataFrame([(values,), ([7.0],)], "v array<double>").select(
        scan(F.col("v"), "double", F.lit(0.0), lambda s, x: (s + x, s * 2), "double").alias("s"), doubled(F.col("v"), F.greatest).alias("d"), percentile(F.sort_array("v"), 0.9).alias("p")
    ).collect()
    assert row[0]["s"] == [2 * sum(values[:k]) for k in range(150)] and row[1]["s"] == [0.0]
    assert all(row[0]["d"][k][x] == max(values[max(0, x - 2**k + 1) : x + 1]) for k in range(len(row[0]["d"])) for x in range(150)) and len(row[0]["d"]) >= 8
    assert row[0]["p"] == pytest.approx(np.percentile(values, 90)) and row[1]["p"] == 7.0


def test_models_end_after_whole_spacings(spark):
    """The largest smoothed gap is 7 and no hair less, so the model reaches five times 7 beyond the last place."""
    places = np.cumsum([3, 6, 5, 5, 10, 4, 6]).tolist()
    sure = spark.createDataFrame([(0, p) for p in places], "trace_id long, pos long")
    last = K.spacing_model(K.spacing_knots(sure)).agg(F.max(F.struct("i", "due"))).first()[0]
    assert (last["i"], last["due"]) == (places[-1] + 35, 7.0)


def test_bands_begin_at_whole_spacings(spark):
    """12 samples are due after 19, so the band is 28 to 34 and the peak at 33 is inside it, not its end."""
    y = np.zeros((4, 80))
    y[3, 33] = 40
    sure = spark.createDataFrame([(0, p) for p in (10, 15, 19, 46, 53, 60, 65)], "trace_id long, pos long")
    got = K.imputed_calls(sure, K.spacing_model(K.spacing_knots(sure)), wide(spark, y)).collect()
    assert [(r["after"], r["k"], r["pos"], r["channel"]) for r in got] == [(19, 1, 33, 3)]


def test_lags_make_no_row_of_a_pair(spark):
    """Of equal sums the least lag counts; a sample without a value adds nothing; no join or explosion of pairs is planned."""
    y = np.zeros((4, 50))
    y[0, [10, 14]] = y[1, 12] = 5
    samples = wide(spark, y).withColumn("t", F.when(F.col("i") == 30, None).otherwise(F.col("t")))
    got = K.mobility_lags(samples)
    assert [(r["ch"], r["n"], r["lag"]) for r in got.orderBy("ch").collect()] == [(0, 50, 0), (1, 50, -2), (2, 50, -5), (3, 50, -5)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_mobility_peaks_equal_those_by_rows(spark):
    """And no sample is exploded into rows of its channel."""
    rng = np.random.default_rng(21)
    samples = wide(spark, *[rng.integers(0, 30, (4, n)).astype(float) for n in (1, 2, 9, 61, 140)])
    lags = K.mobility_lags(samples)
    marks, peaks = K.mobility_peaks(samples, lags, 0.3)
    least = 0.3 * F.col("p90")
    total = samples.select("trace_id", "i", F.expr("g + a + t + c").alias("y"))
    assert sorted(map(tuple, marks.collect())) == sorted(map(tuple, K.find_peaks(total, 1, least, ("trace_id",)).select("trace_id", "pos").collect()))
    assert sorted(map(tuple, peaks.collect())) == sorted(map(tuple, K.find_peaks(K.moved(K.long(samples), lags), 1, least).select("trace_id", "ch", "pos").collect()))
    assert "Generate" not in peaks._jdf.queryExecution().sparkPlan().toString()


def test_pairs_are_told_without_rows_of_candidates(spark):
    marks = spark.createDataFrame([(0, p) for p in (18, 21, 60, 100)], "trace_id long, pos long")
    peaks = spark.createDataFrame([(0, 0, p) for p in (2, 20, 33, 101)], "trace_id long, ch int, pos long")
    pairs = K.mobility_pairs(marks, peaks)
    assert sorted(map(tuple, pairs.collect())) == [(0, 0, 18, 2), (0, 0, 21, 12), (0, 0, 100, 1)]
    assert "Generate" not in pairs._jdf.queryExecution().sparkPlan().toString()
