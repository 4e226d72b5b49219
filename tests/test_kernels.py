"""Kernels against definitions, hand-made vectors and synthetic traces."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.kernels import basecall as kb
from lanewise.kernels import matrix as km
from lanewise.kernels import peaks as kp
from lanewise.kernels import signal as ks
from lanewise.params import PipelineParams
from lanewise.plans.pipeline import process

RNG = np.random.default_rng(7)


def test_mirror():
    y = np.array([1.0, 2, 3, 4])
    assert ks.mirror(y, 4, 4).tolist() == [4, 3, 2, 1, 1, 2, 3, 4, 4, 3, 2, 1]
    assert ks.mirror(y, 3, 3, repeat_edge=False).tolist() == [4, 3, 2, 1, 2, 3, 4, 3, 2, 1]
    assert ks.mirror(y, 9, 0).tolist() == [1, 1, 2, 3, 4, 4, 3, 2, 1, 1, 2, 3, 4]


@given(st.lists(st.integers(0, 50), min_size=4, max_size=40), st.sampled_from([3, 4, 5, 9]))
@settings(max_examples=60, deadline=None)
def test_moving_filters(values, width):
    y = np.array(values, float)[None]
    padded = np.pad(y[0], (width // 2, width - 1 - width // 2), "symmetric") if len(values) >= width else None
    if padded is None:
        return
    windows = [padded[k : k + width] for k in range(len(values))]
    assert ks.moving_max(y, width)[0].tolist() == [w.max() for w in windows]
    assert ks.moving_median(y, width)[0].tolist() == [sorted(w)[width // 2] for w in windows]


def test_medians_keep_no_windows():
    base = ks.rolling_baseline(np.arange(2400.0).reshape(4, 600) % 37)[1]
    assert base.base is None or base.base.nbytes <= base.nbytes


def test_running_noise_floor():
    y = RNG.integers(0, 100, (4, 80)).astype(float)
    want = np.stack([[max(np.percentile(np.pad(r, 5, "reflect")[i : i + 11], 5), r.max() * 0.0005) for i in range(80)] for r in y])
    assert np.allclose(ks.running_noise(y, 11, 5.0), want)


def test_als_solves_its_equations():
    y = RNG.random((4, 60)) * 100
    _, base = ks.als_baseline(y, rounds=1)
    d = np.diff(np.eye(60), 2, axis=0)
    want = np.stack([np.linalg.solve(np.eye(60) + 1e5 * d.T @ d, r) for r in y])
    assert np.allclose(base, np.maximum(want, 0), atol=1e-6)


def test_als_thins_long_traces():
    fixed, base = ks.als_baseline(np.abs(np.sin(np.linspace(0, 9, 5000)))[None].repeat(4, 0) * 100)
    assert fixed.shape == base.shape == (4, 5000) and (fixed >= 0).all()


def test_als_of_several_traces_shares_sweeps(monkeypatch):
    """Traces of any lengths get the curves they get alone; similar ones are solved together."""
    rng, sweeps, solve = np.random.default_rng(8), [], ks._pentadiagonal
    ys = [rng.random((4, n)) * 50 for n in (90, 1, 2, 3, 100, 95, 4100, 0)]
    alone = [ks.als_baseline(y) for y in ys]
    monkeypatch.setattr(ks, "_pentadiagonal", lambda *bands: sweeps.append(1) or solve(*bands))
    for one, two in zip(alone, ks.als_baselines(ys), strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(one, two))
    assert len(sweeps) == 60  # lengths 0, 1, 2, 3, 90 to 100 and 2050: ten rounds each


def test_savgol_keeps_cubics():
    x = np.arange(40.0)
    y = 0.01 * x**3 - 0.2 * x**2 + x + 30
    assert np.allclose(ks.savgol(y, 9, 3), y)
    for mode in ("mirror", "nearest", "wrap", "constant"):
        assert np.allclose(ks.savgol(y, 9, 3, mode)[10:30], y[10:30])


def test_shift_and_unmix():
    y = RNG.random((4, 30))
    assert np.array_equal(ks.shifted(ks.shifted(y[0], 3), -3)[:27], y[0][:27])
    m = np.eye(4) + 0.2 * RNG.random((4, 4))
    assert np.allclose(ks.unmixed(m @ y, np.linalg.inv(m), (0, 0, 0, 0)), y)


def test_blob_end():
    y = np.zeros((4, 400))
    y[0, 100:130] = 50
    assert ks.blob_end(y) == 130
    assert ks.blob_end(np.zeros((4, 400))) == 0
    assert ks.blob_end(np.full((4, 300), 5.0)) == 50


def test_maxima_and_prominence():
    assert kp.maxima(np.array([0, 2, 2, 2, 1, 3, 1, 4, 4])).tolist() == [2, 5]
    y = np.array([0, 5, 3, 6, 1, 9, 0], float)
    assert kp.prominences(y, np.array([1, 3, 5])).tolist() == [2, 5, 9]
    assert kp.find(y, 5.0).tolist() == [3, 5]
    assert kp.find(y, distance=3).tolist() == [1, 5]


def test_shape_prefers_gaussians():
    x = np.arange(60.0)
    bell = np.exp(-0.5 * ((x - 30) / 2.5) ** 2)
    ramp = np.where((x >= 24) & (x <= 30), x - 23, 0)
    assert kp.shapes(bell, np.array([30]))[0] > 0.99
    assert kp.shapes(ramp, np.array([30]))[0] < 0.6
    assert kp.shapes(np.zeros(60), np.array([30]))[0] == 0.5


def test_fits_at_their_bounds_converge():
    """A ramp's best bell is as wide and as far to the side as it may be: 16 times the rounds gain nothing on the fit."""
    x = np.arange(-8, 9.0)
    ramps = np.stack([np.clip(0.5 + a * x, 0, 1) * (1 + b * (x % 2)) / (1 + b) for a in (-0.06, -0.02, 0.03, 0.06) for b in (0.0, 0.3, 1.0)])
    inside = np.ones(ramps.shape, bool)
    short, long = (((ramps - kp._gaussians(x, ramps, inside, rounds)) ** 2).sum(1) for rounds in (80, 1280))
    assert (short - long < 1e-9).all()


def test_shapes_of_several_traces_equal_those_of_each():
    rng = np.random.default_rng(12)
    ys = [np.maximum(rng.normal(size=(4, n)) * 20, 0) for n in (3, 9, 40, 700)]
    each = [(y, c, kp.find(y[c])) for y in ys for c in range(4)]
    together = kp.shapes_of(*map(np.concatenate, zip(*[kp.around(y, at, np.full(len(at), c)) for y, c, at in each])))
    assert np.allclose(together, np.concatenate([kp.shapes(y[c], at) for y, c, at in each]), atol=1e-9)


def test_local_noise_branches():
    y = RNG.random(100)
    near = np.r_[y[30:45], y[56:70]]
    q = np.percentile(near, [75, 25])
    assert kp.local_noise(y, 50, 1e-6) == pytest.approx((q[0] - q[1]) / 1.35)
    assert kp.local_noise(y[:3], 1, 0.5) == 0.5


def test_clusters_reach_from_their_first_place():
    y = np.zeros((4, 10))
    y[0, [0, 2, 4, 6]] = [1, 2, 3, 2]
    at, _ = kb.merged(y, np.array([0, 2, 4, 6]), np.zeros(4, int), 3)
    assert at.tolist() == [2, 4]


def test_shadows():
    y = np.zeros(30)
    y[[5, 9, 20]] = [1, 10, 10]
    assert kb.shadows(y, np.array([5, 9, 20])).tolist() == [True, False, False]


def test_spacing_model():
    assert kb.spacing_model(np.arange(5) * 12) is None
    assert np.allclose(kb.spacing_model(np.arange(30) * 12), 12)


def test_matrices():
    assert np.allclose(km.from_peaks(np.zeros((4, 50))), np.eye(4) * 1.01)
    pure = np.abs(RNG.normal(size=(4, 900))) * (RNG.random((4, 900)) < 0.2) * 100
    m = np.array([[1, 0.3, 0, 0], [0.1, 1, 0.2, 0], [0, 0.1, 1, 0.3], [0.2, 0, 0.1, 1]])
    assert np.abs(km.from_factors(m @ pure) - m).max() < 0.25


def chromatogram(n, noise=0.0, seed=1, bleed=True):
    rng = np.random.default_rng(seed)
    letters = rng.integers(0, 4, n)
    at = 250 + np.cumsum(np.linspace(12, 14, n))
    x = np.arange(int(at[-1]) + 120)
    y = np.zeros((4, len(x)))
    for p, ch, h in zip(at, letters, np.linspace(800, 200, n)):
        y[ch] += h * np.exp(-0.5 * ((x - p) / 2.5) ** 2)
    m = np.array([[1, 0.2, 0.05, 0.1], [0.15, 1, 0.1, 0.05], [0.05, 0.1, 1, 0.25], [0.1, 0.05, 0.2, 1]]) if bleed else np.eye(4)
    y = m @ y + 60 + 40 * np.sin(x / 900) + 0.01 * x
    y += 1500 * np.exp(-0.5 * ((x - 90) / 25) ** 2)
    return "".join("GATC"[c] for c in letters), np.maximum(y + rng.normal(0, noise, y.shape), 0), m


def identity(a, b):
    """Share of a in the longest common subsequence."""
    row = np.zeros(len(b) + 1, int)
    for c in a:
        new = row.copy()
        for j, d in enumerate(b):
            new[j + 1] = row[j] + 1 if c == d else max(row[j + 1], new[j])
        row = new
    return row[-1] / max(len(a), 1)


@pytest.mark.parametrize("noise,least", [(0.0, 0.95), (3.0, 0.9)])
def test_synthetic_trace(noise, least):
    want, y, m = chromatogram(150, noise)
    p = PipelineParams.interactive(matrix=tuple(map(tuple, m)), mobility_enabled=False)
    out = process(y, np.arange(y.shape[1], dtype=float), p, np.linalg.inv(m), keep=True)
    assert 100 < out["blob_end"] < 260
    assert identity(want, "".join(out["calls"]["letter"])) >= least
    assert set(out["stages"]) >= {"raw", "smooth", "final"}


def test_imputed_gap():
    y = np.zeros((4, 400))
    x = np.arange(400)
    for k in range(28):
        weak = k == 14
        y[k % 4] += (40 if weak else 500) * np.exp(-0.5 * ((x - 20 - 12 * k) / 2.5) ** 2)
    calls = kb.call(y + 1e-3, PipelineParams.library(min_snr=1.0, suppress_n1=False, prom=0.3), 0, np.full(y.shape, 20.0))
    assert calls.imputed.sum() == 1 and calls.pos[calls.imputed][0] == pytest.approx(20 + 12 * 14, abs=1)
