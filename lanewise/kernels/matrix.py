"""Crosstalk estimates that need arrays: from peaks, and by non-negative matrix factorisation."""

from __future__ import annotations

import numpy as np

from . import peaks as pk
from .signal import fitting_window, moving_median


def corrected(y: np.ndarray, window: int = 101) -> np.ndarray:
    return np.maximum(y - moving_median(y, fitting_window(window, y.shape[1])), 0.0)


def from_peaks(y: np.ndarray, prominence: float = 0.01, distance: int = 5) -> np.ndarray:
    """Mean vectors at peaks where a channel leads by a ratio of 2, else 1.5, else 1.2 (the first with five peaks); a
    small ridge on the diagonal."""
    m = np.eye(4)
    for ch in range(4):
        at = pk.find(y[ch], prominence * 0.5, distance)
        at = at[y[ch, at] != 0]
        ranked = np.sort(y[:, at], 0)
        for ratio in (2.0, 1.5, 1.2):
            lead = at[ranked[-1] >= ratio * (ranked[-2] + 1e-9)]
            if len(lead) >= 5:
                m[:, ch] = (y[:, lead] / y[ch, lead]).mean(1)
                break
    diagonal = np.maximum(np.diag(m), 1.0)
    np.fill_diagonal(m, diagonal)
    return m + 0.01 * max(float(np.abs(diagonal).mean()), 1.0) * np.eye(4)


def factorised(s: np.ndarray, rounds: int = 600, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """s (samples, 4) = W H with non-negative factors: a start from the singular vectors' positive parts, zeros filled
    with the mean, then alternating updates of one component at a time."""
    u, d, v = np.linalg.svd(s, full_matrices=False)
    k = 4
    w, h = np.zeros((len(s), k)), np.zeros((k, s.shape[1]))
    for i in range(k):
        parts = [(np.maximum(sign * u[:, i], 0), np.maximum(sign * v[i], 0)) for sign in (1, -1)]
        x, z = max(parts, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        nx, nz = np.linalg.norm(x), np.linalg.norm(z)
        if nx and nz:
            scale = np.sqrt(d[i] * nx * nz)
            w[:, i], h[i] = scale * x / nx, scale * z / nz
    w[w == 0] = h[h == 0] = s.mean()
    before = np.inf
    for _ in range(rounds):
        a, b = s @ h.T, h @ h.T
        for i in range(k):
            w[:, i] = np.maximum(0, w[:, i] + (a[:, i] - w @ b[:, i]) / max(b[i, i], 1e-12))
        a, b = w.T @ s, w.T @ w
        for i in range(k):
            h[i] = np.maximum(0, h[i] + (a[i] - b[i] @ h) / max(b[i, i], 1e-12))
        now = float(((s - w @ h) ** 2).sum())
        if before - now <= tolerance * max(before if np.isfinite(before) else now, 1e-12):
            break
        before = now
    return w, h


def from_factors(y: np.ndarray, most: int = 6000) -> np.ndarray:
    """Components are given to channels by their correlation, the best pair first; a component's row over its channel's
    entry is that channel's column."""
    s = y.T[:: max(1, y.shape[1] // most)].astype(float)
    w, h = factorised(s)
    spread = w.std(0)[:, None] * s.std(0)[None, :] + 1e-9
    across = ((w - w.mean(0)).T @ (s - s.mean(0))) / len(s) / spread
    m = np.eye(4)
    for _ in range(4):
        k, ch = np.unravel_index(int(np.argmax(across)), across.shape)
        if h[k, ch] > 0:
            m[:, ch] = h[k] / h[k, ch]
            m[ch, ch] = max(m[ch, ch], 1.0)
        across[k], across[:, ch] = -np.inf, -np.inf
    return m
