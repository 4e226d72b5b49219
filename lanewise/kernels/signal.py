"""Filters on the channels of one trace: percentiles, baselines, smoothing, sharpening. Arrays are (channels, samples)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def mirror(y: np.ndarray, before: int, after: int, repeat_edge: bool = True) -> np.ndarray:
    """Samples mirrored at both ends, with the edge sample repeated or not. Works for pads longer than the trace."""
    n = y.shape[-1]
    period = 2 * n if repeat_edge else max(2 * n - 2, 1)
    at = np.arange(-before, n + after) % period
    return y[..., np.where(at < n, at, (2 * n - 1 if repeat_edge else 2 * n - 2) - at)]


def fitting_window(window: int, n: int) -> int:
    """An odd window of three samples or more, but shorter than the trace (and then perhaps even)."""
    return max(3, min(window | 1, n - 1))


def moving(y: np.ndarray, width: int, how) -> np.ndarray:
    """how(windows) over windows of `width` samples, an even one reaching one sample further back."""
    return how(sliding_window_view(mirror(y, width // 2, width - 1 - width // 2), width, axis=-1))


def moving_median(y: np.ndarray, width: int) -> np.ndarray:
    """Rank filter: the middle value, the upper of two where the window is even. The values are copied, as a view would keep
    all windows, `width` times the trace."""
    return moving(y, width, lambda w: np.partition(w, width // 2, axis=-1)[..., width // 2].copy())


def moving_max(y: np.ndarray, width: int) -> np.ndarray:
    return running_max(y, width)


def moving_min(y: np.ndarray, width: int) -> np.ndarray:
    return moving(y, width, lambda w: w.min(-1))


def running_max(y: np.ndarray, width: int) -> np.ndarray:
    """moving_max() by doubling: two overlapping runs of a power of two cover each window."""
    padded, step = mirror(y, width // 2, width - 1 - width // 2), 1
    while 2 * step <= width:
        padded = np.maximum(padded[..., :-step], padded[..., step:])
        step *= 2
    return np.maximum(padded[..., : y.shape[-1]], padded[..., width - step : width - step + y.shape[-1]])


def envelope(y: np.ndarray, width: int = 300, fraction: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Moving maximum, at least a share of the channel's maximum, and the signal over it."""
    over = np.maximum(running_max(y, width), y.max(-1, initial=0.0)[..., None] * fraction)
    return over, np.where(over > 0, y / np.where(over > 0, over, 1.0), 0.0)


def running_noise(y: np.ndarray, window: int = 51, percent: float = 10.0) -> np.ndarray:
    """Moving low percentile, not under 0.05 % of the channel's largest value."""
    half = max(window // 2, 1)
    low = np.percentile(sliding_window_view(mirror(y, half, half, repeat_edge=False), 2 * half + 1, axis=-1), percent, axis=-1)
    top = np.where((y > 0).any(-1), np.abs(y).max(-1), 1.0)
    return np.maximum(low, top[..., None] * 0.0005)


def gaussian(y: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, cut off at four sigma."""
    r = int(4.0 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return sliding_window_view(mirror(y, r, r), 2 * r + 1, axis=-1) @ (w / w.sum())


def rolling_baseline(y: np.ndarray, window: int = 101) -> tuple[np.ndarray, np.ndarray]:
    base = moving_median(y, fitting_window(window, y.shape[-1]))
    return np.maximum(y - base, 0.0), base


def morphological_baseline(y: np.ndarray, window: int = 101) -> tuple[np.ndarray, np.ndarray]:
    w = fitting_window(window, y.shape[-1])
    base = gaussian(moving_max(moving_min(y, w), w), max(1, w // 8))
    return np.maximum(y - base, 0.0), np.maximum(base, 0.0)


def _pentadiagonal(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve symmetric banded systems: rows are samples, columns independent systems. LDL^T in one sweep each way."""
    n = len(d0)
    d, u, v, z = np.empty_like(d0), np.zeros_like(d0), np.zeros_like(d0), np.empty_like(rhs)
    for i in range(n):
        a, c, r = d0[i].copy(), d1[i].copy() if i < n - 1 else np.zeros_like(d0[0]), rhs[i].copy()
        if i >= 1:
            a -= d[i - 1] * u[i - 1] ** 2
            c -= d[i - 1] * u[i - 1] * v[i - 1]
            r -= u[i - 1] * z[i - 1]
        if i >= 2:
            a -= d[i - 2] * v[i - 2] ** 2
            r -= v[i - 2] * z[i - 2]
        d[i], z[i] = a, r
        u[i] = c / a
        if i < n - 2:
            v[i] = d2[i] / a
    x = z / d
    for i in range(n - 2, -1, -1):
        x[i] -= u[i] * x[i + 1]
        if i < n - 2:
            x[i] -= v[i] * x[i + 2]
    return x


def als_fits(thin: list[np.ndarray], stiffness: float = 1e5, p: float = 0.002, rounds: int = 10) -> list[tuple[np.ndarray, np.ndarray]]:
    """als_fit() of several traces: those of similar length share the sweeps, shorter ones filled up with samples of their
    own equations, which no others meet."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(y, y) for y in thin]
    order = sorted(range(len(thin)), key=lambda k: thin[k].shape[1])
    while order:
        alike = [k for k in order if thin[k].shape[1] <= 1.25 * thin[order[0]].shape[1]]
        order = order[len(alike) :]
        sizes = np.array([thin[k].shape[1] for k in alike])
        lanes = np.cumsum([0] + [len(thin[k]) for k in alike])
        y, n = np.zeros((sizes[-1], lanes[-1])), np.repeat(sizes, np.diff(lanes))
        for k, a, b in zip(alike, lanes, lanes[1:]):
            y[: thin[k].shape[1], a:b] = thin[k].T
        # the penalty on second differences, by bands
        one = (np.arange(len(y))[:, None] < n - 2).astype(float)
        two, three = (np.vstack([np.zeros((by, len(n))), one])[: len(y)] for by in (1, 2))
        bands = [stiffness * x for x in (one + 4.0 * two + three, -2.0 * (one + two), one)]
        w, base, used = np.ones_like(y), y, None
        for _ in range(rounds):
            base, used = _pentadiagonal(bands[0] + w, bands[1], bands[2], w * y), w
            w = np.where(y > base, p, 1.0 - p)
        used = w if used is None else used
        for k, a, b, size in zip(alike, lanes, lanes[1:], sizes):
            out[k] = base[:size, a:b].T.copy(), used[:size, a:b].T.copy()
    return out


def als_fit(thin: np.ndarray, stiffness: float = 1e5, p: float = 0.002, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Curves of asymmetric least squares through channels x samples, and the weights of their last round: each solves
    (W + stiffness D'D) z = W y for second differences D. All channels are solved at once."""
    return als_fits([thin], stiffness, p, rounds)[0]


def als_baselines(ys: list[np.ndarray], stiffness: float = 1e5, p: float = 0.002, rounds: int = 10, most: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Asymmetric least squares for several traces: a stiff curve that samples above it hardly pull. Long traces are thinned
    for the fit and the curve is interpolated."""
    steps = [max(1, y.shape[-1] // most) for y in ys]
    out = []
    for y, step, (base, _) in zip(ys, steps, als_fits([y[:, ::step] for y, step in zip(ys, steps)], stiffness, p, rounds)):
        n = y.shape[-1]
        full = base if step == 1 else np.stack([np.interp(np.arange(n), np.arange(0, n, step), b) for b in base])
        out.append((np.maximum(y - full, 0.0), np.maximum(full, 0.0)))
    return out


def als_baseline(y: np.ndarray, stiffness: float = 1e5, p: float = 0.002, rounds: int = 10, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    return als_baselines([y], stiffness, p, rounds, most)[0]


def baseline(y: np.ndarray, method: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Corrected signal and noise floor by 'als', 'morph' or (any other name) the rolling median."""
    if method == "als":
        return als_baseline(y)
    return morphological_baseline(y, window) if method == "morph" else rolling_baseline(y, window)


@lru_cache(maxsize=256)
def savgol_weights(width: int, order: int, at: float | None = None) -> np.ndarray:
    """Weights that give the least-squares polynomial's value at place `at` of a window (its middle by default)."""
    middle = (width - 1) / 2
    x = np.arange(width) - middle
    powers = np.vander(x, order + 1, increasing=True)
    target = ((0.0 if at is None else at - middle) ** np.arange(order + 1)).astype(float)
    return target @ np.linalg.pinv(powers)


@lru_cache(maxsize=1024)
def polynomial_weights(width: int, order: int, at: float | None = None) -> np.ndarray:
    """savgol_weights() by orthogonal polynomials on equally spaced points, up to degree 3: exact but for the rounding of a
    few operations, so that sums which are whole numbers by their weights come out whole wherever they can."""
    if order > 3:
        return savgol_weights(width, order, at)
    n = float(width)
    middle = (n - 1) / 2.0
    x, z = np.arange(width) - middle, (middle if at is None else float(at)) - middle
    square, third = (n * n - 1) / 12.0, (3.0 * n * n - 7) / 20
    out = np.full(width, 1.0 / n)
    if order >= 1:
        out = out + 12.0 * x * z / (n * (n * n - 1.0))
    if order >= 2:
        out = out + 180.0 * (x * x - square) * (z * z - square) / (n * (n * n - 1.0) * (n * n - 4))
    if order >= 3:
        out = out + 2800.0 * (x * x * x - x * third) * (z * z * z - z * third) / (n * (n * n - 1.0) * (n * n - 4) * (n * n - 9))
    return out


def smoothed_gaps(y: np.ndarray, width: int, order: int) -> np.ndarray:
    """savgol(y, width, order) by polynomial_weights(), with products summed from a window's last place to its first."""
    n, half, k = len(y), width // 2, np.arange(len(y))
    start = np.where(k < half, 0, np.where(k >= n - half, n - width, k - half))
    weights = np.stack([polynomial_weights(width, order, int(at - s) if at < half or at >= n - half else None) for at, s in zip(k, start)])
    out = np.zeros(n)
    for j in range(width - 1, -1, -1):
        out += y[start + j] * weights[:, j]
    return out


def savgol(y: np.ndarray, width: int, order: int, mode: str = "interp") -> np.ndarray:
    """Savitzky-Golay smoothing of a 1-d array. Ends: 'interp' fits the end windows; 'mirror', 'nearest', 'wrap' and
    'constant' (zeros) pad."""
    n, half = len(y), width // 2
    weights = savgol_weights(width, order)
    if mode == "interp":
        out = np.empty(n)
        inner = sliding_window_view(y, width) @ weights
        # an even window's value belongs half a sample beside its middle place
        out[half : half + len(inner)] = inner
        for k in range(half):
            out[k] = savgol_weights(width, order, k) @ y[:width]
            out[n - 1 - k] = savgol_weights(width, order, width - 1 - k) @ y[n - width :]
        return out
    pad = {"mirror": lambda: mirror(y, half, width - 1 - half, repeat_edge=False), "nearest": lambda: np.pad(y, (half, width - 1 - half), "edge"), "wrap": lambda: np.pad(y, (half, width - 1 - half), "wrap"), "constant": lambda: np.pad(y, (half, width - 1 - half))}
    return sliding_window_view(pad[mode](), width) @ weights


def smooth(y: np.ndarray, width: int = 19, order: int = 3, passes: int = 1, mode: str = "interp") -> np.ndarray:
    """Savitzky-Golay on each channel, cut at zero after each pass. The window is odd, over the order and within the trace."""
    w = max(order + 2, min(width, y.shape[-1] - 1))
    if w % 2 == 0:
        w = max(w - 1, order + 2)
    for _ in range(max(1, passes)):
        y = np.maximum(np.stack([savgol(row, w, min(order, w - 1), mode) for row in y]), 0.0)
    return y


def sharpen_tail(y: np.ndarray, fraction: float = 0.25, sigma: float = 0.4, amount: float = 0.0) -> np.ndarray:
    """Unsharp mask that grows over the last part of the trace; each channel keeps its largest value."""
    if amount == 0.0:
        return y.copy()
    n = y.shape[-1]
    start = int((1 - fraction) * n)
    ramp = np.concatenate([np.zeros(start), np.linspace(0, amount, n - start)])
    sharp = np.maximum(y + ramp * (y - gaussian(y, sigma)), 0.0)
    top, now = y.max(-1, keepdims=True), sharp.max(-1, keepdims=True)
    scaled = sharp * np.where(now > 0, top / np.where(now > 0, now, 1), 1)
    return np.where(top > 0, scaled, y)


def blob_end(y: np.ndarray, limit: int = 500, settle: int = 20, share: float = 0.4) -> int:
    total = y.sum(0)
    n = len(total)
    limit = min(limit, n)
    at = int(np.argmax(total[:limit])) if n else 0
    if not n or total[at] <= 0:
        return 0
    low = total < share * total[at]
    if n > settle:
        calm = sliding_window_view(low, settle).all(-1)[at : n - settle]
        if calm.any():
            return at + int(np.argmax(calm))
    return min(at + 50, limit)


def shifted(y: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(y)
    if abs(by) < len(y):
        out[max(by, 0) : len(y) + min(by, 0)] = y[max(-by, 0) : len(y) - max(by, 0)]
    return out


def unmixed(y: np.ndarray, inverse: np.ndarray, shifts: tuple[int, ...]) -> np.ndarray:
    """Shift the channels, apply the inverse matrix, cut at zero."""
    if any(shifts):
        y = np.stack([shifted(row, s) for row, s in zip(y, shifts, strict=True)])
    return np.maximum(inverse @ y, 0.0)
