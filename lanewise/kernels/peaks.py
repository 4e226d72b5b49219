"""Peaks of one channel: finding, shape, and the correction of dye mobility between channels."""

from __future__ import annotations

import numpy as np

from .signal import moving_max, shifted


def maxima(y: np.ndarray) -> np.ndarray:
    """Local maxima; a plateau counts once, at its middle (the lower one of two). Plateaus at the ends don't count."""
    if len(y) < 3:
        return np.zeros(0, int)
    start = np.concatenate([[0], np.flatnonzero(np.diff(y)) + 1])
    end = np.append(start[1:], len(y)) - 1
    level = y[start]
    top = np.zeros(len(start), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (start[top] + end[top]) // 2


def spaced(y: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """Peaks at least `distance` apart: from the highest on, each removes its lower neighbours."""
    if distance <= 2 or not len(peaks):
        return peaks
    alive = np.ones(len(peaks), bool)
    for k in np.argsort(y[peaks], kind="stable")[::-1]:
        if alive[k]:
            alive[np.searchsorted(peaks, peaks[k] - distance, "right") : np.searchsorted(peaks, peaks[k] + distance)] = False
            alive[k] = True
    return peaks[alive]


def _lows(y: list[float]) -> list[float]:
    """For each sample the lowest one from just after the last higher sample up to it."""
    out, open_ = [], []
    for v in y:
        low = v
        while open_ and open_[-1][0] <= v:
            low = min(low, open_.pop()[1])
        open_.append((v, low))
        out.append(low)
    return out


def prominences(y: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points between the peak and the next higher sample on each side."""
    left, right = _lows(y.tolist()), _lows(y[::-1].tolist())[::-1]
    return y[peaks] - np.maximum(np.array(left)[peaks], np.array(right)[peaks]) if len(peaks) else np.empty(0)


def find(y: np.ndarray, prominence: float | None = None, distance: int = 1) -> np.ndarray:
    peaks = spaced(y, maxima(y), distance)
    return peaks if prominence is None else peaks[prominences(y, peaks) >= prominence]


def find_adaptive(y: np.ndarray, prominence: float, distance: int, width: int = 300, share: float = 0.03) -> np.ndarray:
    """Peaks of the signal over its envelope, so that late, weak ones count like early ones."""
    top = float(y.max(initial=0.0))
    if top <= 0:
        return np.zeros(0, int)
    return find(y / np.maximum(moving_max(y, max(3, width)), top * share), prominence, distance)


def channel_floor(y: np.ndarray) -> float:
    top = float(y.max(initial=0.0))
    if top <= 0:
        return 1e-6
    low = y[y < 0.1 * top]
    return max(top * 0.01, 1e-6) if len(low) < 20 else max(float(low.std()), top * 0.005, 1e-6)


def local_noise(y: np.ndarray, at: int, floor: float, half: int = 20) -> float:
    """Spread (interquartile range / 1.35) around a place, without the place itself."""
    near = np.arange(max(0, at - half), min(len(y), at + half))
    near = near[(near < at - 5) | (near > at + 5)]
    values = y[near] if len(near) >= 6 else y[max(0, at - 10) : at + 11]
    if len(near) < 6 and len(values) < 4:
        return floor
    high, low = np.percentile(values, [75, 25])
    return max(float(high - low) / 1.35, floor)


#: Samples on either side of a peak that its shape is told by, and peaks that are fitted together.
HALF, PEAKS = 8, 4096


def around(y: np.ndarray, peaks: np.ndarray, channels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples around each peak (of a 4 x N array's named channels), zeros beyond the trace, and which are inside it."""
    n = y.shape[1]
    at = peaks[:, None] + np.arange(-HALF, HALF + 1)
    inside = (at >= 0) & (at < n)
    return np.where(inside, y[channels[:, None], np.clip(at, 0, n - 1)], 0.0), inside


def shapes(y: np.ndarray, peaks: np.ndarray, channels: np.ndarray | None = None) -> np.ndarray:
    """Shape score of each peak (of a channel, or of a 4 x N array's named channels)."""
    y = y[None] if y.ndim == 1 else y
    if not len(peaks):
        return np.zeros(0)
    return shapes_of(*around(y, peaks, np.zeros(len(peaks), int) if channels is None else channels))


def shapes_of(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Shape scores of peaks by the samples around them: 0.4 of the symmetry and 0.6 of the R squared of a bounded Gaussian
    fit. All peaks, of any traces, are fitted together, by damped least squares with the parameters kept in bounds."""
    out = np.full(len(values), 0.5)
    top = np.where(inside, values, -np.inf).max(1)
    use = (inside.sum(1) >= 5) & (top > 0)
    if not use.any():
        return out
    values, inside, top = values[use], inside[use], top[use]
    left, right = values[:, :HALF].sum(1), values[:, HALF + 1 :].sum(1)
    symmetry = 1.0 - np.abs(left - right) / (left + right + 1e-9)
    scaled = values / (top[:, None] + 1e-9)
    fitted = _gaussians(np.arange(-HALF, HALF + 1.0), scaled, inside)
    count = inside.sum(1)
    mean = (scaled * inside).sum(1) / count
    rest = (((scaled - fitted) ** 2) * inside).sum(1)
    total = (((scaled - mean[:, None]) ** 2) * inside).sum(1)
    out[use] = 0.4 * symmetry + 0.6 * np.maximum(0.0, 1.0 - rest / (total + 1e-10))
    return out


def _gaussians(x: np.ndarray, y: np.ndarray, inside: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Fitted values, PEAKS rows at a time."""
    parts = [_fitted(x[:, None], np.ascontiguousarray(y[k : k + PEAKS].T), np.ascontiguousarray(inside[k : k + PEAKS].T, float), rounds).T for k in range(0, len(y), PEAKS)]
    return np.concatenate(parts) if parts else y


def _fitted(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int) -> np.ndarray:
    """Fitted values, a column a peak. The normal equations are sums of u ** k under the squared bell; a peak whose fit no
    longer gains or moves leaves the rounds, and the columns are closed up when a quarter has left."""
    low, high = np.array([[0.0], [x[0, 0]], [0.3]]), np.array([[1.5], [x[-1, 0]], [x[-1, 0]]])
    out, at = np.empty_like(y), np.arange(y.shape[1])
    p, damp = np.repeat([[1.0], [0.0], [2.0]], len(at), 1), np.full(len(at), 1e-2)
    total = lambda one, two: np.einsum("ij,ij->j", one, two)

    def model(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = (x - q[1]) / q[2]
        bell = np.exp(-0.5 * u * u)
        return u, bell, (y - q[0] * bell) * held

    u, bell, rest = model(p)
    loss, live = total(rest, rest), np.ones(len(at), bool)
    for _ in range(rounds):
        h = bell * held
        b, r, k = h * bell, rest * bell, p[0] / p[2]
        bu, uu = b * u, u * u
        s1, s2, s3, s4 = bu.sum(0), total(bu, u), total(bu, uu), total(bu * u, uu)
        more = 1.0 + damp
        n00, n11, n22 = b.sum(0) * more + 1e-12, k * k * s2 * more + 1e-12, k * k * s4 * more + 1e-12
        n01, n02, n12 = k * s1, k * s2, k * k * s3
        t = np.stack([r.sum(0), k * total(r, u), k * total(r, uu)])
        # a parameter that is pushed against its bound stays there, and the others are solved without it
        free = ~(((p <= low) & (t < 0)) | ((p >= high) & (t > 0)))
        t0, t1, t2 = t * free
        n01, n02, n12 = n01 * (free[0] & free[1]), n02 * (free[0] & free[2]), n12 * (free[1] & free[2])
        l1, l2 = n01 / n00, n02 / n00
        d1, e = np.maximum(n11 - l1 * n01, 1e-15), n12 - l1 * n02
        l3 = e / d1
        d2 = np.maximum(n22 - l2 * n02 - l3 * e, 1e-15)
        z1 = t1 - l1 * t0
        q2 = (t2 - l2 * t0 - l3 * z1) / d2
        q1 = z1 / d1 - l3 * q2
        trial = np.clip(p + np.stack([t0 / n00 - l1 * q1 - l2 * q2, q1, q2]), low, high)
        tu, tbell, trest = model(trial)
        new = total(trest, trest)
        better = (new < loss) & live
        stays = np.where(better, loss - new > 1e-12, np.abs(trial - p).max(0) > 1e-6)
        for old, now in ((p, trial), (u, tu), (bell, tbell), (rest, trest), (loss, new)):
            np.copyto(old, now, where=better)
        damp = np.where(better, np.maximum(damp / 5, 1e-9), np.minimum(damp * 4, 1e9))
        live &= stays & (damp < 1e6)
        left = int(live.sum())
        if not left:
            break
        if left < 0.75 * len(at):
            out[:, at[~live]] = p[0, ~live] * bell[:, ~live]
            at, damp, loss = at[live], damp[live], loss[live]
            p, u, bell, rest, y, held = (np.ascontiguousarray(v[:, live]) for v in (p, u, bell, rest, y, held))
            live = np.ones(left, bool)
    out[:, at] = p[0] * bell
    return out


def mobility(y: np.ndarray, prominence: float, degree: int = 3) -> tuple[np.ndarray, bool]:
    """Align the channels with their sum: a lag from the cross-correlation, then a smooth drift through matched peaks."""
    total, n = y.sum(0), y.shape[1]
    marks = find(total, prominence * np.percentile(total, 90))
    if len(marks) < 4:
        return y.copy(), False
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.conj(np.fft.rfft(total, size))
    out = np.zeros_like(y)
    for ch, row in enumerate(y):
        across = np.fft.irfft(np.fft.rfft(row, size) * spectrum, size)
        lags = np.concatenate([across[-(n - 1) :], across[:n]]) if n > 1 else across[:1]
        lag = int(np.clip(int(np.argmax(lags)) - (n - 1), -n // 10, n // 10))
        moved = shifted(row, -lag)
        drift = matched_drift(marks, find(moved, prominence * np.percentile(moved, 90)))
        if drift is None:
            out[ch] = moved
            continue
        at, by = drift
        curve = np.polyval(np.polyfit(at, by, min(degree, len(at) - 1)), np.arange(n))
        when = np.arange(n, dtype=float) - curve
        # strictly increasing: a sample that doesn't advance follows its predecessor by a millionth
        while (stuck := np.flatnonzero(np.diff(when) <= 0)).size:
            first = int(stuck[0]) + 1
            ahead = np.flatnonzero(when[first:] > when[first - 1] + 1e-6 * np.arange(1, n - first + 1))
            stop = first + (int(ahead[0]) if ahead.size else n - first)
            when[first:stop] = when[first - 1] + 1e-6 * np.arange(1, stop - first + 1)
        out[ch] = np.interp(np.arange(n), when, moved, left=0.0, right=0.0)
    return out, True


def paired(marks: np.ndarray, peaks: np.ndarray, reach: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Each mark in turn takes the nearest peak that is still free (the earlier of two), if it is within reach: marks that
    took one, and how far on it is. Both arrays ascend, so a mark only looks at the peaks within its reach."""
    first = np.searchsorted(peaks, marks - reach, "right").tolist()
    last = np.searchsorted(peaks, marks + reach).tolist()
    places, free, at, by = peaks.tolist(), [True] * len(peaks), [], []
    for mark, a, b in zip(marks.tolist(), first, last):
        best = min(((abs(places[k] - mark), k) for k in range(a, b) if free[k]), default=None)
        if best:
            free[best[1]] = False
            at.append(mark)
            by.append(places[best[1]] - mark)
    return np.array(at, int), np.array(by, int)


def matched_drift(marks: np.ndarray, peaks: np.ndarray, reach: int = 20) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of marks and peaks; none under four peaks or pairs."""
    if len(peaks) < 4:
        return None
    at, by = paired(marks, peaks, reach)
    return (at, by) if len(at) >= 4 else None
