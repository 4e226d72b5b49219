"""Operators on whole traces: one row a trace with its four channels as arrays, run through the NumPy kernels by Arrow
batches. A trace is a few thousand samples, so rows are bounded; batches are kept small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..kernels import matrix as km
from ..kernels import peaks as kp
from ..kernels import signal as ks
from .samples import WIDE

#: Numbers in the signals that a kernel gets at once, about: so much of a batch is worked on, and sent on, at a time.
BATCH = 1 << 19


def traces(samples: DataFrame) -> DataFrame:
    """trace_id and signals (four arrays in sample order), from wide samples: one shuffle by trace."""
    ordered = F.sort_array(F.collect_list(F.struct("i", *WIDE)))
    rows = samples.groupBy("trace_id").agg(ordered.alias("s"))
    return rows.select("trace_id", F.array(*[F.col(f"s.{c}") for c in WIDE]).alias("signals"))


def signal_of(value: pa.Scalar) -> np.ndarray:
    """A 4 x N array from a list of lists."""
    lists = value.values
    size = len(lists[0]) if len(lists) else 0
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size).astype(float)


def per_trace(df: DataFrame, key: str, of: Callable[[np.ndarray], list[dict]], schema: str, signals: str = "signals") -> DataFrame:
    """Rows that of(signals) gives for each trace, with the trace's key in front."""
    kind = dict(df.dtypes)[key]
    names = to_arrow_schema(_parse_datatype_string(f"{key} {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            out = []
            for name, value in zip(one.column(0).to_pylist(), one.column(1), strict=True):
                out += [{key: name, **row} for row in of(signal_of(value))]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=names)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=names)

    return df.select(key, signals).mapInArrow(run, f"{key} {kind}, {schema}")


def lanes(df: DataFrame, *arrays: str) -> DataFrame:
    """Long rows (trace_id, ch, i, values) from arrays of four channels."""
    zipped = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    channel = df.select("trace_id", F.posexplode(zipped).alias("ch", "x"))
    inner = channel.select("trace_id", "ch", F.posexplode(F.arrays_zip(*[F.col(f"x.{a}").alias(a) for a in arrays])).alias("i", "v"))
    return inner.select("trace_id", "ch", F.col("i").cast("bigint").alias("i"), *[F.col(f"v.{a}").alias(a) for a in arrays])


def nested(arrays: list[np.ndarray]) -> pa.Array:
    """array<array<double>> of 2-d arrays, from their buffers."""
    rows = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    sizes = np.repeat([a.shape[1] for a in arrays], np.diff(rows)) if arrays else np.zeros(0, int)
    flat = np.concatenate([np.ascontiguousarray(a, float).ravel() for a in arrays]) if arrays else np.zeros(0)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), inner)


def portions(keys: pa.Array, values: pa.Array) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Keys and signals of an Arrow batch's traces, about BATCH numbers at a time and one trace at least."""
    start, signals, size = 0, [], 0
    for k, value in enumerate(values):
        signals.append(signal_of(value))
        size += signals[-1].size
        if size >= BATCH or k == len(values) - 1:
            yield keys.slice(start, len(signals)), signals
            start, signals, size = k + 1, [], 0


def per_signals(df: DataFrame, of: Callable[[list[np.ndarray]], list[tuple[np.ndarray, ...]]], *names: str, signals: str = "signals") -> DataFrame:
    """trace_id and the 2-d arrays that of(several signals) gives for each of them, as columns of these names."""
    kind = dict(df.dtypes)["trace_id"]
    schema = f"trace_id {kind}, " + ", ".join(f"{n} array<array<double>>" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for keys, some in portions(one.column(0), one.column(1)):
                done = of(some)
                yield pa.RecordBatch.from_arrays([keys, *[nested([d[k] for d in done]) for k in range(len(names))]], ["trace_id", *names])

    return df.select("trace_id", signals).mapInArrow(run, schema)


def per_signal(df: DataFrame, of: Callable[[np.ndarray], tuple[np.ndarray, ...]], *names: str, signals: str = "signals") -> DataFrame:
    """trace_id and the 2-d arrays that of(signals) gives for each trace, as columns of these names."""
    return per_signals(df, lambda some: [of(y) for y in some], *names, signals=signals)


def baseline(df: DataFrame, method: str = "rolling", window: int = 101) -> DataFrame:
    """trace_id, baseline and y: the floor and the corrected channels."""
    if method == "als":
        return per_signals(df, lambda some: [fit[::-1] for fit in ks.als_baselines(some)], "baseline", "y")
    return per_signal(df, lambda y: ks.baseline(y, method, window)[::-1], "baseline", "y")


def baseline_lanes(samples: DataFrame, method: str, window: int = 101) -> DataFrame:
    return lanes(baseline(traces(samples), method, window), "baseline", "y")


def envelope_lanes(samples: DataFrame, width: int = 300, fraction: float = 0.03) -> DataFrame:
    """The envelope of each channel and the signal over it, as operators.samples.envelope() gives them by windows."""
    return lanes(per_signal(traces(samples), lambda y: ks.envelope(y, width, fraction), "envelope", "normal"), "envelope", "normal")


def noise_lanes(samples: DataFrame, window: int, percent: float) -> DataFrame:
    return lanes(per_signal(traces(samples), lambda y: (ks.running_noise(y, window, percent),), "noise"), "noise")


def smoothed(df: DataFrame, width: int = 19, order: int = 3, passes: int = 1, mode: str = "interp") -> DataFrame:
    return per_signal(df, lambda y: (ks.smooth(y, width, order, passes, mode),), "y")


def sharpened(df: DataFrame, amount: float, sigma: float = 0.4) -> DataFrame:
    return per_signal(df, lambda y: (ks.sharpen_tail(y, sigma=sigma, amount=amount),), "y")


def aligned(df: DataFrame, prominence: float = 0.01) -> DataFrame:
    """The channels after the correction of mobility; a trace of too few peaks stays as it is."""
    return per_signal(df, lambda y: (kp.mobility(y, prominence)[0],), "y")


def found_peaks(df: DataFrame, prominence: float = 0.002, distance: int = 2, adaptive: bool = True) -> DataFrame:
    """Peaks of each channel with their shape scores; those of a portion's traces are fitted together."""
    kind = dict(df.dtypes)["trace_id"]
    schema = f"trace_id {kind}, ch int, pos bigint, amp double, shape double"

    def of(row: np.ndarray) -> np.ndarray:
        return kp.find_adaptive(row, prominence, distance) if adaptive else kp.find(row, max(prominence * float(row.max(initial=0.0)), 1e-6), distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for keys, some in portions(one.column(0), one.column(1)):
                found = [[of(row) for row in y] for y in some]
                at = [np.concatenate(peaks) if peaks else np.zeros(0, int) for peaks in found]
                ch = [np.repeat(np.arange(len(peaks)), [len(p) for p in peaks]) for peaks in found]
                near = [kp.around(y, p, c) for y, p, c in zip(some, at, ch)]
                shape = kp.shapes_of(*map(np.concatenate, zip(*near)))
                amp = np.concatenate([y[c, p] for y, p, c in zip(some, at, ch)])
                trace = keys.take(pa.array(np.repeat(np.arange(len(some)), [len(p) for p in at])))
                yield pa.RecordBatch.from_arrays([trace, pa.array(np.concatenate(ch), pa.int32()), pa.array(np.concatenate(at), pa.int64()), pa.array(amp), pa.array(shape)], ["trace_id", "ch", "pos", "amp", "shape"])

    return df.select("trace_id", "signals").mapInArrow(run, schema)


def estimated(df: DataFrame, method: str = "peaks") -> DataFrame:
    """Crosstalk matrix of each trace in long form, by 'peaks' or 'nmf', on baseline-corrected channels."""

    def of(y: np.ndarray) -> list[dict]:
        m = km.from_factors(km.corrected(y)) if method == "nmf" else km.from_peaks(km.corrected(y))
        return [{"row": r, "col": c, "v": float(m[r, c])} for r in range(4) for c in range(4)]

    return per_trace(df, "trace_id", of, "row int, col int, v double").withColumnRenamed("trace_id", "matrix_id")


def fitted(df: DataFrame, rounds: int = 10) -> DataFrame:
    """trace_id, y, z and w: channels, their curves of asymmetric least squares and the weights these were solved with."""
    return per_signals(df, lambda some: [(y, *fit) for y, fit in zip(some, ks.als_fits(some, rounds=rounds))], "y", "z", "w")


def factors(df: DataFrame) -> DataFrame:
    """trace_id, s (corrected channels), w and h: the factorisation s' = w' h behind the estimate 'nmf'."""

    def of(y: np.ndarray) -> tuple[np.ndarray, ...]:
        s = km.corrected(y)
        w, h = km.factorised(s.T)
        return s, w.T, h

    return per_signal(df, of, "s", "w", "h")
