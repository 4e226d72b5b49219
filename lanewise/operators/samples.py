"""Operators on samples: long rows (trace_id, ch, i, y), or wide ones with the four channels as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.scalars import argmax, heterozygote, isolation_ratio

WIDE = ("g", "a", "t", "c")


def _lane() -> WindowSpec:
    return Window.partitionBy("trace_id", "ch").orderBy("i")


def _trace() -> WindowSpec:
    return Window.partitionBy("trace_id").orderBy("i")


def long(samples: DataFrame) -> DataFrame:
    """One row a channel and sample."""
    return samples.select("trace_id", "i", F.posexplode(F.array(*WIDE)).alias("ch", "y"))


def wide(lanes: DataFrame) -> DataFrame:
    return lanes.groupBy("trace_id", "i").agg(*[F.max(F.when(F.col("ch") == k, F.col("y"))).alias(c) for k, c in enumerate(WIDE)])


def shift(samples: DataFrame, shifts: tuple[int, int, int, int]) -> DataFrame:
    """Delay each channel by its shift (advance where negative); zeros come in. One window over the trace serves all
    channels."""
    moved = [(F.lag(c, s, 0.0).over(_trace()) if s >= 0 else F.lead(c, -s, 0.0).over(_trace())).alias(c) if s else F.col(c) for c, s in zip(WIDE, shifts, strict=True)]
    return samples.select("trace_id", "i", *moved)


def unmixing(matrix) -> np.ndarray:
    """Inverse of a crosstalk matrix; its pseudo-inverse where it is close to singular."""
    m = np.asarray(matrix, float)
    return np.linalg.inv(m) if np.linalg.cond(m) <= 1000 else np.linalg.pinv(m)


def unmix(samples: DataFrame, matrix, shifts: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Separate the dyes: shift, apply the inverse, cut at zero. The 4 x 4 inverse is part of the plan."""
    inv = unmixing(matrix)
    shifted = shift(samples, shifts) if any(shifts) else samples
    rows = [F.greatest(sum((float(inv[r, k]) * F.col(c) for k, c in enumerate(WIDE)), F.lit(0.0)), F.lit(0.0)).alias(WIDE[r]) for r in range(4)]
    return shifted.select("trace_id", "i", *rows)


def snr_map(lanes: DataFrame, floor: str = "floor") -> DataFrame:
    """Signal over noise floor, from 0 to 50."""
    return lanes.withColumn("snr", F.least(F.greatest(F.col("y") / (F.col(floor) + 1e-9), F.lit(0.0)), F.lit(50.0)))


def envelope(lanes: DataFrame, width: int = 300, fraction: float = 0.03) -> DataFrame:
    """Moving maximum (an even window starts width / 2 before), at least a share of the channel's maximum, and y over it."""
    frame = _lane().rowsBetween(-(width // 2), width - width // 2 - 1)
    most = F.max("y").over(Window.partitionBy("trace_id", "ch"))
    out = lanes.withColumn("envelope", F.greatest(F.max("y").over(frame), most * fraction))
    return out.withColumn("normal", F.when(F.col("envelope") > 0, F.col("y") / F.col("envelope")).otherwise(0.0))


def opened(lanes: DataFrame, width: int = 101) -> DataFrame:
    """Morphological opening: moving minimum, then moving maximum. Frames cut at the ends equal mirrored ones."""
    half = width // 2
    low = lanes.withColumn("_low", F.min("y").over(_lane().rowsBetween(-half, half)))
    return low.withColumn("opened", F.max("_low").over(_lane().rowsBetween(-half, half))).drop("_low")


def mirrored(lanes: DataFrame, pad: int, repeat_edge: bool) -> DataFrame:
    """Rows with `pad` mirrored samples before and after; only samples near an end are copied."""
    n = F.count("*").over(Window.partitionBy("trace_id", "ch"))
    rows, k = lanes.withColumn("_n", n), 1 if repeat_edge else 0
    before = F.when((F.col("i") < pad + 1 - k) & (F.col("i") >= 1 - k), F.struct((-F.col("i") - k).alias("i"), F.col("y")))
    after = F.when((F.col("i") >= F.col("_n") - pad - 1 + k) & (F.col("i") < F.col("_n") - 1 + k), F.struct((2 * F.col("_n") - 2 + k - F.col("i")).alias("i"), F.col("y")))
    whole = F.struct(F.col("i"), F.col("y"))
    spread = rows.select("trace_id", "ch", "_n", F.explode(F.filter(F.array(before, whole, after), lambda x: x.isNotNull())).alias("x"))
    return spread.select("trace_id", "ch", "_n", "x.i", "x.y")


def moving_percentile(lanes: DataFrame, width: int, share: float, repeat_edge: bool) -> DataFrame:
    """Moving percentile as a window function over mirrored rows: the declarative twin of the array kernel."""
    half = width // 2
    frame = _lane().rowsBetween(-half, half)
    value = F.expr(f"percentile(y, {share})").over(frame)
    return mirrored(lanes, half, repeat_edge).withColumn("p", value).filter("i >= 0 and i < _n").drop("_n")


def blob_end(samples: DataFrame, limit: int = 500, settle: int = 20, share: float = 0.4) -> DataFrame:
    """Where the dye blob ends: after the largest summed sample among the first `limit`, the first place from which
    `settle` samples stay under a share of it; else 50 samples on."""
    rows = samples.select("trace_id", "i", sum((F.col(c) for c in WIDE[1:]), F.col("g")).alias("s"))
    ahead = F.max("s").over(_trace().rowsBetween(0, settle - 1))
    rows = rows.withColumn("ahead", ahead)
    peak = F.min(F.when(F.col("i") < limit, F.struct((-F.col("s")).alias("m"), F.col("i").alias("i"))))
    marked = rows.groupBy("trace_id").agg(peak.alias("p"), F.count("*").alias("n"))
    met = rows.join(marked.select("trace_id", "n", F.col("p.i").alias("at"), (-F.col("p.m")).alias("top")), "trace_id")
    calm = (F.col("i") >= F.col("at")) & (F.col("i") < F.col("n") - settle) & (F.col("ahead") < F.col("top") * share)
    out = met.groupBy("trace_id", "n", "at", "top").agg(F.min(F.when(calm, F.col("i"))).alias("i"))
    end = F.when(F.col("top") <= 0, F.lit(0)).otherwise(F.coalesce("i", F.least(F.col("at") + 50, F.lit(limit), F.col("n"))))
    return out.select("trace_id", end.cast("bigint").alias("blob_end"))


def channel_floor(lanes: DataFrame) -> DataFrame:
    """Noise floor of each channel: spread of the samples under a tenth of its maximum, not under half a percent of it."""
    most = F.max("y").over(Window.partitionBy("trace_id", "ch"))
    rows = lanes.withColumn("top", most)
    low = F.when(F.col("y") < 0.1 * F.col("top"), F.col("y"))
    out = rows.groupBy("trace_id", "ch").agg(F.max("top").alias("top"), F.count(low).alias("n"), F.stddev_pop(low).alias("sd"))
    floor = F.when(F.col("top") <= 0, 1e-6).when(F.col("n") < 20, F.greatest(F.col("top") * 0.01, F.lit(1e-6))).otherwise(F.greatest("sd", F.col("top") * 0.005, F.lit(1e-6)))
    return out.select("trace_id", "ch", floor.alias("floor"))


def sample_features(samples: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Isolation, largest channel and heterozygote fields of each sample."""
    y = [F.col(c) for c in WIDE]
    return samples.select("trace_id", "i", isolation_ratio(*y).alias("isolation"), argmax(*y).alias("channel"), heterozygote(*y, threshold).alias("h")).select("trace_id", "i", "isolation", "channel", "h.*")


def local_maxima(lanes: DataFrame) -> DataFrame:
    """Samples above both neighbours (plateaus are left to the array kernel)."""
    rows = lanes.withColumns({"_b": F.lag("y").over(_lane()), "_a": F.lead("y").over(_lane())})
    return rows.filter("y > _b and y > _a").select("trace_id", "ch", F.col("i").alias("pos"), F.col("y").alias("amp"))


def suppress_shadows(peaks: DataFrame, ratio: float = 0.25, low: int = 2, high: int = 8) -> DataFrame:
    """Drop peaks with a much larger peak of their channel `low` to `high` samples later. All tests see all peaks. The
    later peaks within reach are found in one window, so no pair of peaks is made."""
    near = Window.partitionBy("trace_id", "ch").orderBy("pos").rangeBetween(low, high)
    largest = F.max("amp").over(near)
    return peaks.withColumn("_q", largest).filter(F.col("_q").isNull() | ~((F.col("_q") > 0) & (F.col("amp") / (F.col("_q") + 1e-9) <= ratio))).drop("_q")


def call_filters(peaks: DataFrame, floors: DataFrame, min_snr: float = 1.0) -> DataFrame:
    """Signal-to-noise of each peak, without those under the hard floors."""
    met = peaks.join(floors, ["trace_id", "ch"])
    return met.withColumn("snr", F.col("amp") / F.greatest("floor", F.lit(1e-9))).filter((F.col("amp") >= 1e-6) & (F.col("snr") >= min_snr * 0.15))


def normal_places(peaks: DataFrame, samples: DataFrame, blobs: DataFrame) -> DataFrame:
    """Peaks (trace_id, pos, ...) from their blob's end on, with place, 0 there and 1 after the last sample."""
    sizes = samples.groupBy("trace_id").agg(F.count("*").alias("_n"))
    met = peaks.join(sizes.join(blobs, "trace_id"), "trace_id").filter("pos >= blob_end")
    return met.withColumn("place", (F.col("pos") - F.col("blob_end")) / F.greatest(F.col("_n") - F.col("blob_end"), F.lit(1))).drop("_n", "blob_end")


def smoother_residual(lanes: DataFrame, stiffness: float = 1e5) -> DataFrame:
    """How far curves z with weights w over samples y (lanes: trace_id, ch, i, y, z, w) are from solving (W + stiffness D'D) z =
    W y: n and worst, the largest difference of the two sides."""
    bend = F.col("z") - 2.0 * F.lead("z", 1).over(_lane()) + F.lead("z", 2).over(_lane())
    some = lambda k: F.coalesce(F.lag("_d", k).over(_lane()) if k else F.col("_d"), F.lit(0.0))
    rows = lanes.withColumn("_d", bend)
    rows = rows.withColumn("_r", F.abs(F.col("w") * (F.col("z") - F.col("y")) + stiffness * (some(0) - 2.0 * some(1) + some(2))))
    return rows.groupBy("trace_id", "ch").agg(F.count("*").alias("n"), F.max("_r").alias("worst"))


def curve_residual(curves: DataFrame, stiffness: float = 1e5) -> DataFrame:
    """smoother_residual() of whole curves (trace_id and arrays y, z, w of four channels): worked out in each trace's row, so
    no sample is shuffled or sorted."""

    def of(x: Column) -> Column:
        size = F.size(x["z"])
        at = lambda name, i: F.get(x[name], i)
        inner = F.when(size > 2, F.transform(F.slice(x["z"], 1, F.greatest(size - 2, F.lit(0))), lambda z, i: z - 2.0 * at("z", i + 1) + at("z", i + 2))).otherwise(F.array().cast("array<double>"))

        def left(d: Column) -> Column:
            some = lambda i: F.coalesce(F.get(d, i), F.lit(0.0))
            return F.transform(x["z"], lambda z, i: F.abs(at("w", i) * (z - at("y", i)) + stiffness * (some(i) - 2.0 * some(i - 1) + some(i - 2))))

        return F.array_max(let(inner, left))

    lanes = curves.select("trace_id", F.posexplode(F.arrays_zip("y", "z", "w")).alias("ch", "x"))
    return lanes.filter(F.size("x.z") > 0).select("trace_id", "ch", F.size("x.z").cast("bigint").alias("n"), of(F.col("x")).alias("worst"))


def factor_residual(factors: DataFrame) -> DataFrame:
    """Of a factorisation (trace_id, s: channels x samples, w: components x samples, h: components x channels): n samples,
    error, the squared distance of s from its product over that of s from zero, and least, the smallest entry of the
    factors."""
    each = factors.select("trace_id", "h", F.posexplode(F.arrays_zip(*[F.get(x, F.lit(k)).alias(f"{x}{k}") for x in ("s", "w") for k in range(4)])).alias("i", "v"))
    row = lambda ch: sum((F.col(f"v.w{k}") * F.get(F.get("h", F.lit(k)), F.lit(ch)) for k in range(1, 4)), F.col("v.w0") * F.get(F.get("h", F.lit(0)), F.lit(ch)))
    parts = [F.pow(F.col(f"v.s{ch}") - row(ch), F.lit(2.0)) for ch in range(4)]
    whole = [F.pow(F.col(f"v.s{ch}"), F.lit(2.0)) for ch in range(4)]
    low = F.least(*[F.col(f"v.w{k}") for k in range(4)], F.array_min(F.flatten("h")))
    return each.groupBy("trace_id").agg(F.count("*").alias("n"), (F.sum(sum(parts[1:], parts[0])) / F.sum(sum(whole[1:], whole[0]))).alias("error"), F.min(low).alias("least"))
