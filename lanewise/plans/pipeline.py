"""The whole pipeline from traces to calls, sequences and statistics: one Python stage a trace, then DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.arrays import let
from ..functions.scalars import reverse_complement, trim_primer
from ..kernels import basecall as kb
from ..kernels import peaks as kp
from ..kernels import signal as ks
from ..operators import calls as C
from ..operators.samples import unmixing
from ..operators.traces import signal_of
from ..params import PipelineParams
from ..schema import CALLS

STAGES = ("raw", "crosstalk", "baseline", "noise_floor", "smooth", "running_noise", "snr_map", "mobility", "sharpened", "final")
_CALL = CALLS.replace("trace_id string, ", "")
RESULT = f"trace_id string, path string, sample_name string, mobility_applied boolean, blob_end int, calls array<struct<{', '.join(c.replace(' ', ':', 1) for c in _CALL.split(', ')) }>>, stages map<string,array<array<double>>>, error string"


def process(y: np.ndarray, time: np.ndarray, p: PipelineParams, inverse: np.ndarray, keep: bool = False) -> dict:
    """One trace through all array steps."""
    kept: dict[str, np.ndarray] = {"raw": y}
    kept["crosstalk"] = ks.unmixed(y, inverse, p.channel_shifts)
    kept["baseline"], kept["noise_floor"] = ks.baseline(kept["crosstalk"], p.baseline_method, p.baseline_win)
    kept["smooth"] = ks.smooth(kept["baseline"], p.sg_win, p.sg_poly, p.sg_passes, p.sg_mode)
    kept["mobility"], applied = kp.mobility(kept["smooth"], p.prom) if p.mobility_enabled else (kept["smooth"], False)
    kept["sharpened"] = kept["final"] = last = ks.sharpen_tail(kept["mobility"], sigma=p.sigma, amount=p.amount)
    blob = ks.blob_end(last) if p.auto_trim_blob else 0
    noise = ks.running_noise(last, p.noise_floor_window, p.noise_floor_percentile)
    calls = kb.columns(kb.call(last, p, blob, noise), last, time, p)
    if keep:
        kept["running_noise"] = ks.running_noise(kept["smooth"], p.noise_floor_window, p.noise_floor_percentile)
        kept["snr_map"] = np.clip(kept["smooth"] / (kept["noise_floor"] + 1e-9), 0.0, 50.0)
    return {"mobility_applied": applied, "blob_end": blob, "calls": calls, "stages": {k: kept[k] for k in STAGES} if keep else None, "error": None}


def _listed(calls: list[dict[str, np.ndarray] | None], kind: pa.DataType) -> pa.Array:
    """array<struct> of calls from their columns; none where a trace failed."""
    ends = np.cumsum([0] + [len(c["pos"]) if c else 0 for c in calls])
    some = [c for c in calls if c]
    fields = [pa.array(np.concatenate([c[f.name] for c in some]) if some else [], f.type) for f in kind.value_type]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind)


def _mapped(stages: list[dict[str, np.ndarray] | None], kind: pa.DataType) -> pa.Array:
    if not any(stages):
        return pa.nulls(len(stages), kind)
    return pa.array([s and [(k, v.tolist()) for k, v in s.items()] for s in stages], kind)


def run(traces: DataFrame, params: PipelineParams = PipelineParams(), stages: bool = False) -> DataFrame:
    """Results of each trace: calls, blob end, whether mobility was corrected, and an error text where a trace failed
    (the others go on). Wanted stages come as arrays."""
    inverse = unmixing(params.matrix)
    schema = to_arrow_schema(_parse_datatype_string(RESULT))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            out = []
            for row in range(one.num_rows):
                fault = one.column(5)[row].as_py()
                try:
                    if fault:
                        raise ValueError(fault)
                    y = signal_of(one.column(4)[row])
                    if y.shape[0] != 4:
                        raise ValueError(f"{y.shape[0]} channels; four are needed")
                    time = one.column(3)[row]
                    time = time.values.to_numpy(zero_copy_only=False).astype(float) if time.is_valid else np.arange(y.shape[1], dtype=float)
                    out.append(process(y, time, params, inverse, stages))
                except Exception as why:  # a broken trace is reported in its row
                    out.append({"mobility_applied": None, "blob_end": None, "calls": None, "stages": None, "error": f"{type(why).__name__}: {why}"})
            plain = [pa.array([r[k] for r in out], schema.field(k).type) for k in ("mobility_applied", "blob_end")]
            yield pa.RecordBatch.from_arrays([*(one.column(k) for k in range(3)), *plain, _listed([r["calls"] for r in out], schema.field("calls").type), _mapped([r["stages"] for r in out], schema.field("stages").type), pa.array([r["error"] for r in out], pa.string())], schema=schema)

    have = set(traces.columns)
    wanted = {"trace_id": "string", "path": "string", "sample_name": "string", "time": "array<double>", "signals": "array<array<double>>", "error": "string"}
    columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()]
    return traces.select(*columns).mapInArrow(work, RESULT)


def trim_calls(results: DataFrame, primer: str) -> DataFrame:
    """Cut the calls up to the primer's end; primer_trim_pos says how many went."""
    text = F.array_join(F.transform("calls", lambda c: c["letter"]), "")
    cut = trim_primer(text, primer)["cut"] if primer else F.lit(0)
    return results.withColumn("primer_trim_pos", cut).withColumn("calls", F.slice("calls", F.col("primer_trim_pos") + 1, F.greatest(F.size("calls"), F.lit(1))))


def base_calls(results: DataFrame) -> DataFrame:
    """One row a call."""
    return results.select("trace_id", F.posexplode("calls").alias("_k", "c")).select("trace_id", F.col("_k").alias("_n"), "c.*").withColumn("ordinal", F.col("_n")).drop("_n")


def summarise(results: DataFrame, params: PipelineParams = PipelineParams()) -> DataFrame:
    """Per trace: sequence, its reverse complement, trimmed sequences, statistics and the counts of the batch summary.
    Average quality is that before primer trimming. A trace's calls are in its row, so everything is array expressions
    there: the results are read once and nothing is shuffled or kept. A trace without calls has no statistics."""
    sure = F.filter("calls", lambda c: ~c["tail_rescued"] & ~c["imputed"])
    average = let(sure, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, c: s + c["phred"]) / F.size(x)).otherwise(0.0))
    trimmed = trim_calls(results.withColumn("avg_quality", average), params.primer_sequence)
    text = F.array_join(F.transform("calls", lambda c: c["letter"]), "")
    count = lambda k: F.size(F.filter("calls", lambda c: c[k]))
    # calls are numbered anew after the cut
    numbered = F.transform("calls", lambda c, k: c.withField("ordinal", k))
    kept = ("path", "sample_name", "mobility_applied", "blob_end", "primer_trim_pos", "error", "avg_quality")
    rows = trimmed.select("trace_id", F.struct(*kept, text.alias("sequence"), count("heterozygote").alias("n_heterozygotes"), count("imputed").alias("n_imputed")).alias("_row"), numbered.alias("calls"))
    found = C.row_statistics(rows, params.window_trim_min_q, params.window_trim_size)
    stats = [c for c in found.columns if c not in ("trace_id", "start", "end", "_row")]
    met = found.select("trace_id", "_row.*", "start", "end", F.when(F.col("total_bases") > 0, F.struct(*stats)).alias("quality_stats"))
    cut = lambda a, b: F.coalesce(F.substr("sequence", F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int")), F.lit(""))
    out = F.struct(
        "trace_id", "path", "sample_name", "sequence", reverse_complement(F.col("sequence")).alias("sequence_rc"), cut("start", "end").alias("window_trimmed_seq"),
        cut("quality_stats.blast_start", "quality_stats.blast_end").alias("blast_window"), "avg_quality", "mobility_applied", "quality_stats", "blob_end", "primer_trim_pos", "n_heterozygotes", "n_imputed",
        F.lit(params.baseline_method).alias("baseline_method"), "error",
    )
    return met.select(F.inline(F.array(out)))
