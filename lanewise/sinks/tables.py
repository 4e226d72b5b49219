"""Peak and batch tables as CSV, and matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHANNELS

#: Columns of the batch summary, in order.
SUMMARY = (
    "total_bases", "confirmed_bases", "tail_rescued", "window_trimmed_len", "blast_window_len", "blast_est_identity", "imputed_bases", "heterozygote_bases",
    "mean_phred", "median_phred", "pct_q20", "pct_q30", "pct_q35", "mean_snr", "mean_isolation", "mean_shape_score",
)
PEAKS = {
    "pos": "position", "time": "time", "letter": "base", "channel": "channel", "channel_name": "channel_name", "channel_color": "channel_color", "amplitude": "amplitude", "snr": "snr",
    "isolation": "isolation", "shape_score": "shape_score", "spacing_score": "spacing_score", "score": "quality_score", "phred": "phred", "noise": "noise_level",
    "tail_rescued": "tail_rescued", "imputed": "imputed", "heterozygote": "heterozygote", "het_channel": "het_channel", "het_ratio": "het_ratio",
}


def peak_table(calls: DataFrame) -> DataFrame:
    """The 19 columns of the peak export; channel names come from the fixed channel order."""
    pick = lambda k: F.get(F.array(*[F.lit(c[k]) for c in CHANNELS]), F.col("channel"))
    named = calls.withColumns({"channel_name": pick(1), "channel_color": pick(2)})
    return named.select(*[c for c in ("trace_id", "ordinal") if c in calls.columns], *[F.col(k).alias(v) for k, v in PEAKS.items()])


def summary_table(results: DataFrame) -> DataFrame:
    """File, sample name, 16 statistics and the pipeline's counts; missing statistics are 0."""
    file = F.regexp_extract("path", "([^/]*)$", 1).alias("file")
    return results.select(file, F.coalesce("sample_name", F.lit("")).alias("sample_name"), *[F.coalesce(F.col(f"quality_stats.{c}"), F.lit(0)).alias(c) for c in SUMMARY], "primer_trim_pos", "n_heterozygotes", "n_imputed", "baseline_method")


def write_csv(table: DataFrame, folder: str) -> None:
    table.write.option("header", True).csv(folder)


def matrix_text(matrix) -> str:
    """Rows of comma-separated numbers, without a header."""
    return "".join(",".join(repr(float(v)) for v in row) + "\n" for row in np.asarray(matrix, float))


def write_matrix(spark, matrix, folder: str) -> None:
    spark.createDataFrame([(matrix_text(matrix).rstrip("\n"),)], "value string").coalesce(1).write.text(folder)
