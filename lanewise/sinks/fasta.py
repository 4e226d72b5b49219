"""FASTA and FASTQ records, and their files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_stem, one_decimal, reverse_complement, trim_n, wrapped


def fasta_record(header: Column, seq: Column) -> Column:
    """'>' header, then lines of 80 letters."""
    return F.concat(F.lit(">"), header, F.lit("\n"), wrapped(seq))


def search_headers(results: DataFrame, suffix: str = "forward") -> Column:
    """Header of the search window's sequence, from columns name, sequence, blast_start, blast_end and the statistics."""
    parts = [F.col("name"), F.lit(f"_{suffix} length="), F.length("sequence"), F.lit(" blast_window="), F.col("blast_start"), F.lit("-"), F.col("blast_end")]
    parts += [F.lit(" mean_Q="), one_decimal(F.col("mean_phred")), F.lit(" pct_Q20="), one_decimal(F.col("pct_q20")), F.lit(" est_identity="), one_decimal(F.col("blast_est_identity")), F.lit("%")]
    return F.concat(*parts)


def batch_headers() -> Column:
    parts = [F.col("name"), F.lit(" length="), F.length("sequence"), F.lit(" mean_Q="), one_decimal(F.col("mean_phred")), F.lit(" pct_Q20="), one_decimal(F.col("pct_q20")), F.lit(" est_id="), one_decimal(F.col("blast_est_identity")), F.lit("%")]
    return F.concat(*parts)


def shift_text(shifts: tuple[int, int, int, int]) -> str:
    return " shifts=" + "_".join(f"{c}{s}" for c, s in zip("GATC", shifts, strict=True))


def single_header(kind: str, shifts: tuple[int, int, int, int], window: tuple[int, float] | None = None, text: Column | None = None) -> Column:
    """Header of one read's export, from columns sequence, mean_phred, pct_q20, primer_trim_pos, n_heterozygotes and
    n_imputed. kind: 'sequence', 'sequence_window_trimmed' (with its size and threshold) or 'reverse_complement'. The length
    is that of `text`, or of the sequence (of the reverse complement without end Ns)."""
    shown = text if text is not None else trim_n(F.col("sequence")) if kind == "reverse_complement" else F.col("sequence")
    parts = [F.lit(f"sanger_{kind} length="), F.length(shown), F.lit(" mean_Q="), one_decimal(F.col("mean_phred")), F.lit(" pct_Q20="), one_decimal(F.col("pct_q20"))]
    if window:
        parts.append(F.lit(f" window_size={window[0]} window_min_q={window[1]:.0f}"))
    parts.append(F.lit(shift_text(shifts)))
    optional = {"sequence": ("primer_trim", "het", "imputed"), "sequence_window_trimmed": ("primer_trim",)}.get(kind, ())
    columns = {"primer_trim": "primer_trim_pos", "het": "n_heterozygotes", "imputed": "n_imputed"}
    parts += [F.when(F.col(columns[o]) > 0, F.concat(F.lit(f" {o}="), columns[o])).otherwise("") for o in optional]
    return F.concat(*parts)


def search_pair(results: DataFrame) -> DataFrame:
    """name, forward and reverse records of the search window's sequence."""
    turned = fasta_record(search_headers(results, "reverse_complement"), reverse_complement(F.col("sequence")))
    return results.select("name", fasta_record(search_headers(results), F.col("sequence")).alias("forward"), turned.alias("reverse"))


def single_records(results: DataFrame, shifts: tuple[int, int, int, int], window: tuple[int, float]) -> DataFrame:
    """name and the three single exports as whole records: the sequence without end Ns, the trimmed window (column
    window_trimmed_seq) and the reverse complement without end Ns. An empty sequence gives an empty record."""
    texts = {"sequence": trim_n(F.col("sequence")), "sequence_window_trimmed": F.col("window_trimmed_seq"), "reverse_complement": trim_n(reverse_complement(F.col("sequence")))}
    out = []
    for (kind, text), name in zip(texts.items(), ("plain", "trimmed", "rc"), strict=True):
        header = single_header(kind, shifts, window if kind == "sequence_window_trimmed" else None, text)
        out.append(F.when(F.length(text) > 0, fasta_record(header, text)).otherwise("").alias(name))
    return results.select("name", *out)


def exportable(summary: DataFrame) -> DataFrame:
    """The columns that exports read, from the pipeline's summary: name (the sample's, else the file's stem), the search
    window's sequence as `sequence` with its place, and the statistics. Where the window is empty the read without end Ns
    stands in; reads without letters are left out."""
    name = F.coalesce(F.when(F.col("sample_name") != "", F.col("sample_name")), file_stem(F.col("path")), F.col("trace_id").cast("string"))
    stats = [F.col(f"quality_stats.{c}").alias(c) for c in ("blast_start", "blast_end", "mean_phred", "pct_q20", "blast_est_identity")]
    text = F.when(F.col("blast_window") != "", F.col("blast_window")).otherwise(trim_n(F.col("sequence")))
    rows = summary.select("trace_id", name.alias("name"), text.alias("sequence"), "window_trimmed_seq", "primer_trim_pos", "n_heterozygotes", "n_imputed", *stats)
    return rows.filter(F.length("sequence") > 0)


def reverse_path(path: str) -> str:
    """x.fasta -> x_rc.fasta; another ending is kept and _rc.fasta follows it."""
    return re.sub(r"\.(fasta|fa)$", r"_rc.\1", path) if re.search(r"\.(fasta|fa)$", path) else f"{path}_rc.fasta"


def write_records(records: DataFrame, folder: str, column: str = "record", order: str | None = None) -> None:
    """Write records as text files; with `order` as numbered files whose names' order is the records' (a batch's report)."""
    if order:
        from .record_sink import write_ordered

        return write_ordered(records, folder, order, column)
    records.filter(F.length(column) > 0).select(F.regexp_replace(column, "\n$", "")).write.text(folder)
