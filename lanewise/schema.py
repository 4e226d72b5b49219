"""Schemas of the engine's tables, and the channel order that all of them keep."""

from __future__ import annotations

#: Channel number, letter and display colour.
CHANNELS = ((0, "G", "black"), (1, "A", "green"), (2, "T", "red"), (3, "C", "blue"))
LETTERS = "GATC"

TRACES = (
    "trace_id string, path string, format string, sample_name string, dye_order string, data_source string, n_samples int, "
    "time array<double>, signals array<array<double>>, kb_bases string, kb_quality array<double>, peak_locs array<int>, error string"
)
CALLS = (
    "trace_id string, ordinal int, pos int, time double, channel int, letter string, amplitude double, snr double, "
    "isolation double, shape_score double, spacing_score double, score double, phred int, noise double, "
    "tail_rescued boolean, imputed boolean, heterozygote boolean, het_channel int, het_ratio double"
)
HITS = (
    "rank int, accession string, description string, score double, evalue string, identity_pct int, query_cover_pct int, "
    "align_length int, gaps int"
)
