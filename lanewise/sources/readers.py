"""Readers of trace files: ABIF, SRD (XML) and signal CSV. Files come through Spark's binaryFile source, so any store that
Spark reads will do; a file that can't be parsed gives a row with an error text."""

from __future__ import annotations

import io
import os
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..schema import LETTERS, TRACES

Parsed = dict[str, object]


def _trace(signals: np.ndarray, time: np.ndarray | None = None, **more: object) -> Parsed:
    n = signals.shape[1]
    return {"n_samples": n, "time": (np.arange(n, dtype=float) if time is None else time).tolist(), "signals": signals.tolist(), **more}


class Abif:
    """Directory of an ABIF file. The published layout has entries of 28 bytes and its root entry at byte 6; the 'compact'
    one has 22-byte entries with a 4-byte element size, and the count and place of the directory at byte 40."""

    def __init__(self, data: bytes, layout: str = "published"):
        if data[:4] != b"ABIF":
            raise ValueError("the file doesn't start with ABIF")
        self.data, self.entries = data, {}
        compact = layout == "compact"
        count, place = struct.unpack_from(">ii", data, 40) if compact else (struct.unpack_from(">i", data, 18)[0], struct.unpack_from(">i", data, 26)[0])
        width = 22 if compact else 28
        for at in range(place, place + count * width, width):
            if compact:
                name, number, _, size, items = struct.unpack_from(">4sihii", data, at)
                length, value = size * items, at + 18
            else:
                name, number, _, _, items, length = struct.unpack_from(">4sihhii", data, at)
                value = at + 20
            start = struct.unpack_from(">i", data, value)[0] if length > 4 else value
            self.entries.setdefault((name.decode("ascii", "replace"), number), data[start : start + length])

    def first(self, name: str, *numbers: int) -> bytes:
        """The first of the entries that has a value."""
        return next((v for k in numbers if (v := self.entries.get((name, k)))), b"")

    def channels(self, first: int) -> list[np.ndarray | None]:
        found = [self.entries.get(("DATA", first + k)) for k in range(4)]
        return [np.frombuffer(x[: len(x) // 2 * 2], ">i2").astype(float) if x and len(x) >= 4 else None for x in found]


def _strength(channels: list[np.ndarray | None]) -> float:
    return sum(float(c.var()) * float(np.ptp(c)) for c in channels if c is not None and len(c) > 10)


def parse_abif(data: bytes, prefer_raw: bool = True, layout: str = "published") -> Parsed:
    """Raw channels are DATA 1-4, analysed ones 9-12; the preferred set is taken unless its strength is under 5 % of the
    other's. Channels come in the order G, A, T, C by the file's dye order; a missing one is zero."""
    file = Abif(data, layout)
    raw, analysed = file.channels(1), file.channels(9)
    wanted, other, names = (raw, analysed, ("1-4 (raw)", "9-12 (analysed, fallback)")) if prefer_raw else (analysed, raw, ("9-12 (analysed)", "1-4 (raw, fallback)"))
    good = _strength(wanted) >= 0.05 * _strength(other)
    chosen = wanted if good else other
    lengths = [len(c) for c in chosen if c is not None]
    if not lengths:
        raise ValueError("the file has no signal channels")
    n = min(lengths)
    text = lambda b: b.decode("ascii", "replace").strip("\0")
    dyes = text(file.first("FWO_", 1)) or LETTERS
    signals = np.zeros((4, n))
    for row, letter in enumerate(LETTERS):
        at = dyes[:4].find(letter)
        if at >= 0 and chosen[at] is not None:
            signals[row] = chosen[at][:n]
    name, places = file.first("SMPL", 1), file.first("PLOC", 2, 1)
    return _trace(
        signals, sample_name=name[1 : 1 + name[0]].decode("ascii", "replace") if name else "", dye_order=dyes, data_source=names[0] if good else names[1],
        kb_bases=text(file.first("PBAS", 2, 1)), kb_quality=[float(b) for b in file.first("PCON", 2, 1)], peak_locs=np.frombuffer(places[: len(places) // 2 * 2], ">u2").astype(int).tolist(),
    )


def parse_srd(data: bytes, legacy_time_step: bool = False) -> Parsed:
    """Points with four numbers or more, the first four in the order of the channels. The time step is the file's, in
    thousandths (0.01 without one, or always with legacy_time_step)."""
    root = ET.fromstring(data)
    step = root.find("TimeStep")
    width = 0.01 if legacy_time_step or step is None else float(step.text) / 1000.0
    points = [[int(x.text) for x in block.findall("int")[:4]] for block in (p.find("Data") for p in root.iter("Point")) if block is not None and len(block.findall("int")) >= 4]
    if not points:
        raise ValueError("the file has no points of four numbers")
    signals = np.array(points, float).T
    return _trace(signals, np.arange(signals.shape[1]) * width)


def parse_signal_csv(data: bytes) -> Parsed:
    """Numbers separated by semicolons, without a header: every column is a channel. Else a comma-separated table with a
    header, of which the numeric columns count: time and four channels, or four channels."""
    text = data.decode("utf-8-sig")
    lines = [x for x in text.splitlines() if x.strip()]
    if lines and ";" in lines[0] and "," not in lines[0]:
        rows = [[x for x in line.split(";") if x] for line in lines]
        if len({len(r) for r in rows}) != 1:
            raise ValueError("the rows have different numbers of columns")
        return _trace(np.array(rows, float).T)
    table = pd.read_csv(io.StringIO(text)).select_dtypes(include=[np.number]).to_numpy(float).T
    if len(table) >= 5:
        return _trace(table[1:5], table[0])
    if len(table) == 4:
        return _trace(table)
    raise ValueError("four signal columns (G, A, T, C) are needed")


PARSERS: dict[str, Callable[..., Parsed]] = {"abif": parse_abif, "srd": parse_srd, "csv": parse_signal_csv}
ENDINGS = {".ab1": "abif", ".abi": "abif", ".srd": "srd", ".xml": "srd", ".csv": "csv", ".txt": "csv"}


def parsed_row(path: str, content: Callable[[], bytes] | None, format: str | None, options: dict[str, dict[str, object]]) -> Parsed:
    """The row of one file; a file that can't be read or parsed is reported in it. Without content only what its path tells.
    options are given by format."""
    kind = format or ENDINGS.get(os.path.splitext(path)[1].lower(), "")
    row: Parsed = {"trace_id": os.path.splitext(os.path.basename(path))[0], "path": path, "format": kind}
    if content is None:
        return row
    try:
        return row | PARSERS[kind](content(), **options.get(kind, {})) | {"error": None}
    except Exception as why:
        return row | {"error": f"{type(why).__name__}: {why}"}


def parse(files: DataFrame, format: str | None = None, **options: object) -> DataFrame:
    """Traces from rows (path, content). The format is given, or goes by each file's ending."""
    schema = to_arrow_schema(_parse_datatype_string(TRACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            rows = [parsed_row(path, lambda content=content: content.as_py() or b"", format, dict.fromkeys(PARSERS, options)) for path, content in zip(one.column(0).to_pylist(), one.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)

    return files.select("path", "content").mapInArrow(run, TRACES)


def read_traces(spark: SparkSession, paths: str | list[str], format: str | None = None, **options: object) -> DataFrame:
    """Traces from files or folders."""
    return parse(spark.read.format("binaryFile").load(paths), format, **options)


def batch_files(traces: DataFrame) -> DataFrame:
    """What a batch takes: ABIF and CSV files; others are marked as errors."""
    from pyspark.sql import functions as F

    return traces.withColumn("error", F.coalesce("error", F.when(~F.col("format").isin("abif", "csv"), F.lit("a batch takes ABIF and CSV files"))))
