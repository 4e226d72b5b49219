"""Trace files as a data source: spark.read.format("traces").load(folder), readStream alike.

Files are listed on the driver and dealt to tasks in groups of about `groupBytes`, so thousands of small files make a few
tasks and a large one its own. A schema given to the reader (`.schema("trace_id string, n_samples int")`) is all that rows
carry; one of names and paths alone opens no file. Paths are those that Arrow's file systems know (local, hdfs, s3, gs);
read_traces() takes any that Spark reads."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import TRACES
from .readers import ENDINGS, parsed_row

#: Bytes of files that a task reads, about; rows in a batch.
GROUP_BYTES, ROWS = 32 << 20, 64


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def listed(path: str, format: str | None = None) -> list[tuple[int, str, int]]:
    """Time of change (ns), path and bytes of the trace files in a folder, under it, or matching a pattern in its last part;
    in the order of paths. Hidden files are left out, and without a format those of unknown endings."""
    system, base = _system(path)
    pattern = None
    if "*" in base or "?" in base:
        base, pattern = os.path.split(base)
    one = system.get_file_info(base)
    found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=pattern is None))
    known = lambda f: format or os.path.splitext(f.base_name)[1].lower() in ENDINGS
    kept = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and known(f) and (not pattern or fnmatch.fnmatch(f.base_name, pattern))]
    return [(f.mtime_ns, f.path, f.size) for f in sorted(kept, key=lambda f: f.path)]


def grouped(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Neighbouring files of about `most` bytes together."""
    out: list[list[str]] = []
    size = most
    for _, path, n in files:
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n
    return [Files(paths) for paths in out]


class _Reading:
    """What batches and streams share."""

    def __init__(self, options: dict[str, str], schema: StructType):
        if not options.get("path"):
            raise ValueError("traces are read from a path: load(path)")
        self.path, self.format, self.fields = options["path"], options.get("format"), schema
        self.bytes = int(options.get("groupbytes", GROUP_BYTES))
        flag = lambda name, default: options.get(name, default).lower() == "true"
        self.parsing = {"abif": {"prefer_raw": flag("preferraw", "true"), "layout": options.get("layout", "published")}, "srd": {"legacy_time_step": flag("legacytimestep", "false")}}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.fields)
        closed = set(schema.names) <= {"trace_id", "path", "format"}
        system = _system(self.path)[0]
        for start in range(0, len(partition.paths), ROWS):
            rows = []
            for path in partition.paths[start : start + ROWS]:
                def content(path: str = path) -> bytes:
                    with system.open_input_file(path) as file:
                        return file.read()

                row = parsed_row(path, None if closed else content, self.format, self.parsing)
                rows.append({name: row.get(name) for name in schema.names})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class TraceReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return grouped(listed(self.path, self.format), self.bytes)


class TraceStream(_Reading, DataSourceStreamReader):
    """Files by their time of change, then path: what is moved in must be as new as what is there. An offset is the last
    file's time and path, so a restarted query reads each file once."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((time, path) for time, path, _ in listed(self.path, self.format)), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return grouped([f for f in listed(self.path, self.format) if low < f[:2] <= high], self.bytes)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return TRACES

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> TraceStream:
        return TraceStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)
