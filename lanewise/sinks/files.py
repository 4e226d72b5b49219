"""Rows of (path, content) as files, each under its own name, and a folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.trace_source import _system


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; only a local master may go without that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lanewise-")
    return f"{root.rstrip('/')}/lanewise/{name}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's content under the last part of its path, and return how many there are. A task that runs again
    writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        for one in batches:
            for path, content in zip(one.column(0).to_pylist(), one.column(1), strict=True):
                with system.open_output_stream(f"{base}/{path.rsplit('/', 1)[-1]}") as out:
                    out.write(content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([one.num_rows])], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
