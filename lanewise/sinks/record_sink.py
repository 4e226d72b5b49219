"""Ordered records as numbered files, written in parallel: df.write.format("records"), or write_ordered().

Each task writes a file of its own under a temporary name. When all have ended the driver gives them the numbers of their
partitions, empty ones left out; if one fails for good, all are deleted, and so are those of attempts that were given up.
Paths are those that Arrow's file systems know."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.trace_source import _system


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if not options.get("path"):
            raise ValueError("records are written to a path: save(path)")
        self.path, self.ending, self.head = options["path"], options.get("ending", "txt"), options.get("header", "")
        self.job, self.overwrite = f"_job-{uuid.uuid4().hex}", overwrite
        system, base = _system(self.path)
        if not overwrite and [f for f in self._files(system, base) if f.base_name.startswith("part-")]:
            raise ValueError(f"{self.path} holds records already")

    @staticmethod
    def _files(system, base: str) -> list:
        from pyarrow import fs

        return system.get_file_info(fs.FileSelector(base, allow_not_found=True))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One string column; each value is a record with its line ends. A header line, if asked for, opens every part that
        has records."""
        task = TaskContext.get()
        system, base = _system(self.path)
        name, records = f"{base}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}", 0
        system.create_dir(f"{base}/{self.job}", recursive=True)
        with system.open_output_stream(name) as out:
            for one in iterator:
                texts = [x for x in one.column(0).to_pylist() if x]
                if texts and not records and self.head:
                    out.write((self.head + "\n").encode())
                records += len(texts)
                out.write("".join(t if t.endswith("\n") else t + "\n" for t in texts).encode())
        return Part(task.partitionId(), name, records)

    def commit(self, messages: list[Part | None]) -> None:
        system, base = _system(self.path)
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for old in self._files(system, base):
                if old.base_name.startswith(("part-", "_SUCCESS")):
                    system.delete_file(old.path)
        parts = sorted((m for m in messages if m and m.records), key=lambda m: m.partition)
        for number, part in enumerate(parts):
            system.move(part.name, f"{base}/part-{number:05d}.{self.ending}")
        self.abort(messages)
        with system.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        system, base = _system(self.path)
        if any(f.base_name == self.job for f in self._files(system, base)):
            system.delete_dir(f"{base}/{self.job}")


class RecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "record string"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("records are one string column")
        return RecordWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSink)


def write_ordered(records: DataFrame, folder: str, order: str | list[str], column: str = "record", ending: str = "fasta", header: str = "", overwrite: bool = False) -> None:
    """Write records as numbered files, in one order through all of them: ranges of the order are partitions, so the names'
    order is the records'. No task sees more than its range; rows of equal order stay together."""
    register(records.sparkSession)
    keys = [order] if isinstance(order, str) else order
    dealt = records.filter(F.length(column) > 0).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.select(F.col(column).alias("record")).write.format("records").option("ending", ending).option("header", header).mode("overwrite" if overwrite else "append").save(folder)
