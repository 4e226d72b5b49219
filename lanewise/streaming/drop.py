"""Trace files dropped into a folder, processed as they come. Traces don't depend on one another, so no state is kept
between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..params import PipelineParams
from ..plans.pipeline import run
from ..sources.readers import parse

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def incoming(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a stream of (path, content)."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)


def process_stream(files: DataFrame, target: str, checkpoint: str, params: PipelineParams = PipelineParams(), once: bool = False) -> StreamingQuery:
    """Parse, call and write results as Parquet, exactly once a file."""
    out = run(parse(files), params).drop("stages")
    writer = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
