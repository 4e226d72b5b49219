"""Functions on tables for SQL: the rows of a read come as TABLE(...) PARTITION BY trace_id ORDER BY (ordinal). They hold one
row at a time, whatever a read's length. In DataFrame code operators.calls does the same without Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StructField, StructType


def _fields(table: AnalyzeArgument, *names: str) -> list[DataType]:
    """Types of a table's columns; a missing one is told by name."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...) PARTITION BY trace_id ORDER BY ...")
    types = {f.name: f.dataType for f in table.dataType}
    if missing := [n for n in names if n not in types]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return [types[n] for n in names]


def _result(*fields: tuple[str, DataType]) -> AnalyzeResult:
    return AnalyzeResult(StructType([StructField(n, t) for n, t in fields]))


class TrimReads:
    """trim_reads(TABLE(calls) PARTITION BY trace_id ORDER BY (ordinal), min_q, size): start and end of the segment of largest
    summed (phred - min_q); reads under `size` calls are kept whole or not at all by their mean."""

    @staticmethod
    def analyze(calls: AnalyzeArgument, min_q: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        return _result(("trace_id", _fields(calls, "trace_id", "ordinal", "phred")[0]), ("start", LongType()), ("end", LongType()))

    def __init__(self):
        self.trace = None
        self.n = self.total = self.now = self.best = 0
        self.since = self.start = self.end = 0

    def eval(self, calls: Row, min_q: float, size: int) -> None:
        self.trace, self.limit, self.size = calls["trace_id"], min_q, size
        self.n, self.total = self.n + 1, self.total + calls["phred"]
        if self.now <= 0:
            self.now, self.since = 0, calls["ordinal"]
        self.now += calls["phred"] - min_q
        if self.now > self.best:
            self.best, self.start, self.end = self.now, self.since, calls["ordinal"] + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            short = self.n < self.size
            whole = self.n if short and self.total / self.n >= self.limit else 0
            yield self.trace, 0 if short else self.start, whole if short else self.end


class MergeClusters:
    """merge_clusters(TABLE(candidates) PARTITION BY trace_id ORDER BY (pos, ch), tolerance): the strongest candidate of each
    cluster; a cluster takes all places within `tolerance` of its first one, of equal amplitudes the first."""

    @staticmethod
    def analyze(candidates: AnalyzeArgument, tolerance: AnalyzeArgument) -> AnalyzeResult:
        trace, pos, ch, _ = _fields(candidates, "trace_id", "pos", "ch", "amp")
        return _result(("trace_id", trace), ("cluster", IntegerType()), ("pos", pos), ("ch", ch), ("amp", DoubleType()))

    def __init__(self):
        self.cluster, self.first, self.best = -1, None, None

    def eval(self, candidates: Row, tolerance: int) -> Iterator[tuple]:
        one = candidates["trace_id"], candidates["pos"], candidates["ch"], candidates["amp"]
        if self.first is None or one[1] - self.first > tolerance:
            if self.best:
                yield self._row()
            self.cluster, self.first, self.best = self.cluster + 1, one[1], one
        elif one[3] > self.best[3]:
            self.best = one

    def _row(self) -> tuple:
        return self.best[0], self.cluster, self.best[1], self.best[2], float(self.best[3])

    def terminate(self) -> Iterator[tuple]:
        if self.best:
            yield self._row()


def register(spark: SparkSession) -> None:
    """Make the functions callable from spark.sql()."""
    spark.udtf.register("trim_reads", udtf(TrimReads))
    spark.udtf.register("merge_clusters", udtf(MergeClusters))
