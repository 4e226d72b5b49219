"""Packing by non-negative least squares: shallow combinations of lengths that fill a window exactly, repeat counts
fitted to the histogram of lengths, rounded down, and the rest packed greedily."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage
from .tokens import Vocabulary, vocabulary_path

#: Combinations of three lengths that enter the fit, by their gradient.
TRIPLES, SWEEPS = 4000, 60
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, window: int = 1024, path: str | None = None) -> DataFrame:
    """Each document's ids, ended by id 0, cut at multiples of the window."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        for batch in batches:
            columns: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.array((vocabulary.ids(text) if text else []) + [0], dtype="<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    for column, value in zip(columns, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def combinations(lengths: list[int], window: int, gradient: np.ndarray) -> list[tuple[int, ...]]:
    """Pairs that fill the window, and the triples of largest gradient."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [(a, window - a) for a in lengths if a >= window - a > 0 and there[window - a]]
    size = np.array(lengths)
    a, b = np.meshgrid(size, size, indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c > 0) & there[np.clip(c, 0, window)]
    a, b, c = a[ok], b[ok], c[ok]
    best = np.argsort(-(gradient[a] + gradient[b] + gradient[c]), kind="stable")[:TRIPLES]
    return out + [(int(x), int(y), int(z)) for x, y, z in zip(a[best], b[best], c[best])]


def fit(histogram: np.ndarray, columns: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram| squared, by coordinate descent."""
    x = np.zeros(len(columns))
    rest = histogram.astype(float)
    sparse = [(np.array(list(c)), np.array(list(c.values()), float)) for c in map(Counter, columns)]
    norm = [float(w @ w) for _, w in sparse]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (at, weight) in enumerate(sparse):
            step = max(-x[j], float(weight @ rest[at]) / norm[j])
            if step:
                x[j] += step
                rest[at] -= step * weight
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how often), ...] and how many sequences each one fills; every piece is used once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(pattern: list[tuple[int, int]], times: int) -> None:
        out.append((pattern, times))
        for length, n in pattern:
            left[length] -= n * times

    if left[window]:
        use([(window, 1)], int(left[window]))
    lengths = [int(k) for k in np.flatnonzero(left)]
    columns = combinations(lengths, window, left.astype(float)) if lengths else []
    for j in np.argsort(-(x := fit(left, columns)), kind="stable") if columns else ():
        pattern = sorted(Counter(columns[j]).items(), reverse=True)
        times = min(int(x[j]), *(int(left[length]) // n for length, n in pattern))
        if times > 0:
            use(pattern, times)
    while left.any():
        pattern, room, most = [], window, window
        while (fits := np.flatnonzero(left[: min(room, most) + 1])).size:
            length = int(fits[-1])
            n = min(room // length, int(left[length]))
            pattern.append((length, n))
            room, most = room - n * length, length - 1
        use(pattern, min(int(left[length]) // n for length, n in pattern))
    return out


def pack(docs: DataFrame, window: int = 1024, path: str | None = None, rows_per_bucket: int = 200_000) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each.

    Only the histogram of lengths (window numbers at most) comes to the driver; the plan over it gives each length its
    slots, and a piece finds its slot by its rank among the pieces of its length. Ranks follow a hash of the piece's row,
    whatever the order of rows, and are counted in buckets of it; a row that is repeated more than `rows_per_bucket` times
    has buckets of its own. So neither a length that many documents share nor such a row is one task's work. Null and empty texts have the end id alone; repeated rows are documents of their
    own; an empty table gives no rows; other columns are not read. Texts with very long white space are encoded by the
    slower library.
    """
    spark = docs.sparkSession
    release(spark)
    cut = stage(pieces(docs, window, path).withColumns({"_at": F.monotonically_increasing_id(), "_row": F.xxhash64("length", "doc_id", "start", "ids_crc32", "doc_tokens")}), "pieces")
    histogram = dict(cut.groupBy("length").count().collect())
    slots, rank, sequence = [], Counter(), 0
    for pattern, times in plan(histogram, window):
        offset = 0
        for length, n in pattern:
            slots.append((length, rank[length], rank[length] + n * times, sequence, offset, n))
            rank[length] += n * times
            offset += n * length
        sequence += times
    buckets = max(16, -(-sum(histogram.values()) // rows_per_bucket))
    # one in rows_per_bucket rows at most
    often = cut.groupBy("_row").count().filter(F.col("count") > rows_per_bucket).select("_row", F.ceil(F.col("count") / rows_per_bucket).alias("_salts"))
    hot = F.col("_salts").isNotNull()
    place = F.when(hot, F.col("_row")).otherwise(F.pmod("_row", F.lit(buckets)))
    salt = F.when(hot, F.pmod(F.xxhash64("_at"), F.col("_salts"))).otherwise(0)
    keyed = cut.join(F.broadcast(often), "_row", "left").withColumn("_bucket", F.struct(hot.alias("hot"), place.alias("place"), salt.alias("salt"))).drop("_salts")
    before = keyed.groupBy("length", "_bucket").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row", "_at")) - 1
    ranked = keyed.withColumn("_in", inside).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    # bounded: a row for each length of each pattern, and the plan's patterns depend on the window alone
    found = spark.createDataFrame(slots or [(0, 0, 0, 0, 0, 1)], "length bigint, lo bigint, hi bigint, first bigint, at bigint, n bigint")
    return ranked.join(F.broadcast(found), [ranked["length"] == found["length"], F.col("_rank") >= F.col("lo"), F.col("_rank") < F.col("hi")]).select(
        "doc_id",
        "start",
        ranked["length"],
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor((F.col("_rank") - F.col("lo")) / F.col("n"))).alias("sequence_id"),
        (F.col("at") + ((F.col("_rank") - F.col("lo")) % F.col("n")) * ranked["length"]).alias("offset"),
    )


def op5_nnls_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
