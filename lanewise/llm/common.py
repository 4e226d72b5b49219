"""What the operators share: staged tables, joins with a checked size, Arrow chunks, hashing of words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once (a single longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20


#: Bytes in an Arrow batch at most, so that an executor's buffers stay small beside its heap.
ARROW_BYTES = 8 << 20


def lean(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir. Only a local master may go
    without: it has one machine, and its tables go to a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.setdefault("root", "") or "file://" + tempfile.mkdtemp(prefix="lanewise-")
        _OWN["root"] = root
    return root.rstrip("/")


class Staged:
    """Tables staged inside `with Staged() as own:` are deleted at its end, but for those that own.keep() has given on to
    what stands around it. What is still to be computed from a table keeps it."""

    open: list["Staged"] = []

    def __enter__(self) -> "Staged":
        self.tables: list[DataFrame] = []
        Staged.open.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not table]
        if len(Staged.open) > 1:
            Staged.open[-2].tables.append(table)
        return table

    def __exit__(self, *failure: object) -> None:
        Staged.open.pop()
        unstage(*self.tables)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, nothing is computed twice, and a
    lost executor costs only its running tasks."""
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_root(spark)}/lanewise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if Staged.open:
        Staged.open[-1].tables.append(table)
    return table


def release(spark: SparkSession) -> None:
    """Between phases: the executors collect their garbage, so heap that JVM-heavy work has grown goes back before Python
    workers need memory, and so does the driver, so shuffle files that nothing refers to are deleted. The driver comes
    last: its scheduler refers to the last job's shuffles until another job has run."""
    slots = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).selectExpr("java_method('java.lang.System', 'gc') AS x").write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner", by: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Join with a right side that has one row a key. `weight` is a column of it, or of a table `counts`, with the number of
    the key's rows on the left; these are `total` in all.

    Keys with over a 1000th of all rows are dealt out: their rows on the left take a salt by the hash of the columns `by`
    (all, unless named), and their row on the right is sent once for each salt. Both sides are shuffled and no task gets
    all rows of a key; rows equal in all of `by` stay together. What is broadcast is the list of those keys, which are
    under 1000, with their numbers of salts; what they carry is not."""
    columns = [c for c in right.columns if c not in (key, weight)]
    floor = max(1, total // 1000)
    hot = (right if counts is None else counts).filter(F.col(weight) > floor).select(F.col(key).alias("_k"), F.ceil(F.col(weight) / floor).cast("int").alias("_salts"))
    salted = lambda side: side.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left").drop("_k").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    dealt = salted(left).withColumn("_salt", F.pmod(F.xxhash64(*(by or left.columns)), F.col("_salts")).cast("int")).drop("_salts")
    sent = salted(right).select(F.col(key).alias("_k"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_s"), F.struct(*columns).alias("_got"))
    out = dealt.join(sent, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), how)
    return out.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in columns])


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Join and cut record batches to tables of about `most` bytes in the column of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.diff(offsets(batch.column(batch.schema.get_field_index(column))))
        start, run = 0, 0
        for at in np.flatnonzero(np.cumsum(lengths) // most != np.concatenate([[0], np.cumsum(lengths)[:-1] // most])) if len(lengths) else []:
            held.append(batch.slice(start, at + 1 - start))
            yield pa.Table.from_batches(held)
            held, size, start = [], 0, int(at) + 1
        if start < batch.num_rows:
            rest = batch.slice(start)
            run = int(lengths[start:].sum())
            held.append(rest)
            size += run
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a string or binary array, as int64, from its own start (nulls have no bytes)."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
    return raw.astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n + 1 offsets into them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    at = offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    out = np.ones(n + 1, dtype=np.uint64)
    if n:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Rolling:
    """Hashes of all windows of a sequence of 64-bit symbols: differences of a polynomial's prefix sums."""

    def __init__(self, base: int):
        self.base, self.back = base, inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        if len(self.up) < n + 1:
            self.up, self.down = powers(self.base, n * 5 // 4 + 1), powers(self.back, n * 5 // 4 + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self.up[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


#: Bytes that separate words in the tables of documents: space, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_rolling_bytes = Rolling(BASES[2])


def word_table(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts raw[at[i]:at[i + 1]]: start and end byte of each word, its 64-bit hash, and n + 1 offsets of
    the texts' first words."""
    if not len(raw):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = at[:-1][(at[:-1] < len(raw))]
    opens[first] = inside[first]
    start = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    closes[last] = inside[last]
    end = np.flatnonzero(closes) + 1
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    prefix = _rolling_bytes.prefix(_BYTES[raw])
    hashes = _rolling_bytes.windows(prefix, start, end)
    return start, end, hashes, np.searchsorted(start, at)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n places that lie in any [start, end)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def text_key(text: str = "text") -> Column:
    """Tells apart rows with equal ids."""
    return F.xxhash64(F.col(text))


#: Stands for a null id: after all others.
LAST_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """_doc (doc_id, nulls last), _text (text key; tells apart rows of equal id), and text."""
    lean(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_doc"), F.xxhash64("text").alias("_text"), "text")


def copies(docs: DataFrame) -> DataFrame:
    """_doc, _text and _first of each row whose text equals that of a row with a smaller id; _first is the smallest."""
    known = stage(docs.select("_doc", "_text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")), "copies-known")
    groups = known.groupBy("_sha").agg(F.count("*").alias("_n"), F.min("_doc").alias("_first")).filter("_n > 1")
    found = hot_join(known, stage(groups, "copies-groups"), "_sha", "_n", known.count())
    return found.filter("_doc > _first").select("_doc", "_text", "_first").distinct()


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows that start a run of equal values."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out
