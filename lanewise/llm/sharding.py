"""Sharding by sampled splitters: size-weighted samples of the key, quantile boundaries, range partitions, overfull
ranges subdivided. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Sample points for each range; ranges at most (the splitters live in the plan, so their number is bounded).
POINTS, MOST_RANGES = 16, 4096


def _array(values: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _range_of(splitters: list[tuple[int, ...]], columns: list[str]) -> Column:
    """Number of splitters at or before the row, by binary search over constant arrays."""
    if not splitters:
        return F.lit(0)
    parts = [_array([s[i] for s in splitters]) for i in range(len(columns))]
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]

    def step(low: Column, width: Column) -> Column:
        at = low + width
        after = F.lit(True)
        for part, name in reversed(list(zip(parts, columns, strict=True))):
            edge = F.get(part, at - 1)
            after = (F.col(name) > edge) | ((F.col(name) == edge) & after)
        return F.when((at <= len(splitters)) & after, at).otherwise(low)

    return F.aggregate(_array(steps).cast("array<int>"), F.lit(0), step)


def _sample(rows: DataFrame, total: int, points: int, columns: list[str]) -> list[tuple[int, ...]]:
    """About `points` key tuples, each row drawn in proportion to its size (large rows several times)."""
    u = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.floor(F.col("size") * (points / max(total, 1)) + u).cast("int")
    got = rows.select(*columns, drawn.alias("n")).filter("n > 0").collect()
    return sorted(tuple(r[c] for c in columns) for r in got for _ in range(min(r["n"], points)))


def _quantiles(sample: list[tuple[int, ...]], parts: int) -> list[tuple[int, ...]]:
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def shard_by_splitters(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, rows_per_range: int = 250_000) -> DataFrame:
    """Deal rows to `shards` contiguous key ranges of nearly equal bytes.

    A row's size is its text's UTF-8 bytes plus 8. Rows are ordered by (key, CRC-32 of the text, arrival); a row goes to
    the shard in whose equal part of all bytes its middle byte lies, so no shard is off by more than the two rows at its
    edges. The sampled ranges set only who sorts what: the outcome doesn't depend on the sample. The arrival number, kept
    in a written table, splits a key that holds any share of the rows. Ranges are MOST_RANGES at most, so beyond a billion
    rows (MOST_RANGES * rows_per_range) a range grows with the table; the sort of a range spills.

    Nulls: a null text counts as empty; null keys come first. Repeated rows are rows of their own. An empty table gives
    no rows. Other columns are not read.

    Returns key, size, text_crc32, shard, slot (position in the shard, gapless from 0).
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stage(
        docs.select(
            F.col(key).cast("bigint").alias("_id"),
            F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("_key"),
            (F.octet_length(body) + 8).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "shard-rows",
    )
    order = ["_key", "text_crc32", "_at"]
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(MOST_RANGES, max(4 * shards, -(-n // rows_per_range))))
    splitters = _quantiles(_sample(rows, total, POINTS * ranges, order), ranges)
    for _ in range(3):
        counted = rows.groupBy(_range_of(splitters, order).alias("_range")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        sizes = {r["_range"]: (r["b"], r["n"]) for r in counted}
        over = [r for r, (b, k) in sizes.items() if b > 2.5 * total / ranges and k > 1]
        if not over or len(splitters) >= MOST_RANGES:
            break
        inside = rows.withColumn("_range", _range_of(splitters, order)).filter(F.col("_range").isin(over))
        heavy = sum(sizes[r][0] for r in over)
        more = _sample(inside, heavy, 4 * POINTS * len(over), order)
        splitters = sorted({*splitters, *_quantiles(more, 4 * len(over))})
    else:
        counted = rows.groupBy(_range_of(splitters, order).alias("_range")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        sizes = {r["_range"]: (r["b"], r["n"]) for r in counted}
    bytes_before, rows_before = [0], [0]
    for r in range(len(splitters) + 1):
        b, k = sizes.get(r, (0, 0))
        bytes_before.append(bytes_before[-1] + b)
        rows_before.append(rows_before[-1] + k)
    window = Window.partitionBy("_range").orderBy(*order)
    placed = (
        rows.withColumn("_range", _range_of(splitters, order))
        .withColumn("_row", F.row_number().over(window) - 1 + F.get(_array(rows_before), F.col("_range")))
        .withColumn("_end", F.sum("size").over(window.rowsBetween(Window.unboundedPreceding, 0)) + F.get(_array(bytes_before), F.col("_range")))
        .withColumn("shard", F.expr(f"cast(((2 * _end - size) * {shards}) div {max(2 * total, 1)} as int)"))
        .select("_id", "size", "text_crc32", "shard", "_row")
    )
    placed = stage(placed, "shard-placed")
    held = dict(placed.groupBy("shard").count().collect())
    first = [sum(held.get(s, 0) for s in range(k)) for k in range(shards)]
    return placed.select(F.col("_id").alias(key), "size", "text_crc32", "shard", (F.col("_row") - F.get(_array(first), F.col("shard"))).alias("slot"))


def op10_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    out = shard_by_splitters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The CRC-32's table follows from its polynomial; a text's bytes come from its hexadecimal form.
OP10_SQL = """
WITH crc AS (SELECT list(list_reduce(list_prepend(CAST(k AS BIGINT), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
                 lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS r(k)),
d AS (SELECT doc_id, coalesce(text, '') AS x, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents),
b AS (SELECT x, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes FROM (SELECT DISTINCT x FROM d)),
c AS (SELECT x, xor(list_reduce(bytes, lambda c, h: xor(c >> 8, t[xor(c & 255, h) + 1])), 4294967295) AS crc FROM b, crc),
o AS (SELECT doc_id, size, crc AS text_crc32, sum(size) OVER () AS total, row_number() OVER w AS n, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS e
      FROM d JOIN c ON d.x = c.x WINDOW w AS (ORDER BY doc_id, crc)),
s AS (SELECT *, CAST(((2 * e - size) * 24) // (2 * total) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
