"""Benchmark decontamination by Wu-Manber search over words: block shift tables skip impossible positions, suffix
buckets select the windows to test, and direct comparison confirms occurrences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, release

#: Words are the runs outside these ASCII ranges: x00-x2F, x3A-x60 (after lowering A-Z), x7B-x7F.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
#: Words in a block; words of benchmark text in one set of tables.
BLOCK, WORDS_PER_SET = 3, 200_000



def fold_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class WuManber:
    """Tables for patterns of one length, in words."""

    def __init__(self, length: int):
        self.m, self.b = length, min(BLOCK, length)
        self.far = self.m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, set]] = {}

    def add(self, pattern: list[bytes], item: int) -> None:
        m, b = self.m, self.b
        for j in range(b, m + 1):
            block = tuple(pattern[j - b : j])
            if self.shift.get(block, self.far) > m - j:
                self.shift[block] = m - j
        # a bucket is keyed by whole patterns, so templates that share their ends cost no more than others
        self.bucket.setdefault(tuple(pattern[m - b :]), {}).setdefault(tuple(pattern), set()).add(item)

    def search(self, words: list[bytes], spans: list, items: set) -> None:
        m, b, far, shift, i, n = self.m, self.b, self.far, self.shift, self.m, len(words)
        while i <= n:
            block = tuple(words[i - b : i])
            skip = shift.get(block, far)
            if skip:
                i += skip
                continue
            found = self.bucket[block].get(tuple(words[i - m : i]))
            if found:
                spans.append((i - m, i))
                items |= found
            i += 1


def tables(texts: Iterable[list[bytes]], window: int) -> list[WuManber]:
    """One matcher for each length; an item shorter than the window is one pattern."""
    by_length: dict[int, WuManber] = {}
    for item, words in enumerate(texts):
        size = min(window, len(words))
        for start in range(len(words) - size + 1) if size else ():
            by_length.setdefault(size, WuManber(size)).add(words[start : start + size], item)
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _sets(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark in sets of bounded size; the driver holds one at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = fold_words(row["text"])
        if words:
            held.append(("" if row["item_id"] is None else str(row["item_id"]), words))
            size += len(words)
        if size >= WORDS_PER_SET:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(rows: DataFrame, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """The rows of _opened() with the hits of one set added."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in sent.value]
        matchers = tables((words for _, words in sent.value), window)
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text, known, had in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = fold_words(text.as_py())
                spans, found = [(s["start"], s["end"]) for s in known], set()
                for matcher in matchers:
                    matcher.search(words, spans, found)
                row = (len(words), [{"start": s, "end": e} for s, e in merged(spans)], sorted({*had, *(names[i] for i in found)}))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [batch.schema.field(i).type for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _opened(docs: DataFrame) -> DataFrame:
    lean(docs.sparkSession)
    span = "array<struct<start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Occurrences of benchmark windows in each document: n_words, spans (merged word ranges) and items (ids as sorted
    strings), one row a document.

    The benchmark is a stated query set: it is held in sets of at most WORDS_PER_SET words (plus one item), each of
    which reads the documents once; one set needs no shuffle at all. Null and empty texts have no words; a null item_id
    is reported as an empty string; items without words match nothing; an empty benchmark hits nothing. Rows with equal
    doc_id and text are reported alike, each once. Other columns are not read.
    """
    rows = _opened(docs)
    for items in list(_sets(benchmark)) or [[]]:
        rows = _search(rows, items, window)
    return rows.select("doc_id", "n_words", "spans", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs, with all their columns, of which benchmark windows cover less than a twentieth. Each row is judged
    by its own text, whatever its id; one pass over the documents for each set of the benchmark, and no shuffle."""
    release(docs.sparkSession)
    span = "array<struct<start:int,end:int>>"
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(span).alias("spans"))
    for items in _sets(benchmark):
        rows = rows.mapInArrow(_marker(docs.sparkSession.sparkContext.broadcast(items), window), rows.schema)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + (s["end"] - s["start"]))
    return rows.filter(~((hit > 0) & (20 * hit >= F.col("n_words")))).select("row.*")


def _marker(sent, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = tables((words for _, words in sent.value), window)
        for batch in batches:
            counts, spans = [], []
            for text, known in zip(batch.column(1), batch.column(3).to_pylist(), strict=True):
                words, found = fold_words(text.as_py()), [(s["start"], s["end"]) for s in known]
                for matcher in matchers:
                    matcher.search(words, found, set())
                counts.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in merged(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, batch.schema.field(3).type)], batch.schema.names)

    return run


def verdicts(found: DataFrame) -> DataFrame:
    """The digest of contamination(): n_hit words, n_items, their hash, and the rule 20 * n_hit >= n_words."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def op9_wu_manber(spark, sf_dir: str) -> DataFrame:
    return verdicts(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS g
      FROM i, unnest(range(len(w) - least(13, len(w)) + 1)) AS t(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM p),
o AS (SELECT doc_id, s, m, array_to_string(w[s + 1 : s + m], ' ') AS g
      FROM d, lengths, unnest(range(greatest(len(w) - m + 1, 0))) AS t(s)),
hit AS (SELECT o.doc_id, o.s, o.m, p.item_id FROM o JOIN p USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM hit, unnest(range(m)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, coalesce(items.h, sha256('')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
