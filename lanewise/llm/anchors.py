"""Substring dedup of words by difference-cover anchors: windows are hashed only at cover positions modulo a period; any
long match shares an aligned anchor, and only around shared anchors are the long windows themselves compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, LAST_ID, Rolling, batch, chunks, copies, covered, heads, keyed, stage, text_bytes, word_table

#: A perfect difference set: every residue modulo PERIOD is a difference of two of COVER. Two equal runs of
#: ANCHOR + PERIOD - 1 words, wherever they start, have a place of COVER in common.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

FOUND = "k bigint, doc bigint, a int, b int, kind tinyint"
WINDOWS = "h1 bigint, h2 bigint, doc bigint, key bigint, a int, b int, kind tinyint, places binary"
SPANS = "doc bigint, key bigint, a int, b int"
#: Kinds of rows: an anchor whose place may be shared, one known to be shared, and places already decided.
ASK, TELL, DONE = 0, 1, 2


class Words:
    """Words of a chunk of documents: `hash` of each, its text's number `text` and its place in it."""

    def __init__(self, texts: pa.ChunkedArray):
        raw, at = text_bytes(texts)
        _, _, self.hash, self.first = word_table(raw, at)
        self.size = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.hash)) - self.first[self.text] if len(self.hash) else np.zeros(0, np.int64)
        self.room = self.size[self.text] - self.place if len(self.hash) else np.zeros(0, np.int64)


def spans_of(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring places: text, start, end. The input is sorted."""
    if not len(text):
        return text, place, place
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(first)
    return text[at], place[at], place[np.append(at[1:], len(text)) - 1] + 1


def _anchor_rows(window: int):
    anchor = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for table in chunks(batches, "text"):
            table = table.take(np.sort(np.unique(table["_text"].to_numpy(), return_index=True)[1]))
            words, doc = Words(table["text"]), table["_text"].to_numpy()
            prefix = rolling.prefix(words.hash)
            at = np.flatnonzero(cover[words.place % PERIOD] & (words.room >= anchor) & (words.size[words.text] >= window))
            h = rolling.windows(prefix, at, at + anchor).view(np.int64)
            order = np.lexsort((at, h))
            at, h = at[order], h[order]
            d = doc[words.text[at]]
            head = heads(h)
            group = np.cumsum(head) - 1
            first = np.flatnonzero(head)
            # more than one text of this chunk: decided here, and one row tells the others
            several = np.zeros(len(first), bool)
            np.logical_or.at(several, group, d != d[first][group]) if len(first) else None
            here = several[group]
            text, a, b = spans_of(*_reach(words, at[here], window))
            tell = first[several]
            none = np.zeros(len(tell), np.int32)
            yield batch(
                [c.split()[0] for c in FOUND.split(", ")],
                np.concatenate([h[~here], h[tell], _spread(doc[text], a)]),
                np.concatenate([d[~here], np.full(len(tell), LAST_ID), doc[text]]),
                np.concatenate([words.place[at[~here]], none, a]).astype(np.int32),
                np.concatenate([words.place[at[~here]] + 1, none, b]).astype(np.int32),
                np.repeat(np.array([ASK, TELL, DONE], np.int8), [int((~here).sum()), len(tell), len(text)]),
            )

    return run


def _spread(doc: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A key for rows that need no meeting."""
    return (doc.astype(np.int64) * np.int64(0x5851F42D4C957F2D) + a.astype(np.int64) * np.int64(0x14057B7EF767814F)).astype(np.int64)


def _reach(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts and places of the windows that hold one of these anchors, in order."""
    anchor = window - PERIOD + 1
    flags = covered(np.maximum(at - (window - anchor), words.first[words.text[at]]), at + 1, len(words.hash)) if len(at) else np.zeros(len(words.hash), bool)
    got = np.flatnonzero(flags & (words.room >= window))
    return words.text[got], words.place[got]


def _shared(window: int):
    back = window - (window - PERIOD + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def decide(table: pa.Table) -> pa.RecordBatch:
            k, doc, a, b, kind = (table[c].to_numpy() for c in ("k", "doc", "a", "b", "kind"))
            done = kind == DONE
            ask = np.flatnonzero(~done)
            head = heads(k[ask])
            group, first = np.cumsum(head) - 1, np.flatnonzero(head)
            many = np.zeros(len(first), bool)
            if len(first):
                np.logical_or.at(many, group, (kind[ask] == TELL) | (doc[ask] != doc[ask][first][group]))
            yes = ask[many[group] & (kind[ask] == ASK)] if len(first) else ask
            return batch(["doc", "a", "b"], np.concatenate([doc[done], doc[yes]]), np.concatenate([a[done], np.maximum(a[yes] - back, 0)]).astype(np.int32), np.concatenate([b[done], b[yes]]).astype(np.int32))

        for one in batches:
            table = pa.Table.from_batches([one])
            if held is not None:
                table = pa.concat_tables([held, table])
            k = table["k"].to_numpy()
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            held = table.slice(cut)
            if cut:
                yield decide(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield decide(held)

    return run


def _flags(words: Words, spans: pa.ChunkedArray, reach: int) -> np.ndarray:
    """Places covered by lists of structs (a, b), each b moved on by `reach`, cut at the texts' ends."""
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    counts = np.array([0 if n is None else n for n in spans.value_lengths().to_pylist()], np.int64)
    flat = spans.flatten()
    text = np.repeat(np.arange(len(counts)), counts)
    a, b = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    size = words.size[text]
    return covered(words.first[text] + np.minimum(a, size), words.first[text] + np.minimum(b + reach, size), len(words.hash))


def _window_rows(window: int):
    names = [c.split()[0] for c in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(BASES[0]), Rolling(BASES[1])
        for table in chunks(batches, "text"):
            words, doc, key = Words(table["text"]), table["_doc"].to_numpy(), table["_text"].to_numpy()
            at = np.flatnonzero(_flags(words, table["spans"], 0) & (words.room >= window))
            h1 = one.windows(one.prefix(words.hash), at, at + window).view(np.int64)
            h2 = two.windows(two.prefix(words.hash), at, at + window).view(np.int64)
            d = doc[words.text[at]]
            order = np.lexsort((d, h2, h1))
            head = heads(h1[order], h2[order])
            least = d[order][np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else d
            gone = np.zeros(len(at), bool)
            gone[order] = d[order] > least
            # decided here: a smaller document of this chunk has the window, and asks for it elsewhere too
            text, a, b = spans_of(words.text[at[gone]], words.place[at[gone]])
            # a text asks once for a window that it repeats, and names the further places
            left = order[~gone[order]]
            left = left[np.lexsort((at[left], words.text[at[left]], h2[left], h1[left]))]
            first = np.flatnonzero(heads(h1[left], h2[left], words.text[at[left]]))
            count = np.diff(np.append(first, len(left)))
            ask = left[first]
            places: list[bytes | None] = [None] * len(ask)
            for k in np.flatnonzero(count > 1):
                places[k] = words.place[at[left[first[k] : first[k] + count[k]]]].astype(np.int32).tobytes()
            zero = np.zeros(len(text), np.int64)
            yield batch(
                names,
                np.concatenate([h1[ask], _spread(doc[text], a)]),
                np.concatenate([h2[ask], zero]),
                np.concatenate([d[ask], doc[text]]),
                np.concatenate([key[words.text[at[ask]]], key[text]]),
                np.concatenate([words.place[at[ask]], a]).astype(np.int32),
                np.concatenate([words.place[at[ask]] + 1, b]).astype(np.int32),
                np.repeat(np.array([ASK, DONE], np.int8), [len(ask), len(text)]),
                pa.array(places + [None] * len(text), pa.binary()),
            )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and document, those whose hash came with a smaller document."""
    last = (None, None, None)
    for one in batches:
        h1, h2, doc, key, a, b, kind = (one.column(i).to_numpy() for i in range(7))
        done = np.flatnonzero(kind == DONE)
        ask = np.flatnonzero(kind == ASK)
        gone = np.zeros(0, np.int64)
        if len(ask):
            g1, g2, d = h1[ask], h2[ask], doc[ask]
            head = heads(g1, g2)
            least = d[np.flatnonzero(head)]
            if (g1[0], g2[0]) == last[:2]:
                least[0] = last[2]
            group = np.cumsum(head) - 1
            gone = ask[d > least[group]]
            last = (g1[-1], g2[-1], least[-1])
        listed = one.column(7).is_valid().to_numpy(zero_copy_only=False)
        many = gone[listed[gone]]
        more = [np.frombuffer(one.column(7)[int(k)].as_buffer(), np.int32) for k in many]
        of = np.repeat(many, [len(x) for x in more])
        more = np.concatenate([np.zeros(0, np.int32), *more])
        got = np.concatenate([done, gone[~listed[gone]]])
        yield batch(["doc", "key", "a", "b"], np.concatenate([doc[got], doc[of]]), np.concatenate([key[got], key[of]]), np.concatenate([a[got], more]), np.concatenate([b[got], more + np.int32(1)]))


def _gathered(spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each text with its set of spans (no more than its words)."""
    return stage(spans.groupBy(*keys).agg(F.collect_set(F.struct("a", "b")).alias("spans")), name)


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """_doc, _text and spans: the starts [a, b) of the windows of each text that also start in a document of smaller id.

    Anchors are shared if two different texts hold them. A copy of an earlier text has all its windows in that text, so
    only the first document of each text is searched further."""
    rows = keyed(docs)
    asked = rows.select("_text", "text").mapInArrow(_anchor_rows(window), FOUND)
    near = asked.repartition("k").sortWithinPartitions("k").mapInArrow(_shared(window), "doc bigint, a int, b int")
    regions = _gathered(near.withColumnRenamed("doc", "_text"), ["_text"], "anchors-regions")
    whole = stage(copies(rows), "anchors-copies").select("_doc", "_text")
    first = rows.select("_doc", "_text").distinct().join(whole, ["_doc", "_text"], "left_anti")
    sent = rows.join(stage(first.join(regions, "_text"), "anchors-first"), ["_doc", "_text"]).select("_doc", "_text", "text", "spans").mapInArrow(_window_rows(window), WINDOWS)
    found = sent.repartition("h1").sortWithinPartitions("h1", "h2", "doc").mapInArrow(_later, SPANS).withColumnsRenamed({"doc": "_doc", "key": "_text"})
    all_of = whole.select("_doc", "_text", F.lit(0).alias("a"), F.lit((1 << 31) - 1 - window).alias("b"))
    return _gathered(found.unionByName(all_of), ["_doc", "_text"], "anchors-repeated")


DEDUPED = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


def dedup_words(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove each word covered by a window of `window` words whose sequence also starts in a document of smaller doc_id.

    Returns doc_id, n_words, n_removed and kept (the kept words joined by one space, UTF-8). Words are runs without ASCII
    white space, unchanged. Null and empty texts have none. A null doc_id counts as larger than all others; rows of equal
    doc_id don't remove each other's words; texts shorter than the window lose nothing. Windows are compared by 128-bit
    hashes of their words. Other columns are not read.

    Skew: a chunk of documents sends one row for each hash it holds, so a passage or a copy that a third of all documents
    share costs a row for each chunk, not for each document.
    """
    spans = repeated_spans(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(one.column(1), one.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                if found and len(words) >= window:
                    n = len(words)
                    a, b = np.array([(s["a"], s["b"]) for s in found], np.int64).T
                    gone = covered(np.minimum(a, n), np.minimum(b + window - 1, n), n)
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join(compress(words, (~gone).tolist())))
                else:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                n_words.append(len(words))
            yield batch(["doc_id", "n_words", "n_removed", "kept"], one.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()))

    rows = keyed(docs.select("doc_id", "text"))
    joined = rows.withColumn("text", F.col("text").cast("binary")).join(spans, ["_doc", "_text"], "left")
    return joined.select(F.when(F.col("_doc") != LAST_ID, F.col("_doc")).alias("doc_id"), "text", "spans").mapInArrow(run, DEDUPED)


def op2_difference_cover(spark, sf_dir: str) -> DataFrame:
    out = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS g FROM d, unnest(range(greatest(len(w) - 49, 0))) AS t(s)),
later AS (SELECT doc_id, s FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM later, unnest(range(50)) AS t(k)),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS p FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce((SELECT string_agg(w[i + 1], ' ' ORDER BY i) FROM unnest(range(len(w))) AS t(i) WHERE NOT list_contains(p, i)), '') END) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id
"""
