"""Suffix-array dedup of bytes by bucket refinement: suffixes start in buckets of sampled q-grams, and buckets of one
suffix are dropped. The rest is refined in rounds: a suffix's bucket identifier and the one at a later offset name a wider
bucket, buckets are sorted by these, suffixes alone in theirs are dropped, and the new identifiers serve the next, wider
round, until a bucket stands for 200 equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import ASK, DONE, TELL, _spread
from .common import _BYTES, BASES, LAST_ID, Rolling, batch, chunks, covered, heads, hot_join, keyed, mix, release, runs, stage, text_bytes, unstage

#: Bytes of the initial buckets' q-grams. Of the LENGTH - Q + 1 q-grams in a string of LENGTH bytes the least is sampled.
LENGTH, Q = 200, 40
#: Bytes of text that a worker holds; suffixes in a task of the refinement, about.
CHUNK, BUCKET = 1 << 20, 1_000_000


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values (those that don't fit are left out)."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Texts:
    """Bytes of a chunk of texts, and their stretches: neighbouring strings of `length` bytes with one sample.

    The sample of a string is the least of its q-grams' hashes, the leftmost of equals, so it depends on the string alone.
    `low` to `high` are the starts of a stretch's strings (high exclusive), `at` is their sample and `hash` its hash."""

    def __init__(self, texts: pa.ChunkedArray, rolling: Rolling, length: int = LENGTH):
        self.raw, self.edge = text_bytes(texts)
        self.size = np.diff(self.edge)
        n = len(self.raw)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.at = self.low = self.high = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n < length:
            return
        self.prefix = rolling.prefix(_BYTES[self.raw])
        start = np.arange(n - Q + 1)
        hashes = rolling.windows(self.prefix, start, start + Q)
        bits = np.uint64(max(1, int(n).bit_length()))
        chosen = least((hashes >> bits << bits) | start.astype(np.uint64), length - Q + 1)
        fits = np.flatnonzero((self.edge[1:][self.text] - np.arange(n))[: len(chosen)] >= length)
        own = (chosen[fits] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        head = np.flatnonzero(heads(own, self.text[fits]))
        if len(head):
            self.at, self.low, self.high = own[head], fits[head], fits[np.append(head[1:], len(fits)) - 1] + 1
            self.hash = hashes[self.at]

    def names(self, rolling: Rolling, length: int) -> np.ndarray:
        """Identifiers of whole stretches: their bytes, and where the sample lies."""
        whole = rolling.windows(self.prefix, self.low, self.high + length - 1) if len(self.at) else self.hash
        return mix(whole + (self.at - self.low).astype(np.uint64) * np.uint64(BASES[1]) + (self.high - self.low).astype(np.uint64) * np.uint64(BASES[2]))

    def place(self, at: np.ndarray) -> np.ndarray:
        return at - self.edge[self.text[at]]


#: Rows of stretches: a class (k, u) asked about, one that this chunk holds more than once, and places known to have twins.
STRETCHES = "k bigint, u bigint, _text bigint, a int, b int, kind tinyint"
#: What comes back: places with twins, and places whose suffixes must be compared one by one.
TWIN, DENSE = 0, 1


def _samples(length: int):
    names = [c.split()[0] for c in STRETCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for table in chunks(batches, "text", CHUNK):
            table = table.take(np.sort(np.unique(table["_text"].to_numpy(), return_index=True)[1]))
            texts, key = Texts(table["text"], rolling, length), table["_text"].to_numpy()
            if not len(texts.at):
                continue
            k, u = texts.hash.view(np.int64), texts.names(rolling, length).view(np.int64)
            order = np.lexsort((texts.low, u, k))
            first = np.flatnonzero(heads(k[order], u[order]))
            count = np.diff(np.append(first, len(order)))
            sent, many = order[first], np.sort(order[np.repeat(count > 1, count)])
            text = key[texts.text[texts.low]]
            a = texts.place(texts.low).astype(np.int32)
            b = a + (texts.high - texts.low).astype(np.int32)
            yield batch(
                names,
                np.concatenate([k[sent], _spread(text[many], a[many])]),
                np.concatenate([u[sent], np.zeros(len(many), np.int64)]),
                np.concatenate([text[sent], text[many]]),
                np.concatenate([a[sent], a[many]]),
                np.concatenate([b[sent], b[many]]),
                np.concatenate([np.where(count > 1, TELL, ASK), np.full(len(many), DONE)]).astype(np.int8),
            )

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by k, u, text and place. A class with two places (or a chunk's word that it has) gives them all as
    twins. Where a bucket k has several classes, the first place of each is to be compared suffix by suffix: a string's
    twin has the same sample, so it lies in one of these classes. Between batches one row of each kind is remembered."""
    last = pend = lead = None  # the last row; the last class's only place; the last bucket's only class
    for one in batches:
        k, u, text, a, b, kind = (one.column(i).to_numpy() for i in range(6))
        out: list[tuple[np.ndarray, int]] = []
        extra: list[tuple[int, int, int, int]] = []
        done = np.flatnonzero(kind == DONE)
        out.append((done, TWIN))
        row = np.flatnonzero(kind != DONE)
        if len(row):
            row = row[heads(k[row], u[row], text[row], a[row], kind[row])]  # a text's copies ask alike
        if len(row) and last is not None and (k[row[0]], u[row[0]], text[row[0]], a[row[0]], kind[row[0]]) == last:
            row = row[1:]
        if len(row):
            new_k, new_c = heads(k[row]), heads(k[row], u[row])
            goes_k = last is not None and k[row[0]] == last[0]
            goes_c = goes_k and u[row[0]] == last[1]
            group = np.cumsum(new_c) - 1
            first = np.flatnonzero(new_c)
            size = np.diff(np.append(first, len(row)))
            twin = (size > 1) | np.logical_or.reduceat(kind[row] == TELL, first)
            twin[0] |= goes_c
            if goes_c and pend is not None:
                extra.append((*pend, TWIN))
            out.append((row[twin[group] & (kind[row] == ASK)], TWIN))
            alone = not twin[-1] and kind[row[-1]] == ASK
            pend = (int(text[row[-1]]), int(a[row[-1]]), int(b[row[-1]])) if alone else None
            # classes of each bucket in this batch; the first may belong to a bucket or a class that goes on
            fresh = first[1:] if goes_c else first
            bucket = np.cumsum(new_k) - 1
            per = np.bincount(bucket[first], minlength=bucket[-1] + 1)
            several = per > 1
            if goes_k:
                several[0] = per[0] + (0 if goes_c else 1) > 1 or lead is None
                if several[0] and lead is not None:
                    extra.append((*lead, DENSE))
                    lead = None
            out.append((row[fresh[several[bucket[fresh]]]], DENSE))
            end = bucket[-1]
            if not several[end]:
                if not (goes_k and end == 0):
                    h = row[first[-1]]
                    lead = (int(text[h]), int(a[h]), int(b[h]))
            else:
                lead = None
            z = row[-1]
            last = (k[z], u[z], text[z], a[z], kind[z])
        at = np.concatenate([x for x, _ in out])
        what = np.concatenate([np.full(len(x), w, np.int8) for x, w in out])
        yield batch(
            ["_text", "a", "b", "kind"],
            np.concatenate([text[at], np.array([e[0] for e in extra], np.int64)]),
            np.concatenate([a[at], np.array([e[1] for e in extra], np.int32)]).astype(np.int32),
            np.concatenate([b[at], np.array([e[2] for e in extra], np.int32)]).astype(np.int32),
            np.concatenate([what, np.array([e[3] for e in extra], np.int8)]).astype(np.int8),
        )


def widths(length: int) -> list[int]:
    """Bytes that a bucket stands for, round by round: twice as many each time, from the q-grams' to `length`."""
    out = [Q]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def refined(names: np.ndarray, step: int, wider: int) -> np.ndarray:
    """Bucket identifiers of `wider` bytes from those of `step`: the one at a place and the one at a later offset."""
    ahead = wider - step
    return mix(names[: len(names) - ahead] * np.uint64(BASES[1]) + (names[ahead:] ^ np.uint64(step)))


#: Suffixes by bucket, in packed numbers: of those that are alone in their chunk texts, how many of each, places (as gaps)
#: and identifiers; identifiers that several of the chunk have, told once; and these suffixes themselves, already decided.
SUFFIXES = "bucket int, texts binary, counts binary, places binary, names binary, tells binary, done boolean"


def _listed(text: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Texts, how many places of each, and the places as gaps; rows come sorted by text and place."""
    head = np.flatnonzero(heads(text))
    gaps = np.diff(place, prepend=0)
    gaps[head] = place[head]
    return text[head].tobytes(), np.diff(np.append(head, len(text))).astype(np.uint32).tobytes(), gaps.astype(np.uint32).tobytes()


def _unlisted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts, gaps = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in rows[c])]) for c, kind in (("texts", np.int64), ("counts", np.uint32), ("places", np.uint32)))
    total = np.cumsum(gaps.astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts.astype(np.int64))[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    return np.repeat(keys, counts), total - np.repeat(total[first] - gaps[first], counts)


def _suffixes(width: int, buckets: int):
    """Rows of one round, from texts and the places (spans or lists of packed numbers) that are still to be told apart."""
    steps = widths(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        initial = [Rolling(BASES[1]), Rolling(BASES[2])]
        for table in chunks(batches, "text", CHUNK):
            raw, edge = text_bytes(table["text"])
            key, n = table["_text"].to_numpy(), len(raw)
            if n < width:
                continue
            size = np.diff(edge)
            of = np.repeat(np.arange(len(size)), size)
            spans, lists = table["dense"].combine_chunks(), table["places"].combine_chunks()
            owner = np.repeat(np.arange(len(size)), np.diff(spans.offsets.to_numpy()))
            a, b = (spans.flatten().field(c).to_numpy().astype(np.int64) for c in (0, 1))
            live = covered(edge[owner] + a, edge[owner] + b, n)
            packed, ends = text_bytes(lists.flatten())
            owner = np.repeat(np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy())), np.diff(ends) // 4)
            live[edge[owner] + np.frombuffer(packed.tobytes(), np.uint32)] = True
            at = np.flatnonzero(live)
            at = at[at + width <= edge[of[at] + 1]]
            start = np.arange(n - Q + 1)
            names = []
            for r in initial:
                one = r.windows(r.prefix(_BYTES[raw]), start, start + Q)
                for step, wider in zip(steps, steps[1:]):
                    one = refined(one, step, wider)
                names.append(one[at])
            bucket = ((names[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((at, names[1], bucket))
            head = heads(bucket[order], names[1][order])
            count = np.diff(np.append(np.flatnonzero(head), len(order)))
            many = np.repeat(count > 1, count)
            asks, tells, done = np.sort(order[~many]), order[head & many], np.sort(order[many])
            text, place = key[of[at]], at - edge[of[at]]
            rows = []
            by = asks[np.argsort(bucket[asks], kind="stable")]
            edges, told = np.searchsorted(bucket[by], np.arange(buckets + 1)), np.searchsorted(bucket[tells], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges) + np.diff(told)):
                cut = by[edges[b] : edges[b + 1]]
                rows.append((int(b), *_listed(text[cut], place[cut]), names[1][cut].tobytes(), names[1][tells[told[b] : told[b + 1]]].tobytes(), False))
            if len(done):
                rows.append((int(mix(key[:1].view(np.uint64))[0] % np.uint64(buckets)), *_listed(text[done], place[done]), b"", b"", True))
            if rows:
                kinds = [pa.int32()] + [pa.binary()] * 5 + [pa.bool_()]
                yield batch([c.split()[0] for c in SUFFIXES.split(", ")], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)))

    return run


def _twins(table: pa.Table) -> pa.Table:
    """Sort a bucket's suffixes by identifier; those that share theirs are given back by text, and so are those that their
    chunk has decided."""
    decided = table["done"].to_numpy()
    asked = table.filter(pa.array(~decided))
    text, place = _unlisted(asked)
    names, tells = (np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in asked[c])]) for c in ("names", "tells"))
    order = np.argsort(names, kind="stable")
    head = np.flatnonzero(heads(names[order]))
    count = np.diff(np.append(head, len(order)))
    many = order[np.repeat(count > 1, count) | np.isin(names[order], np.unique(tells))]
    both = [np.concatenate([x[many], y]) for x, y in zip((text, place), _unlisted(table.filter(pa.array(decided))), strict=True)]
    at = np.lexsort((both[1], both[0]))
    text, place = both[0][at], both[1][at].astype(np.uint32)
    head = np.flatnonzero(heads(text))
    ends = np.append(head, len(text))
    return pa.table({"_text": text[head], "places": pa.array([place[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())})


def refine(near: DataFrame, length: int, total: int) -> DataFrame:
    """_text and places (lists of packed numbers) of the suffixes of near (_text, text, dense) that share `length` bytes.
    `total` suffixes start in the dense spans; each round takes those that the one before left."""
    none, found = F.lit(None).cast("array<binary>"), None
    for width in widths(length)[1:]:
        if found is None:
            rows = near.withColumn("places", none)
        else:
            rows = near.drop("dense").join(found.hint("merge"), "_text").withColumn("dense", F.lit(None).cast("array<struct<a:int,b:int>>"))
            total = found.agg(F.coalesce(F.sum(F.aggregate("places", F.lit(0).cast("bigint"), lambda t, x: t + F.octet_length(x))), F.lit(0))).first()[0] // 4
        buckets = int(max(64, -(-total // BUCKET)))
        sorted_out = rows.select("_text", "text", "dense", "places").mapInArrow(_suffixes(width, buckets), SUFFIXES).groupBy("bucket").applyInArrow(_twins, "_text bigint, places binary")
        left = stage(sorted_out.groupBy("_text").agg(F.collect_list("places").alias("places")), f"suffix-{width}")
        if found is not None:
            unstage(found)
        found = left
        # shuffle files stay as long as a plan that reads them is held
        del rows, sorted_out
        release(near.sparkSession)
    return found


def repeated_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_doc, _text, spans [a, b) and places (lists of packed numbers) of the starts of repeated strings, and whole (the text
    stands in other rows too)."""
    rows = keyed(docs)
    asked = rows.select("_text", "text").mapInArrow(_samples(length), STRETCHES)
    met = asked.repartition("k").sortWithinPartitions("k", "u", "_text", "a").mapInArrow(_classes, "_text bigint, a int, b int, kind tinyint")
    spans = lambda what: F.collect_set(F.when(F.col("kind") == what, F.struct("a", "b")))
    sorted_out = stage(met.groupBy("_text").agg(spans(TWIN).alias("spans"), spans(DENSE).alias("dense")), "suffix-classes")
    # shuffle files stay as long as a plan that reads them is held
    del asked, met
    known = stage(rows.select("_doc", "_text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")), "suffix-texts")
    groups = known.groupBy("_sha").agg(F.count("*").alias("_n"), F.min("_doc").alias("_first")).filter("_n > 1")
    named = stage(hot_join(known, stage(groups, "suffix-groups"), "_sha", "_n", known.count(), "left").select("_doc", "_text", F.col("_first").isNotNull().alias("whole"), (F.coalesce("_first", "_doc") == F.col("_doc")).alias("first")).distinct(), "suffix-named")
    # one row for each text
    single = stage(named.filter("first").select("_doc", "_text").join(sorted_out, "_text"), "suffix-single")
    release(rows.sparkSession)
    total = single.agg(F.coalesce(F.sum(F.aggregate("dense", F.lit(0).cast("bigint"), lambda t, x: t + x["b"] - x["a"])), F.lit(0))).first()[0]
    near = rows.join(single.filter("size(dense) > 0").select("_doc", "_text", "dense").hint("merge"), ["_doc", "_text"]).select("_text", "text", "dense")
    near = stage(near.dropDuplicates(["_text"]), "suffix-near")
    release(rows.sparkSession)
    found = refine(near, length, total)
    placed = single.join(found, "_text", "left").filter("size(spans) > 0 or places is not null").select("_doc", "_text", "spans", "places")
    out = stage(named.select("_doc", "_text", "whole").join(placed, ["_doc", "_text"], "left").filter("whole or spans is not null"), "suffix-repeated")
    unstage(sorted_out, known, single, found, near)
    release(rows.sparkSession)
    return out


DEDUPED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else in the table.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes). Texts are UTF-8
    bytes and matches don't cross documents; null and empty texts have none; shorter texts lose nothing. Rows with equal
    texts remove each other whole, whatever their ids; a null doc_id is an id like any other. Strings are compared by
    identifiers of 64 bits and the bucket's number. Other columns are not read.

    Skew: of rows with equal texts one is searched; a chunk of texts sends one row for each q-gram that it holds twice.
    """
    rows = keyed(docs.select("doc_id", "text")).withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, ranges, places, whole in zip(*(one.column(k) for k in (1, 2, 3)), one.column(4).to_pylist(), strict=True):
                raw = text.as_py() or b""
                n, gone = len(raw), None
                if n >= length and whole:
                    gone = np.ones(n, bool)
                elif ranges.is_valid or places.is_valid:
                    at = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in (places.values if places.is_valid else ())]
                    a, b = ([ranges.values.field(c).to_numpy().astype(np.int64)] if ranges.is_valid else [] for c in (0, 1))
                    gone = covered(np.concatenate(a + at), np.concatenate([x + length - 1 for x in b] + [x + length for x in at]), n)
                sizes.append(n)
                removed.append(0 if gone is None else int(gone.sum()))
                spans.append(0 if gone is None else len(runs(gone)[0]))
                kept.append(raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield batch(["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], one.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(kept, pa.binary()))

    found = rows.join(repeated_places(docs, length), ["_doc", "_text"], "left")
    return found.select(F.when(F.col("_doc") != LAST_ID, F.col("_doc")).alias("doc_id"), "text", "spans", "places", F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(run, DEDUPED)


def op7_bucket_refinement(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, p, md5(substr(h, CAST(2 * p + 1 AS INTEGER), 400)) AS g FROM d, unnest(range(greatest(strlen(x) - 199, 0))) AS t(p)),
twice AS (SELECT r, p FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
runs AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS k
         FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM twice)) GROUP BY r, k),
pieces AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs
           UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, CAST(2 * a + 1 AS INTEGER), CAST(2 * (coalesce(b, strlen(x)) - a) AS INTEGER)), '' ORDER BY a) AS h FROM pieces JOIN d USING (r) GROUP BY r),
lost AS (SELECT r, sum(b - a) AS n, count(*) AS k FROM runs GROUP BY r)
SELECT doc_id, CAST(strlen(x) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
