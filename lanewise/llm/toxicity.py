"""Toxicity by character n-grams: presence of an n-gram counts as its naive Bayes log-count ratio, and a logistic
regression weighs these features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, batch, lean, mix

#: Lengths of n-grams in code points; bits of a bucket's number.
ORDERS, BITS = (3, 4, 5), 18
#: Labelled rows that the regression is fitted on at most (half of each label), and features that it weighs.
SAMPLE, FEATURES = 16_384, 8_192
#: Code points of a text that are hashed at once.
PIECE = 1 << 20


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows that no label is learnt from; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


class Grams:
    """Buckets of a text's n-grams. Flags of one text at a time, so a text's length costs no memory here."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS):
        self.orders, self.mask = orders, np.uint64((1 << bits) - 1)
        self.flags = np.zeros(1 << bits, bool)

    def __call__(self, text: str) -> np.ndarray:
        """The distinct buckets, in order. Letters are lowered, white space and controls count as spaces, and a space
        stands before and after the text."""
        text, reach = f" {text.lower()} ", max(self.orders) - 1
        for start in range(0, max(1, len(text) - reach), PIECE):
            points = np.frombuffer(text[start : start + PIECE + reach].encode("utf-32-le", "surrogatepass"), np.uint32)
            values = mix(np.maximum(points, 32).astype(np.uint64) * np.uint64(BASES[1]))
            rolled = values
            for n in range(2, max(self.orders) + 1):
                rolled = rolled[:-1] * np.uint64(BASES[0]) + values[n - 1 :]
                if n in self.orders:
                    self.flags[mix(rolled) & self.mask] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


@dataclass
class Model:
    """A weight (with the log-count ratio in it) for each bucket, and the intercept."""

    weights: np.ndarray
    intercept: float


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic and text of each row of docs that has a label to learn from. Of a doc_id's labels the largest counts; null
    ids and null labels teach nothing; a null text is an empty one. The texts that may be learnt from are shuffled once, at
    every size; they are the side of the join that Spark can split, so a doc_id of many rows does no harm."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.filter("doc_id IS NOT NULL").filter(~held_out()).select(F.col("doc_id").cast("bigint").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(known.hint("merge"), "_doc").select("toxic", "text")


def class_counts(rows: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of each label hold each bucket (2 x 2 ** bits), and how many texts there are of each, over all rows of
    (toxic, text). A task sends one row for each bucket it has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(orders, bits), np.zeros((2, (1 << bits) + 1), np.int64)
        for one in batches:
            for toxic, text in zip(one.column(0).to_pylist(), one.column(1), strict=True):
                seen[toxic, grams(text.as_py())] += 1
                seen[toxic, -1] += 1
        at = np.flatnonzero(seen.any(0))
        yield batch(["bucket", "clean", "toxic"], at.astype(np.int32), seen[0, at], seen[1, at])

    total = rows.select((F.col("toxic") > 0).cast("int").alias("toxic"), "text").mapInArrow(count, "bucket int, clean long, toxic long")
    out = np.zeros((2, (1 << bits) + 1), np.int64)
    met = total.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    out[:, met["bucket"]] = met[["clean", "toxic"]].to_numpy().T
    return out[:, :-1], out[:, -1]


def log_count_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    shares = counts + smooth
    shares = shares / shares.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def _telling(counts: np.ndarray, ratios: np.ndarray, most: int) -> np.ndarray:
    """The buckets whose ratio is largest in terms of its own error, in order."""
    certain = np.abs(ratios) / np.sqrt((1.0 / (counts + 1.0)).sum(0))
    return np.sort(np.argsort(-certain, kind="stable")[:most])


def regression(rows: list[np.ndarray], toxic: np.ndarray, scales: np.ndarray, weight: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression, by Newton steps whose systems are solved by conjugate
    gradients. rows: the features that each text holds; a feature counts as its scale."""
    lengths = np.array([len(r) for r in rows])
    flat, of, n = (np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)), np.repeat(np.arange(len(rows)), lengths), len(scales)
    forward = lambda w: np.bincount(of, (scales * w[:-1])[flat], len(rows)) + w[-1]
    back = lambda u: np.append(scales * np.bincount(flat, u[of], n), u.sum())
    held = np.append(np.full(n, penalty), 1e-9)
    w, signs = np.zeros(n + 1), np.where(toxic > 0, 1.0, -1.0)
    loss = lambda w: (weight * np.logaddexp(0, -signs * forward(w))).sum() + 0.5 * (held * w * w).sum()
    now = loss(w)
    for _ in range(rounds):
        chance = 1.0 / (1.0 + np.exp(-np.clip(forward(w), -500, 500)))
        slope = back(weight * (chance - (toxic > 0))) + held * w
        bend = weight * chance * (1 - chance)
        step, rest = np.zeros(n + 1), -slope
        way, size = rest.copy(), rest @ rest
        first = size
        for _ in range(25):
            if size <= 1e-4 * first:
                break
            turned = back(bend * (forward(way))) + held * way
            far = size / max(way @ turned, 1e-300)
            step, rest = step + far * way, rest - far * turned
            size, before = rest @ rest, size
            way = rest + (size / before) * way
        scale = 1.0
        while scale > 1e-4 and (new := loss(w + scale * step)) > now + 1e-4 * scale * (slope @ step):
            scale /= 2
        if scale <= 1e-4:
            break
        w, gain, now = w + scale * step, now - new, new
        if gain < 1e-6 * max(1.0, now):
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Learn from `labels` (doc_id, toxic) of documents outside the held-out fold; only their texts are features.

    The log-count ratios are counted over all labelled rows. The regression is fitted on a bounded sample: of each label
    the sample / 2 ids of least hash, weighted back to the labels' shares, and the `features` buckets of most certain
    ratio. What comes to the driver is the counts of 2 ** bits buckets and that sample's features. Without labels of both
    kinds the model is a constant: 0 with none, else the one label."""
    lean(docs.sparkSession)
    counts, texts = class_counts(labelled(docs, labels), orders, bits)
    if not texts.all():
        return Model(np.zeros(1 << bits), float("inf") if texts[1] else float("-inf"))
    ratios = log_count_ratios(counts)
    chosen = _telling(counts, ratios, features)
    place = np.full(1 << bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(orders, bits)
        for one in batches:
            found = [(at := place[grams(text.as_py() or "")])[at >= 0].tobytes() for text in one.column(1)]
            yield batch(["toxic", "held"], one.column(0), pa.array(found, pa.binary()))

    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    ids = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    once = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    # a doc_id of many rows has one in the sample
    drawn = once.select("toxic", "text", "doc_id").mapInArrow(lambda batches: pick(b.select(["toxic", "text"]) for b in _firsts(batches)), "toxic int, held binary").toPandas()
    drawn = drawn.sort_values(["toxic", "held"], kind="stable")
    toxic = drawn["toxic"].to_numpy()
    rows = [np.frombuffer(x, np.int32) for x in drawn["held"]]
    weight = np.where(toxic > 0, texts[1] / max(1, toxic.sum()), texts[0] / max(1, (1 - toxic).sum()))
    weight = weight * len(rows) / max(1.0, weight.sum())
    w, intercept = regression(rows, toxic, ratios[chosen], weight)
    weights = np.zeros(1 << bits)
    weights[chosen] = w * ratios[chosen]
    return Model(weights, intercept)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose doc_id (third column) this task hasn't met; it meets no more ids than the sample has."""
    met: set = set()
    for one in batches:
        new = [k for k, name in enumerate(one.column(2).to_pylist()) if not (name in met or met.add(name))]
        yield one.take(pa.array(new, pa.int64()))


def toxicity(docs: DataFrame, model: Model, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of every row, by its whole text, in one pass without a shuffle. A null or empty text is
    scored by the intercept and the n-grams of two spaces; equal texts score alike; null and repeated ids keep their rows;
    other columns are not read. The model's weights (2 ** bits numbers, however large the tables are) are broadcast."""
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (weights, intercept) = Grams(orders, bits), sent.value
        for one in batches:
            total = np.array([weights[grams(text.as_py() or "")].sum() for text in one.column(1)]) + intercept
            with np.errstate(over="ignore"):
                yield batch(["doc_id", "score"], one.column(0), 1.0 / (1.0 + np.exp(-total)))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def op12_nb_scaled(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
