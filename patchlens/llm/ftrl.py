"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Edge cases: a null or empty text has no n-grams and gets the score of the bias alone; label rows without a label are
left out, of several labels of one document the largest counts; without labelled rows every score is 0.5; repeated
rows each give their row; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.words import SLICE, U, Words, mix, slices

BITS = 18
#: Labelled rows fitted on, at most: those whose hashed id is smallest. Scores and statistics cover all rows.
MAX_TRAIN = 12_000
KIND = np.zeros(256, np.uint64)  # letters by case, digits; other characters stand for themselves
KIND[:] = np.arange(256)
KIND[ord("a"):ord("z") + 1] = KIND[0x80:] = ord("a")
KIND[ord("A"):ord("Z") + 1] = ord("A")
KIND[ord("0"):ord("9") + 1] = ord("0")


def held_out(key) -> F.Column:
    """Rows never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def ngrams(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each word n-gram of a slice: words, word pairs, word shapes, shape pairs, repetitions."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    down = U(64 - bits)
    with np.errstate(over="ignore"):
        kind = KIND[w.raw]
        end, start = w.end - 1, w.start
        shape = mix(kind[start] + (kind[end] << U(8)) + (kind[np.maximum(end - 1, start)] << U(16))
                    + (kind[np.maximum(end - 2, start)] << U(24)) + (kind[np.minimum(start + 1, end)] << U(32))
                    + U(1 << 48))
        parts = [(w.hash, w.text), (shape, w.text)]
        same = w.text[1:] == w.text[:-1]
        parts.append((mix(w.hash[:-1] + w.hash[1:] * U(3))[same], w.text[1:][same]))
        parts.append((mix(shape[:-1] + shape[1:] * U(5))[same], w.text[1:][same]))
        for lag in range(1, 17):
            if n <= lag + 1:
                break
            again = (w.hash[lag:] == w.hash[:-lag]) & (w.text[lag:] == w.text[:-lag])
            if lag > 1:  # the word before was repeated at the same distance too
                again[1:] &= again[:-1].copy()
                again[0] = False
            own = w.text[lag:][again]
            parts.append((np.full(len(own), mix(np.array([min(lag, 3) + 1000], U))[0]), own))
    return (np.concatenate([(h >> down).astype(np.int64) for h, _ in parts]),
            np.concatenate([t for _, t in parts]))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, epochs: int = 3,
          alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates; the last weight is the bias."""
    size = (1 << bits) + 1
    z, g2, w = np.zeros(size), np.zeros(size), np.zeros(size)
    order = np.arange(len(bags))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at, x = bags[i]
            zi, ni = z[at], g2[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - labels[i]) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            g2[at] = ni + g * g
    keep = np.abs(z) > l1
    w[keep] = -(z[keep] - np.sign(z[keep]) * l1) / ((beta + np.sqrt(g2[keep])) / alpha + l2)
    return w


def bags_of(column, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) per text: counts over the square root of the text's number of words, and the bias."""
    for w in slices(column):
        at, text = ngrams(w, bits)
        order = np.argsort(text, kind="stable")
        at, cuts = at[order], np.searchsorted(text[order], np.arange(w.last - w.first + 1))
        for i in range(w.last - w.first):
            own, count = np.unique(at[cuts[i]:cuts[i + 1]], return_counts=True)
            yield np.append(own, 1 << bits), np.append(count / np.sqrt(max(1, w.counts[i])), 1.0)


def scores_of(column, weights: np.ndarray, bits: int) -> np.ndarray:
    out = []
    for w in slices(column):
        at, text = ngrams(w, bits)
        dot = np.bincount(text, weights=weights[at], minlength=w.last - w.first)
        out.append(dot / np.sqrt(np.maximum(1, w.counts)) + weights[-1])
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35))) if out else np.zeros(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(key, text, y) of at most `most` labelled rows that are not held out, those of the smallest hashed ids. Of
    several texts of an id, that of the smallest hash is learned."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("y"))
            .where(F.col("y").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
            .groupBy("key").agg(F.max("y").alias("y"))
            .orderBy(F.xxhash64("key"), "key").limit(most))
    # at most `most` narrow rows, so they travel to the documents
    return (docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text"))
            .join(F.broadcast(rows), "key").groupBy("key")
            .agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r")).select("key", "r.text", "r.y"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS,
                max_train: int = MAX_TRAIN, **settings) -> np.ndarray:
    """Weights fitted in one task on the bounded sample; 2**bits + 1 numbers come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bags, y = [], [], []
        for b in batches:
            keys += b.column(0).to_pylist()
            bags += bags_of(b.column(1), bits)
            y += b.column(2).to_pylist()
        order = np.argsort(np.array(keys, np.int64))  # the same weights however rows arrive
        w = train([bags[i] for i in order], np.array(y, float)[order] if y else np.zeros(0), bits, **settings)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64).tobytes()], pa.binary())], ["w"])

    rows = labelled_sample(docs, labels, label, max_train).coalesce(1).mapInArrow(run, "w binary").collect()
    total = [np.frombuffer(bytes(r.w), np.float64) for r in rows]
    return total[0] if total else np.zeros((1 << bits) + 1)


def score_quality(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from its whole text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)  # 2**bits + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores_of(b.column(1), w, bits), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, weights: np.ndarray, bits: int = BITS, least: float = 0.5) -> DataFrame:
    """Documents with all their columns, without those that score below `least`; no shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            yield b.filter(pa.array(scores_of(b.column(at), w, bits) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["SLICE", "fit_quality", "score_quality", "keep_quality", "held_out", "labelled_sample"]
