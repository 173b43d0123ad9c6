"""Stochastic descent for linear classifiers: mini-batch steps on shards, weights averaged over the shards."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.operators.scoring import softmax, with_scores
from patchlens.session import discard, settle

SHARD_ROWS = 20_000  # rows of a shard on average; one task holds one shard
BATCH = 32


@dataclass
class LinearScores:
    """Weights [class, feature] with the bias last."""

    weights: np.ndarray

    def scores(self, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[:, :-1].T + self.weights[:, -1]

    def transform(self, rows: DataFrame) -> DataFrame:
        return with_scores(rows, self.scores, True)


def walk(weights: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float, penalty: float,
         order: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Mini-batch steps down the logistic loss over rows in `order`; the bias carries no penalty."""
    out, classes = weights.copy(), np.arange(len(weights))
    for at in range(0, len(order), batch):
        i = order[at:at + batch]
        rest = (softmax(x[i] @ out[:, :-1].T + out[:, -1]) - (y[i, None] == classes)) * w[i, None]
        out[:, :-1] -= rate * (rest.T @ x[i] / len(i) + penalty * out[:, :-1])
        out[:, -1] -= rate * rest.mean(axis=0)
    return out


def steps_order(seed: int, epoch: int, shard: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, epoch, shard]).permutation(n)


def rate_at(epoch: int, rate: float) -> float:
    return rate / math.sqrt(1 + epoch)


def fit_sgd(train: DataFrame, classes: int, epochs: int = 20, rate: float = 2.0, penalty: float = 1e-4,
            weight: str | None = "weight", seed: int = 42, shard_rows: int = SHARD_ROWS) -> LinearScores:
    """Logistic loss by stochastic descent. Columns: features, label (0 .. classes - 1).

    Rows are dealt to shards by a hash of what they hold. In an epoch each shard walks over its rows in small batches
    from the shared weights, and the mean of the ends, by rows, starts the next epoch: sums by coordinate, combined
    before they meet, so the driver sees the weights alone. `rate` is for rows of unit mean square length.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.select(F.col("label").cast("int").alias("label"), w.alias("weight"), vector_to_array("features").alias("x"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.avg(
        F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)).alias("square")).first()
    shards, width = max(1, math.ceil(size["n"] / shard_rows)), size["width"] or 0
    at = F.xxhash64("label", "weight", "x")
    rows = settle(rows.withColumn("at", at).withColumn("shard", F.pmod("at", F.lit(shards)).cast("int")), "shards")
    weights = np.zeros((classes, width + 1))
    base = rate / max(size["square"] or 0.0, 1e-12)

    for epoch in range(epochs if size["n"] else 0):
        start = weights

        def run(part: pa.Table) -> pa.Table:
            part = part.sort_by([("at", "ascending"), ("label", "ascending")])
            x = part["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
            shard = part["shard"][0].as_py()
            end = walk(start, x, np.asarray(part["label"]), np.asarray(part["weight"]), rate_at(epoch, base), penalty,
                       steps_order(seed, epoch, shard, len(x)))
            return pa.table({"n": pa.array([len(x)], pa.int64()), "w": pa.array([end.ravel()], pa.list_(pa.float64()))})

        ends = rows.groupBy("shard").applyInArrow(lambda part: run(part), "n long, w array<double>")
        means = ends.select("n", F.posexplode("w").alias("i", "w")).groupBy("i").agg(
            (F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).collect()
        flat = np.zeros(weights.size)
        for r in means:
            flat[r["i"]] = r["w"]
        weights = flat.reshape(weights.shape)
    discard(rows)
    return LinearScores(weights)
