"""Tree ensembles that Spark ML does not have: softmax boosting for many classes, and extremely random trees.

Features are cut into bins once. A level of all trees is one pass over the rows: each task sums up what its rows add to
every bin of every open node, the sums of a node meet, and its split is chosen where they meet. Only splits come to the
driver, so its share is the size of the model.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.operators.scoring import softmax, with_scores
from patchlens.session import discard, settle

BINS = 32
PASS_BYTES = 64 << 20  # of sums that a task holds in one pass; further nodes wait for the next pass
FAN_IN = 64  # partial sums of a node that meet in one group
LAMBDA = 1.0  # added to the curvature of a leaf
LEAST_CURVATURE = 1e-3
FOLD = 8  # boosting rounds after which margins are written down


@dataclass
class Tree:
    """Nodes in the order of their making; the right child follows the left one. A leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)])

    def split(self, node: int, feature: int, cut: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for value in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(value)
        return at, at + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value)


def descend(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, cut, left, _ = tree
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        f = feature[node[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at = node[rows]
        node[rows] = left[at] + (bins[rows, f] > cut[at])
    return node


def bin_edges(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, at even shares of the rows; width x bins numbers in all."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.select(F.posexplode(vector_to_array("features")).alias("i", "x")).where(~F.isnan("x")).groupBy("i").agg(
        F.percentile_approx("x", shares, 10_000).alias("edges")).collect()
    edges = {r["i"]: np.unique(r["edges"]) for r in found}
    return [edges.get(i, np.zeros(0)) for i in range(max(edges, default=-1) + 1)]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, values[:, i])
    return out


def _binned_rows(train: DataFrame, edges: list[np.ndarray], classes: int, weight: str | None) -> DataFrame:
    """(label, weight, bins, margins) of the training rows."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            raw = np.ascontiguousarray(binned(flat, edges)).tobytes()
            packed = [raw[i:i + width] for i in range(0, len(raw), width)] if width else [b""] * batch.num_rows
            zero = [[0.0] * classes] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(
                zero, pa.list_(pa.float64()))], ["label", "weight", "bins", "margins"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return settle(train.select(F.col("label").cast("int").alias("label"), w.alias("weight"), vector_to_array("features").alias("x")).mapInArrow(
        run, "label int, weight double, bins binary, margins array<double>"), "binned")


def _unpack(batch: pa.RecordBatch, width: int, classes: int):
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    margins = batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
    return bins, np.asarray(batch.column("label")), np.asarray(batch.column("weight")), margins


def _add(margins: np.ndarray, bins: np.ndarray, rounds: list[list[tuple]]) -> np.ndarray:
    """Margins with the trees of some rounds, one tree a class."""
    out = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree[3][descend(tree, bins), 0]
    return out


SUMS = "tree int, node int, sums array<double>"
SPLITS = "tree int, node int, feature int, cut int, low array<double>, high array<double>"


def _splits(rows: DataFrame, trees: list[tuple], nodes: list[tuple[int, int]], features: np.ndarray, width: int,
            bins: int, classes: int, stats: Callable, choose: Callable) -> list:
    """The split of each open node (tree, node). `features` [node, m] are those that it may use, `stats` gives what each
    row adds for a tree ([row, channel]), `choose` the split from sums [m, bin, channel]."""
    m, told = features.shape[1], rows.sparkSession.sparkContext.broadcast(trees)
    slots = [np.full(len(t[0]), -1, np.int64) for t in trees]
    for at, (t, node) in enumerate(nodes):
        slots[t][node] = at
    used = sorted({t for t, _ in nodes})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label, weight, margins = _unpack(batch, width, classes)
            of_tree = stats(x, label, weight, margins)
            for t in used:
                slot = slots[t][descend(told.value[t], x)]
                at = np.flatnonzero(slot >= 0)
                own = of_tree(t)[at]
                if total is None:
                    total = np.zeros((own.shape[1], len(nodes) * m * bins))
                place = ((slot[at, None] * m + np.arange(m)) * bins + x[at[:, None], features[slot[at]]]).ravel()
                for c in range(own.shape[1]):
                    total[c] += np.bincount(place, np.repeat(own[:, c], m), total.shape[1])
        if total is not None:
            by_node = total.reshape(len(total), len(nodes), -1).transpose(1, 2, 0).reshape(len(nodes), -1)
            some = np.flatnonzero(np.any(by_node != 0, axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i][0] for i in some], pa.int32()), pa.array([nodes[i][1] for i in some], pa.int32()),
                 pa.array(list(by_node[some]), pa.list_(pa.float64()))], ["tree", "node", "sums"])

    def meet(part: pa.Table) -> pa.Table:
        return pa.table({"tree": part["tree"][:1], "node": part["node"][:1],
                         "sums": pa.array([_total(part)], pa.list_(pa.float64()))})

    def best(part: pa.Table) -> pa.Table:
        t, node = part["tree"][0].as_py(), part["node"][0].as_py()
        sums = _total(part).reshape(m, bins, -1)
        feature, cut, low, high = choose(sums, t, node)
        mine = features[slots[t][node]]
        return pa.table({"tree": [t], "node": [node], "feature": [-1 if feature < 0 else int(mine[feature])], "cut": [int(cut)],
                         "low": [low.tolist()], "high": [high.tolist()]}, schema=pa.schema(
            [("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()),
             ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(add_up, SUMS)
    fan = math.ceil(rows.rdd.getNumPartitions() / FAN_IN)
    if fan > 1:
        parts = parts.groupBy("tree", "node", F.pmod(F.spark_partition_id(), F.lit(fan))).applyInArrow(
            lambda part: meet(part), SUMS)
    found = parts.groupBy("tree", "node").applyInArrow(lambda part: best(part), SPLITS).collect()
    told.destroy()
    return sorted(found, key=lambda r: (r["tree"], r["node"]))


def _total(part: pa.Table) -> np.ndarray:
    sums = part["sums"].combine_chunks()
    return sums.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).sum(axis=0)


def _chunks(nodes: list, size: int) -> Iterator[list]:
    for at in range(0, len(nodes), size):
        yield nodes[at:at + size]


@dataclass
class TreeEnsemble:
    """A fitted ensemble; adds rawPrediction, probability and prediction to rows with a features vector."""

    trees: list[Tree]
    edges: list[np.ndarray]
    classes: int
    boosted: bool

    def scores(self, values: np.ndarray) -> np.ndarray:
        x = binned(values, self.edges)
        trees = [t.arrays() for t in self.trees]
        if self.boosted:
            rounds = [trees[i:i + self.classes] for i in range(0, len(trees), self.classes)]
            return _add(np.zeros((len(x), self.classes)), x, rounds)
        total = np.zeros((len(x), self.classes))
        for tree in trees:
            counts = tree[3][descend(tree, x)]
            total += counts / counts.sum(axis=1, keepdims=True)
        return total / len(trees)

    def transform(self, rows: DataFrame) -> DataFrame:
        return with_scores(rows, self.scores, self.boosted)


def fit_softmax_boosting(train: DataFrame, classes: int, rounds: int = 100, depth: int = 5, rate: float = 0.1,
                         weight: str | None = "weight", bins: int = BINS) -> TreeEnsemble:
    """Gradient boosting on the softmax loss: each round adds one tree a class, all fitted to the residuals of the same
    probabilities. Columns: features, label (0 .. classes - 1)."""
    edges = bin_edges(train, bins)
    width = len(edges)
    rows = _binned_rows(train, edges, classes, weight)
    model = TreeEnsemble([], edges, classes, True)
    every = np.arange(width)
    folded = 0

    def choose(sums: np.ndarray, tree: int, node: int):
        whole = sums[0].sum(axis=0)
        if not width:
            return -1, 0, whole, whole * 0
        low = sums.cumsum(axis=1)[:, :-1]
        high = whole - low
        worth = sum(x[..., 0]**2 / (x[..., 1] + LAMBDA) for x in (low, high))
        worth[(low[..., 1] < LEAST_CURVATURE) | (high[..., 1] < LEAST_CURVATURE)] = -np.inf
        f, cut = np.unravel_index(np.argmax(np.round(worth, 9)), worth.shape)
        if not worth[f, cut] > whole[0]**2 / (whole[1] + LAMBDA) + 1e-9:
            return -1, 0, whole, whole * 0
        return f, cut, low[f, cut], high[f, cut]

    def leaf(sums) -> np.ndarray:
        return np.array([-rate * sums[0] / (sums[1] + LAMBDA)])

    for turn in range(rounds):
        done = [[t.arrays() for t in model.trees[i:i + classes]] for i in range(folded * classes, len(model.trees), classes)]

        def stats(x, label, weight, margins, done=done):
            p = softmax(_add(margins, x, done))
            residual = (p - (label[:, None] == np.arange(classes))) * weight[:, None]
            curve = np.maximum(p * (1 - p), 1e-6) * weight[:, None]
            return lambda t: np.stack([residual[:, t], curve[:, t]], axis=1)

        new = [Tree() for _ in range(classes)]
        open_ = [(k, 0) for k in range(classes)]
        for level in range(depth):
            found = []
            for part in _chunks(open_, max(1, PASS_BYTES // (16 * max(1, width) * bins))):
                found += _splits(rows, [t.arrays() for t in new], part, np.tile(every, (len(part), 1)), width, bins, classes,
                                 stats, choose)
            open_ = []
            for r in found:
                tree = new[r["tree"]]
                if r["feature"] < 0:
                    if r["node"] == 0:
                        tree.value[0] = leaf(r["low"])
                    continue
                open_ += [(r["tree"], node) for node in tree.split(
                    r["node"], r["feature"], r["cut"], leaf(r["low"]), leaf(r["high"]))]
            if not open_:
                break
        model.trees += new
        if turn + 1 - folded == FOLD and turn + 1 < rounds:
            before = rows
            rows, folded = _fold(rows, [[t.arrays() for t in model.trees[i:i + classes]] for i in range(
                folded * classes, len(model.trees), classes)], width, classes), turn + 1
            discard(before)
    discard(rows)
    return model


def _fold(rows: DataFrame, done: list[list[tuple]], width: int, classes: int) -> DataFrame:
    """Rows with the margins that the trees so far give them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _, margins = _unpack(batch, width, classes)
            yield batch.set_column(3, "margins", pa.array(list(_add(margins, x, done)), pa.list_(pa.float64())))

    return settle(rows.mapInArrow(run, rows.schema), "margins")


def fit_extra_trees(train: DataFrame, classes: int, trees: int = 100, depth: int = 20, weight: str | None = "weight",
                    seed: int = 42, bins: int = BINS, features: int | None = None, least: float = 2.0) -> TreeEnsemble:
    """Extremely random trees: every tree sees all rows; a node draws some features and for each one cut between the
    least and greatest value that its rows have there, and takes the best of these cuts by Gini impurity."""
    edges = bin_edges(train, bins)
    width = len(edges)
    rows = _binned_rows(train, edges, classes, weight)
    m = min(max(width, 1), features or max(1, round(math.sqrt(width))))
    grown = [Tree() for _ in range(trees)]

    def drawn(tree: int, node: int) -> np.random.Generator:
        return np.random.default_rng([seed, tree, node])

    def choose(sums: np.ndarray, tree: int, node: int):
        rng, whole = drawn(tree, node), sums[0].sum(axis=0)
        mine = rng.choice(width, m, replace=False)  # the same draw as told to the tasks
        best, size = (-1, 0, whole, whole * 0), whole.sum()
        top = (whole**2).sum() / size + 1e-9 if np.count_nonzero(whole) > 1 and size >= least else np.inf
        for f in range(m):
            there = np.flatnonzero(sums[f].sum(axis=1))
            draw = rng.random()
            if there[0] == there[-1]:
                continue
            cut = random_cut(edges[mine[f]], there[0], there[-1], draw)
            low = sums[f, :cut + 1].sum(axis=0)
            high = whole - low
            worth = (low**2).sum() / low.sum() + (high**2).sum() / high.sum()
            if worth > top:
                best, top = (f, cut, low, high), worth
        return best

    def stats(x, label, weight, margins):
        counts = (label[:, None] == np.arange(classes)) * weight[:, None]
        return lambda t: counts

    open_ = [(t, 0) for t in range(trees)] if width else []
    for level in range(depth):
        found = []
        for part in _chunks(open_, max(1, PASS_BYTES // (8 * m * bins * classes))):
            mine = np.array([drawn(t, node).choice(width, m, replace=False) for t, node in part])
            found += _splits(rows, [t.arrays() for t in grown], part, mine, width, bins, classes, stats, choose)
        open_ = []
        for r in found:
            tree = grown[r["tree"]]
            if level == 0:
                tree.value[0] = np.array(r["low"]) + np.array(r["high"])
            if r["feature"] < 0:
                continue
            sides = [np.array(r["low"]), np.array(r["high"])]
            for node, counts in zip(tree.split(r["node"], r["feature"], r["cut"], *sides), sides):
                if np.count_nonzero(counts) > 1 and counts.sum() >= least:
                    open_.append((r["tree"], node))
        if not open_:
            break
    discard(rows)
    return TreeEnsemble(grown, edges, classes, False)


def random_cut(edges: np.ndarray, first: int, last: int, draw: float) -> int:
    """A bin from `first` on and before `last`: where a value drawn evenly between the edges of both falls."""
    low, high = edges[first], edges[last - 1]
    return int(np.clip(np.searchsorted(edges, low + draw * (high - low)), first, last - 1))
