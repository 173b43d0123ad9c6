"""Exact nearest neighbours by cells with bounds, and the retrieval gate.

References are dealt to cells around centroids. A cell knows how far its members lie from the centroid and within which
range each coordinate stays, which bounds the score that any of them can reach against a target. Neighbouring cells form
tiles of bounded size. A target goes to the tile of its nearest centroid first, and then only to tiles that hold a cell
whose bound reaches its k-th best score so far; inside a tile it meets only such cells, its best one first.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.operators.grouping import top_per_group, with_group_count
from patchlens.operators.tfidf import TermWeights, word_grams
from patchlens.rules import lexicon as L
from patchlens.session import settle

BLOCK_BYTES = 32 << 20  # of a tile's references as they are scored; as many targets meet it in one task
HEAD = 128  # coordinates of sparse references that bounds of their scores take one by one, those of the largest weights
BUCKETS = 128  # of the other coordinates, in which bounds take them together
TILES = 4  # of sparse references met by a task, one after the other
GROUP_ROWS = 4_096  # sparse references scored in one go
CHUNK_ROWS = 1_024
PLACES = 9  # scores are compared at this many places, so equal rows tie on every machine
SLACK = 2 * 10.0**-PLACES  # a bound this much below the k-th best score still counts as reached
CELL_ROWS = 64  # members of a cell on average, as long as there are no more than MAX_CELLS
MAX_CELLS = 1_024  # so what all tasks are told of the cells has a size that does not grow with the references
MAX_FIT = 4_096  # references, those of the smallest hashed ids, that the centroids are fitted on
FIT_ROUNDS = 4


def _dense(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    idx, val = batch.column("idx"), batch.column("val")
    if isinstance(idx, pa.ChunkedArray):
        idx, val = idx.combine_chunks(), val.combine_chunks()
    lengths = np.diff(np.asarray(idx.offsets))
    places, values = np.asarray(idx.flatten()), np.asarray(val.flatten())
    if len(places) == len(lengths) * dim and (places.reshape(-1, dim) == np.arange(dim)).all():
        return values.reshape(-1, dim)
    dense = np.zeros((len(lengths), dim))
    dense[np.repeat(np.arange(len(lengths)), lengths), places] = values
    return dense


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by a few rounds of nearest means, from the first rows that differ."""
    _, firsts = np.unique(sample, axis=0, return_index=True)
    centres = sample[np.sort(firsts)[:cells]].copy()
    for _ in range(FIT_ROUNDS if len(centres) > 1 else 0):
        own = nearest_centre(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


@dataclass
class Bounds:
    """What is known of each cell: centre, distances from it in each part of the coordinates and in all, and the
    least and greatest value of each coordinate. At most MAX_CELLS rows of `dim` numbers each."""

    centres: np.ndarray
    parts: list[tuple[int, int]]
    radii: np.ndarray  # [cell, part], the whole last
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    fill: float  # coordinates that a member names on average

    @property
    def width(self) -> int:
        """Numbers held of a reference while it is scored; less than its coordinates where references are sparse (their
        bounds are of half the size)."""
        sparse = (HEAD + BUCKETS) // 2 + 2 * math.ceil(self.fill)
        return sparse if 2 * sparse < self.centres.shape[1] else self.centres.shape[1]

    def of(self, targets: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """No member of a cell scores more than this against a target: [target, cell].

        In each part the score is at most the centre's plus the target's length times the radius, and at most the sum
        of each coordinate's greatest product; over all coordinates the first holds as well.
        """
        centres, radii = self.centres[cells], self.radii[cells]
        near = targets @ centres.T
        reach = near + np.linalg.norm(targets, axis=1)[:, None] * radii[:, -1]
        total = np.zeros_like(near)
        for p, (a, b) in enumerate(self.parts):
            t = targets[:, a:b]
            ball = t @ centres[:, a:b].T + np.linalg.norm(t, axis=1)[:, None] * radii[:, p]
            box = np.maximum(t, 0) @ self.high[cells, a:b].T
            if (t < 0).any():
                box += np.minimum(t, 0) @ self.low[cells, a:b].T
            total += np.minimum(ball, box)
        return np.where(self.sizes[cells] > 0, np.minimum(reach, total), -np.inf)

    def tiles(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(first tile, number of tiles) of each cell. Cells that lie near each other share a tile of at most so many
        rows; a larger cell is cut into tiles of its own."""
        middle = self.centres - self.centres.mean(axis=0)
        axis = np.linalg.svd(middle, full_matrices=False)[2][0] if len(middle) > 1 else np.zeros(middle.shape[1])
        first, parts = np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64)
        tile, held = 0, 0
        for cell in np.argsort(middle @ axis, kind="stable").tolist():
            size = int(self.sizes[cell])
            if held and held + size > rows:
                tile, held = tile + 1, 0
            first[cell], parts[cell] = tile, max(1, math.ceil(size / rows))
            held += size
            if parts[cell] > 1:
                tile, held = tile + int(parts[cell]), 0
        return first, parts


@dataclass
class VectorIndex:
    """References in cells. `rows`: id, idx, val, cell and the distances from its centre; `bounds` as told to tasks."""

    rows: DataFrame
    bounds: Bounds
    dim: int

    @classmethod
    def build(cls, references: DataFrame, dim: int, split: int = 0, cell_rows: int = CELL_ROWS,
              settled: bool = False) -> "VectorIndex":
        """Deal references (id, idx, val) to cells. `split` parts the coordinates into two with bounds of their own.
        They are read three times, and so written first unless they come from a settled table."""
        whole = references.select("id", "idx", "val")
        whole = whole if settled else settle(whole, "references")
        cells = max(1, min(MAX_CELLS, math.ceil(whole.count() / cell_rows)))
        sample = whole.orderBy(F.xxhash64("id", "idx", "val")).limit(MAX_FIT if cells > 1 else 1).toArrow()
        centres = fit_centres(_dense(sample, dim), cells) if sample.num_rows else np.zeros((1, dim))
        parts = [(0, split), (split, dim)] if 0 < split < dim else [(0, dim)]
        told = whole.sparkSession.sparkContext.broadcast(centres)

        def deal(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK_ROWS):
                    part = batch.slice(at, CHUNK_ROWS)
                    dense = _dense(part, dim)
                    own = nearest_centre(dense, told.value)
                    away = dense - told.value[own]
                    far = [np.linalg.norm(away[:, a:b], axis=1) for a, b in [*parts, (0, dim)]]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(own, pa.int32()), pa.array(list(np.array(far).T))],
                        [*part.schema.names, "cell", "far"])

        rows = settle(whole.mapInArrow(deal, "id long, idx array<int>, val array<double>, cell int, far array<double>"),
                      "cells")
        told.destroy()
        return cls(rows, _bounds(rows, centres, parts), dim)

    def write(self, path: str) -> None:
        """Rows in one folder a cell, so that a search reads the cells that it visits; centres and parts beside them."""
        spark = self.rows.sparkSession
        slices = F.pmod(F.xxhash64("id"), F.lit(max(1, int(self.bounds.sizes.max()) // (CELL_ROWS * 1_000))))
        self.rows.repartition("cell", slices).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        split = self.bounds.parts[0][1] if len(self.bounds.parts) > 1 else 0
        spark.createDataFrame([(i, self.dim, split, c.tolist()) for i, c in enumerate(self.bounds.centres)],
                              "cell int, dim int, split int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "VectorIndex":
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MAX_CELLS rows
        dim, split = found[0]["dim"], found[0]["split"]
        parts = [(0, split), (split, dim)] if split else [(0, dim)]
        rows = spark.read.schema("id long, idx array<int>, val array<double>, far array<double>, cell int").parquet(f"{path}/rows")
        return cls(rows, _bounds(rows, np.array([r["centre"] for r in found]), parts), dim)


def _bounds(rows: DataFrame, centres: np.ndarray, parts: list[tuple[int, int]]) -> Bounds:
    """Counts, radii and coordinate ranges by cell, from aggregates whose size is cells x coordinates."""
    cells, dim = centres.shape
    radii, sizes = np.zeros((cells, len(parts) + 1)), np.zeros(cells, np.int64)
    far = [F.max(F.get("far", F.lit(p))).alias(f"r{p}") for p in range(len(parts) + 1)]
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *far).collect():
        sizes[r["cell"]] = r["n"]
        radii[r["cell"]] = [r[f"r{p}"] for p in range(len(parts) + 1)]
    entries = rows.select("cell", F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(
        "cell", F.col("e.idx").alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.min("e.val").alias("low"), F.max("e.val").alias("high")).toArrow()
    cell, i = (np.asarray(entries.column(c)) for c in ("cell", "i"))
    low, high = np.zeros((cells, dim)), np.zeros((cells, dim))
    # a coordinate that not every member names is 0 for the others
    every = np.asarray(entries.column("n")) == sizes[cell]
    lows, highs = np.asarray(entries.column("low")), np.asarray(entries.column("high"))
    low[cell, i] = np.where(every, lows, np.minimum(lows, 0))
    high[cell, i] = np.where(every, highs, np.maximum(highs, 0))
    return Bounds(centres, parts, radii, low, high, sizes, float(np.asarray(entries.column("n")).sum() / max(1, sizes.sum())))


@dataclass
class SearchCost:
    """Scores worked out by a search, and those of all targets against all references."""

    scores: int = 0
    all_scores: int = 0


def nearest(targets: DataFrame, references: DataFrame | VectorIndex, dim: int, k: int = 1,
            threshold: float | None = None, carry: tuple[str, ...] = (), split: int = 0,
            block_rows: int | None = None, cell_rows: int = CELL_ROWS, cost: SearchCost | None = None) -> DataFrame:
    """Exact top k references by dot product. Both sides have columns id, idx, val.

    One plan at any size. Every target row has its own result, also among equal ids. With one reference per target and
    no threshold, all targets stay: without any reference their score is 0. `carry` names target columns to keep in the
    result; `cost` is told what the search took. `block_rows` bounds what a task holds of either side.
    """
    index = references if isinstance(references, VectorIndex) else VectorIndex.build(references, dim, split, cell_rows)
    whole = settle(targets.select("id", "idx", "val", *carry).withColumn("_row", F.monotonically_increasing_id()), "targets")
    found = _search(whole.select("id", "_row", "idx", "val"), index, k, threshold,
                    block_rows or max(64, BLOCK_BYTES // (8 * index.bounds.width)), cost)
    own = whole.select(F.col("id").alias("target_id"), "_row", *carry)
    if k == 1:
        best = F.max(F.struct("score", (-F.col("reference_id")).alias("key"))).alias("b")
        merged = found.groupBy("_row").agg(best)
        out = own.join(merged, "_row", "inner" if threshold is not None else "left")
        return out.select("target_id", (-F.col("b.key")).alias("reference_id"),
                          F.coalesce("b.score", F.lit(0.0)).alias("score"), *carry)
    order = [F.col("score").desc(), F.col("reference_id")]
    return top_per_group(found, ["_row"], order, k, ["reference_id"]).join(own, "_row").drop("_row")


FOUND = "_row long, reference_id long, score double, spent long"


class _Best:
    """The best k references of some targets so far: score descending, then smaller reference id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.start, self.k = floor, k

    def floor(self) -> np.ndarray:
        return np.maximum(self.start, self.scores[:, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Unrounded scores of `rows` against references. Only what can still be among the best is rounded and ranked."""
        floor = self.floor()[rows]
        if self.k > 1 and scores.shape[1] > 4 * self.k:  # rows with many that pass: their own k-th best bars the rest
            many = np.flatnonzero((scores >= (floor - SLACK)[:, None]).sum(axis=1) > 4 * self.k)
            if len(many):
                least = np.partition(scores[many], -self.k, axis=1)[:, -self.k]
                floor[many] = np.maximum(floor[many], np.round(least, PLACES))
        elif self.k == 1 and scores.shape[1]:
            floor = np.maximum(floor, np.round(scores.max(axis=1), PLACES))
        at, col = np.nonzero(scores >= (floor - SLACK)[:, None])
        self.merge(rows, at, scores[at, col], ids[col], floor)

    def merge(self, rows: np.ndarray, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> None:
        """Rank unrounded scores of `rows[at]` against references `ids` that come for the first time."""
        value = np.round(scores, PLACES)
        keep = value >= floor[at]
        at, named, value = at[keep], ids[keep], value[keep]
        if not len(at):
            return
        touched = np.unique(at)
        own = np.repeat(touched, self.k)
        row = np.concatenate([own, at])
        value = np.concatenate([self.scores[rows[touched]].ravel(), value])
        named = np.concatenate([self.ids[rows[touched]].ravel(), named])
        order = np.lexsort((named, -value, row))
        row, value, named = row[order], value[order], named[order]
        starts = np.searchsorted(row, touched)
        best = starts[:, None] + np.arange(self.k)  # every row has k of its own, so there are as many
        self.scores[rows[touched]], self.ids[rows[touched]] = value[best], named[best]


class _Group:
    """Sparse references (a slice of a table) that are met in one go. Every score has a bound, and only scores whose bound
    reaches a target's k-th best are worked out. The bound takes the coordinates of the largest weights one by one. The
    others lie in buckets, and of a bucket the target's largest number meets the sum of the reference's: never less than
    the sum of their products, and close to it, since a reference has few coordinates in a bucket."""

    def __init__(self, refs: pa.Table, dim: int):
        idx, val = refs.column("idx").combine_chunks(), refs.column("val").combine_chunks()
        self.dim, self.lengths = dim, np.diff(np.asarray(idx.offsets))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place, self.value = np.asarray(idx.flatten()), np.asarray(val.flatten())
        order = np.argsort(-np.bincount(self.place, self.value**2, minlength=dim), kind="stable")
        self.head, tail = order[:HEAD], order[HEAD:]
        self.buckets = max(1, min(BUCKETS, len(tail)))
        column = np.zeros(dim, np.int64)
        column[self.head] = np.arange(len(self.head))
        column[tail] = len(self.head) + np.arange(len(tail)) % self.buckets
        # whole rows of buckets: the last is filled up by coordinates of the same buckets
        missing = -len(tail) % self.buckets
        self.tail = np.append(tail, tail[len(tail) - self.buckets:][:missing])
        width, own = len(self.head) + self.buckets, column[self.place]
        sums = np.bincount(np.repeat(np.arange(len(self)), self.lengths) * width + own,
                           np.where(own < len(self.head), self.value, np.abs(self.value)), minlength=len(self) * width)
        self.block = sums.reshape(len(self), width).astype(np.float32)
        self.longest = float(np.linalg.norm(self.block, axis=1).max(initial=0))

    def __len__(self) -> int:
        return len(self.lengths)

    def bounds(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No score is above [target, reference] by more than the target's number beside it, the most that single
        precision can be off."""
        rest = np.abs(targets[:, self.tail]).reshape(len(targets), -1, self.buckets).max(axis=1, initial=0)
        left = np.concatenate([targets[:, self.head], rest], axis=1).astype(np.float32)
        off = (left.shape[1] + 4) * np.finfo(np.float32).eps * np.linalg.norm(left, axis=1) * self.longest
        return left @ self.block.T, off

    def scores(self, targets: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Scores of pairs, not so many that their coordinates take more than a block."""
        out = np.zeros(len(row))
        step = max(1, BLOCK_BYTES // (32 * max(1, int(self.lengths.max(initial=0)))))
        for at in range(0, len(row), step):
            r, c = row[at:at + step], col[at:at + step]
            n = self.lengths[c]
            entry = np.repeat(self.starts[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            products = targets[np.repeat(r, n), self.place[entry]] * self.value[entry]
            out[at:at + step] = np.bincount(np.repeat(np.arange(len(r)), n), products, minlength=len(r))
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.dim))
        out[np.repeat(np.arange(len(self)), self.lengths), self.place] = self.value
        return out

    def meet(self, targets: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: _Best) -> None:
        """Tell `best` of these targets (its `rows`) what can be among their best."""
        upper, off = self.bounds(targets)
        # the references of the highest bounds first: what they give rules out others
        k = min(best.k, len(self))
        likely = upper.argmax(axis=1)[:, None] if k == 1 else np.argpartition(upper, len(self) - k, axis=1)[:, len(self) - k:]
        row = np.repeat(np.arange(len(rows)), k)
        best.merge(rows, row, self.scores(targets, row, likely.ravel()), ids[likely.ravel()], best.floor()[rows])
        upper[row, likely.ravel()] = -np.inf
        floor = best.floor()[rows]
        open_ = upper >= np.nextafter((floor - SLACK - off).astype(np.float32), np.float32(-np.inf))[:, None]
        open_[row, likely.ravel()] = False
        many = np.flatnonzero(np.count_nonzero(open_, axis=1) > len(self) // 8)
        if len(many):  # equal references, or targets that know few of the coordinates: all scores of these targets
            best.add(rows[many], np.where(open_[many], targets[many] @ self.dense().T, -np.inf), ids)
            open_[many] = False
        at, col = np.divmod(np.flatnonzero(open_), len(self))
        best.merge(rows, at, self.scores(targets, at, col), ids[col], floor)


class _Tile:
    """References of a tile, by cell and id."""

    def __init__(self, refs: pa.Table, bounds: Bounds, dim: int):
        order = np.lexsort((np.asarray(refs["id"]), np.asarray(refs["cell"])))
        self.ids, cells = np.asarray(refs["id"])[order], np.asarray(refs["cell"])[order]
        self.names, starts = np.unique(cells, return_index=True)
        self.starts, self.ends, self.bounds = starts.tolist(), [*starts[1:].tolist(), len(cells)], bounds
        self.dense, self.groups = None, []
        if bounds.width >= dim:
            self.dense = _dense(refs, dim)[order]
            return
        first = 0
        for c, end in enumerate(self.ends):  # cells side by side; a large cell is a group of its own
            if c + 1 == len(self.ends) or self.ends[c + 1] - self.starts[first] > GROUP_ROWS:
                self.groups.append((first, c + 1, [
                    (at, _Group(refs.take(pa.array(order[at:min(at + GROUP_ROWS, end)])), dim))
                    for at in range(self.starts[first], end, GROUP_ROWS)]))
                first = c + 1


def _meet(targets: np.ndarray, best: _Best, tile: _Tile) -> int:
    """Tell `best` of the references of a tile; the number of scores worked out or bounded one by one."""
    spent = 0
    reach = tile.bounds.of(targets, tile.names)
    if tile.dense is None:
        # the most promising groups first
        for a, b, parts in sorted(tile.groups, key=lambda g: -reach[:, g[0]:g[1]].max()):
            rows = np.flatnonzero((reach[:, a:b].max(axis=1) >= best.floor() - SLACK) & (reach[:, a:b].max(axis=1) > -np.inf))
            if len(rows):
                some = targets if len(rows) == len(targets) else targets[rows]
                for at, group in parts:
                    group.meet(some, rows, tile.ids[at:at + len(group)], best)
                    spent += len(rows) * len(group)
        return spent

    def visit(c: int, rows: np.ndarray) -> int:
        some, a, b = targets if len(rows) == len(targets) else targets[rows], tile.starts[c], tile.ends[c]
        best.add(rows, some @ tile.dense[a:b].T, tile.ids[a:b])
        reach[rows, c] = -np.inf
        return len(rows) * (b - a)

    # the most promising cells first: what they give rules out others
    likely = reach.argmax(axis=1)
    for pick in (likely, None):
        for c in np.argsort(-reach.max(axis=0), kind="stable"):
            open_ = (reach[:, c] >= best.floor() - SLACK) & (reach[:, c] > -np.inf)
            rows = np.flatnonzero(open_ if pick is None else open_ & (pick == c))
            if len(rows):
                spent += visit(c, rows)
    return spent


def _search(left: DataFrame, index: VectorIndex, k: int, threshold: float | None, block_rows: int,
            cost: SearchCost | None) -> DataFrame:
    """Candidates (_row, reference_id, score) that hold the best k of each target."""
    first, parts = index.bounds.tiles(block_rows)
    n_tiles = int((first + parts).max())
    told = left.sparkSession.sparkContext.broadcast(index.bounds)
    dim, base = index.dim, "id long, _row long, idx array<int>, val array<double>"
    names = ["id", "_row", "idx", "val"]

    def first_tiles(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                near = _dense(part, dim) @ told.value.centres.T
                near[:, told.value.sizes == 0] = -np.inf
                tiles = first[near.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[t] for t in tiles], pa.list_(pa.int32()))],
                                                 [*names, "tiles"])

    def tiles_in_reach(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                floor = np.asarray(part.column("floor").fill_null(-np.inf))
                if threshold is not None:
                    floor = np.maximum(floor, threshold)
                open_ = told.value.of(_dense(part, dim)) >= floor[:, None] - SLACK
                open_ &= told.value.sizes > 0
                seen = part.column("seen").to_pylist()
                tiles = [sorted({t for c in np.flatnonzero(row) for t in range(first[c], first[c] + parts[c])} - {own})
                         for row, own in zip(open_, seen)]
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(tiles, pa.list_(pa.int32())),
                                                  pa.array(floor)], [*names, "tiles", "floor"])

    if index.bounds.width < dim:  # bounds of cells rule out next to nothing here: every target meets every tile
        return _counted(_cross(left, index, told, first, parts, k, threshold, block_rows), left, index, cost)
    if n_tiles == 1:  # every target meets the one tile
        started = left.withColumns({"tiles": F.array(F.lit(0)), "floor": F.lit(float("-inf"))})
        found = _visit(started, index, told, first, parts, k, threshold, block_rows)
        return _counted(found, left, index, cost)
    started = settle(left.mapInArrow(first_tiles, f"{base}, tiles array<int>"), "visits")
    found = settle(_visit(started.withColumn("floor", F.lit(float("-inf"))), index, told, first, parts, k, threshold,
                          block_rows), "found")
    ranks = top_per_group(found.where("reference_id IS NOT NULL"), ["_row"], [F.col("score").desc(), F.col("reference_id")],
                          k, ["reference_id"])
    floors = ranks.where(F.col("rank") == k).select("_row", F.col("score").alias("floor"))
    waiting = started.join(floors, "_row", "left").select(*names, F.get("tiles", F.lit(0)).alias("seen"), "floor")
    rest = settle(waiting.mapInArrow(tiles_in_reach, f"{base}, tiles array<int>, floor double"), "visits")
    more = _visit(rest, index, told, first, parts, k, threshold, block_rows)
    return _counted(found.unionByName(more), left, index, cost)


def _counted(found: DataFrame, left: DataFrame, index: VectorIndex, cost: SearchCost | None) -> DataFrame:
    if cost is not None:
        found = settle(found, "found")
        cost.scores += found.agg(F.sum("spent")).first()[0] or 0
        cost.all_scores += left.count() * int(index.bounds.sizes.sum())
    return found.where("reference_id IS NOT NULL").drop("spent")


def _visit(visits: DataFrame, index: VectorIndex, told, first: np.ndarray, parts: np.ndarray, k: int,
           threshold: float | None, block_rows: int) -> DataFrame:
    """Best k of each visited tile for each target (its tiles, and the score to reach). A tile with many visitors is met
    in several buckets of bounded size, so neither a common kind of target nor a hot cell sits in one task."""
    n_tiles, dim = int((first + parts).max()), index.dim
    calls = visits.withColumn("tile", F.explode("tiles")).drop("tiles")
    callers = np.zeros(n_tiles, np.int64)
    for r in calls.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a tile
        callers[r["tile"]] = r["n"]
    least = _tasks(visits.sparkSession) // max(1, int((callers > 0).sum()))
    asked = np.flatnonzero(callers).tolist()
    buckets = {t: max(1, min(least, int(callers[t])), math.ceil(callers[t] / block_rows)) for t in asked}
    sizes = visits.sparkSession.createDataFrame(sorted(buckets.items()), "tile int, buckets int")
    cells = visits.sparkSession.createDataFrame(
        [(c, int(a), int(n)) for c, (a, n) in enumerate(zip(first, parts))], "cell int, first int, parts int")
    left = calls.join(F.broadcast(sizes), "tile").withColumn(
        "bucket", F.pmod(F.xxhash64("_row"), F.col("buckets")).cast("int")).drop("buckets")
    # both tables have a row a cell or tile, so their size is bounded by the cells told to all tasks anyway, and by the
    # parts of cells larger than a tile
    needed = [c for c in range(len(first)) if any(t in buckets for t in range(first[c], first[c] + parts[c]))]
    members = index.rows.where(F.col("cell").isin(needed)).select("id", "idx", "val", "cell")
    right = members.join(F.broadcast(cells), "cell").withColumn(
        "tile", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(
        F.broadcast(sizes), "tile").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).select(
        "tile", "bucket", "cell", "id", "idx", "val")

    def meet(t: pa.Table, r: pa.Table) -> pa.Table:
        out = [], [], [], []
        if t.num_rows and r.num_rows:
            tile, spent = _Tile(r, told.value, dim), 0
            del r
            for at in range(0, t.num_rows, CHUNK_ROWS):
                part = t.slice(at, CHUNK_ROWS)
                floor = np.asarray(part["floor"])
                if threshold is not None:
                    floor = np.maximum(floor, threshold)
                best = _Best(part.num_rows, k, floor)
                spent += _meet(_dense(part, dim), best, tile)
                rows, cols = np.nonzero(best.scores > -np.inf if threshold is None else best.scores >= threshold)
                for to, x in zip(out, (np.asarray(part["_row"])[rows], best.ids[rows, cols], best.scores[rows, cols])):
                    to.append(x)
            n = sum(map(len, out[0]))
            return pa.table({"_row": pa.array(np.append(np.concatenate(out[0]), -1)),
                             "reference_id": pa.array([*np.concatenate(out[1]).tolist(), None], pa.int64()),
                             "score": pa.array(np.append(np.concatenate(out[2]), 0.0)),
                             "spent": pa.array([None] * n + [spent], pa.int64())})
        return pa.table({c: pa.array([], x) for c, x in zip(("_row", "reference_id", "score", "spent"), (
            pa.int64(), pa.int64(), pa.float64(), pa.int64()))})

    return left.groupBy("tile", "bucket").cogroup(right.groupBy("tile", "bucket")).applyInArrow(meet, FOUND)


def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _cross(left: DataFrame, index: VectorIndex, told, first: np.ndarray, parts: np.ndarray, k: int, threshold: float | None,
           block_rows: int) -> DataFrame:
    """Best k of every tile for each target, without a copy of the targets for each tile. Targets lie in blocks, references
    in tiles, one row each, and a cross join takes blocks through a few tiles at a time: both sides are read again as often as
    needed, and what is written stays that of one copy of either."""
    spark, dim, n_tiles = left.sparkSession, index.dim, int((first + parts).max())
    blocks = max(1, math.ceil(left.count() / block_rows), _tasks(spark))
    cells = spark.createDataFrame([(c, int(a), int(n)) for c, (a, n) in enumerate(zip(first, parts))],
                                  "cell int, first int, parts int")  # a row a cell, as told to all tasks anyway

    def pack_targets(batches):
        held = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        for at in range(0, rows.num_rows if held else 0, 2 * block_rows):  # one block, or a few if rows came unevenly
            part = rows.slice(at, 2 * block_rows)
            yield pa.RecordBatch.from_arrays([part["_row"].combine_chunks()[:1], pa.array([_packed(part)], pa.binary())],
                                             ["block", "targets"])

    def pack_tile(refs: pa.Table) -> pa.Table:
        return pa.table({"refs": pa.array([_packed(refs)], pa.binary())})

    packed = left.select("_row", "idx", "val").repartition(blocks).mapInArrow(pack_targets, "block long, targets binary")
    tiles = index.rows.join(F.broadcast(cells), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("tile"), "cell", "id", "idx", "val"
    ).groupBy("tile").applyInArrow(pack_tile, "refs binary").repartition(math.ceil(n_tiles / TILES))

    def meet(batches):
        block, targets, best, spent = None, None, [], 0

        def done():
            rows, ids, scores = [], [], []
            for at, b in enumerate(best):
                r, c = np.nonzero(b.scores > -np.inf if threshold is None else b.scores >= threshold)
                rows.append(np.asarray(targets["_row"][at * CHUNK_ROWS:(at + 1) * CHUNK_ROWS])[r])
                ids.append(b.ids[r, c])
                scores.append(b.scores[r, c])
            n = sum(map(len, rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.concatenate(rows), -1), pa.int64()), pa.array([*np.concatenate(ids).tolist(), None], pa.int64()),
                 pa.array(np.append(np.concatenate(scores), 0.0)), pa.array([None] * n + [spent], pa.int64())],
                ["_row", "reference_id", "score", "spent"])

        for batch in batches:
            for own, held, refs in zip(batch.column("block").to_pylist(), batch.column("targets"), batch.column("refs")):
                if own != block:
                    if best:
                        yield done()
                    block, targets, spent = own, _unpacked(held), 0
                    best = [_Best(min(CHUNK_ROWS, targets.num_rows - at), k, np.full(
                        min(CHUNK_ROWS, targets.num_rows - at), -np.inf if threshold is None else threshold))
                        for at in range(0, targets.num_rows, CHUNK_ROWS)]
                tile = _Tile(_unpacked(refs), told.value, dim)
                for at, b in enumerate(best):
                    spent += _meet(_dense(targets.slice(at * CHUNK_ROWS, CHUNK_ROWS), dim), b, tile)
        if best:
            yield done()

    return packed.crossJoin(tiles.hint("shuffle_replicate_nl")).mapInArrow(meet, FOUND)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_as_sparse(df: DataFrame, id_: str, vector: Column, dim: int) -> DataFrame:
    """id, idx, val columns of a fixed-width vector."""
    return df.select(F.col(id_).cast("long").alias("id"),
                     F.sequence(F.lit(0), F.lit(dim - 1)).alias("idx"),
                     vx.l2_normalise(vx.fit_dim(vector, dim)).alias("val"))


def vector_topk(queries: DataFrame, index: DataFrame | VectorIndex, id_: str, vector: str, dim: int = 64,
                k: int = 5, threshold: float | None = None, **sizes) -> DataFrame:
    """Top k index rows per query by cosine, at or over a threshold. A stored index is searched as it is."""
    if isinstance(index, DataFrame):
        index = dense_as_sparse(index, id_, F.col(vector), dim)
    return nearest(dense_as_sparse(queries, id_, F.col(vector), dim), index, dim, k, threshold, **sizes)


def _hybrid_base(df: DataFrame, id_: str, code: str, vector: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    v = vx.token_vector64(F.col(code)) if vector is None else vx.l2_normalise(vx.fit_dim(vector, 64))
    return df.select(F.col(id_).cast("long").alias("id"), word_grams(F.col(code)).alias("grams"), v.alias("vec"), *carry)


def _hybrid_rows(base: DataFrame, weights: TermWeights, carry: tuple[str, ...] = ()) -> DataFrame:
    wv, wt = math.sqrt(L.VECTOR_WEIGHT), math.sqrt(L.TEXT_WEIGHT)
    return weights.sparse(base).select(
        "id",
        F.concat(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("vec", i) != 0),
                 F.transform("idx", lambda i: i + 64)).alias("idx"),
        F.concat(F.transform(F.filter("vec", lambda x: x != 0), lambda x: x * wv),
                 F.transform("val", lambda x: x * wt)).alias("val"), *carry)


def hybrid_features(df: DataFrame, id_: str, code: str, weights: TermWeights,
                    vector: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One sparse row per snippet whose dot product is the weighted sum of both cosines."""
    return _hybrid_rows(_hybrid_base(df, id_, code, vector, carry), weights, carry)


def hybrid_index(references: DataFrame, ref_id: str, ref_code: str, weights: TermWeights | None = None,
                 **sizes) -> tuple[VectorIndex, TermWeights]:
    """References in cells, bounded apart for the vector and the term part of the score, and the term weights, which are
    fitted on the references unless given. Their grams are taken once and written."""
    base = settle(_hybrid_base(references, ref_id, ref_code), "references")
    if weights is None:
        weights = TermWeights.fit(base.select("grams"))
    return VectorIndex.build(_hybrid_rows(base, weights), 64 + len(weights.terms), 64, settled=True, **sizes), weights


def hybrid_top1(targets: DataFrame, references: DataFrame | VectorIndex, id_: str, ref_id: str, code: str,
                ref_code: str, weights: TermWeights | None = None, carry: tuple[str, ...] = (),
                **sizes) -> DataFrame:
    """Best reference per target by 0.4 vector cosine + 0.6 term cosine, exact. An index comes with its weights."""
    if isinstance(references, DataFrame):
        references, weights = hybrid_index(references, ref_id, ref_code, weights)
    if not references.bounds.sizes.any() and not {"k", "threshold"} & sizes.keys():  # nothing to meet: no features needed
        return targets.select(F.col(id_).cast("long").alias("target_id"), F.lit(None).cast("long").alias("reference_id"),
                              F.lit(0.0).alias("score"), *carry)
    return nearest(hybrid_features(targets, id_, code, weights, carry=carry), references, references.dim, carry=carry, **sizes)


def gate(scored: DataFrame, scan: str | None = None, threshold: float = L.GATE_THRESHOLD,
         small_scans: bool = True, direct: Column | None = None) -> DataFrame:
    """Verdict and saved cost per method from an unrounded `score`. Small scans and pasted
    snippets go to verification whatever their score."""
    forced = direct if direct is not None else F.lit(False)
    if scan is not None and small_scans:
        scored = with_group_count(scored, [scan], "_methods")
        forced = forced | (F.col("_methods") <= L.SMALL_SCAN_METHODS)
    over = F.col("score") >= threshold
    verdict = (F.when(F.col("_forced"), "SNIPPET VERIFICATION")
               .when(over, f"SUSPICIOUS (>={threshold})").otherwise(f"CLEAN (<{threshold})"))
    return (scored.withColumn("_forced", forced)
            .withColumn("suspicious", F.col("_forced") | over)
            .withColumn("verdict", verdict)
            .withColumn("verify_score", F.when(
                F.col("_forced"), F.greatest("score", F.lit(L.SMALL_SCAN_SCORE)))
                .otherwise(F.col("score")))
            .withColumn("cost_saved", fx.cost_saved(F.col("suspicious")))
            .drop("_forced", "_methods"))


def pair_similarity(pairs: DataFrame, before: str, after: str, guard: float = 1e-9) -> DataFrame:
    """Cosine of the two vectors of each pair."""
    return pairs.withColumn("similarity", vx.cosine(F.col(before), F.col(after), guard))
