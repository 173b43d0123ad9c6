"""Bounded retrieval against all pairs, and what it saves."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchlens.operators import retrieval
from patchlens.operators.retrieval import SearchCost, VectorIndex


def table(spark, rows):
    return spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(v)], [float(x) for x in v[np.flatnonzero(v)]])
                                  for i, v in rows], "id long, idx array<int>, val array<double>")


def clusters(seed, n, dim, spread, groups=12, sign=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))
    rows = rows if sign else np.maximum(rows, 0)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def brute(targets, refs, k, threshold=None):
    scores = np.round(targets @ refs.T, retrieval.PLACES)
    want = set()
    for i, row in enumerate(scores):
        for j in sorted(range(len(refs)), key=lambda j: (-row[j], j))[:k]:
            if threshold is None or row[j] >= threshold:
                want.add((i, j))
    return want


@pytest.mark.parametrize("k,threshold,split,sign,block_rows", [
    (1, None, 0, True, None), (1, None, 6, False, 70), (4, 0.3, 6, True, 70), (3, 0.9, 0, False, None)])
def test_bounded_search_is_exact_and_skips_cells(spark, k, threshold, split, sign, block_rows):
    refs, targets = clusters(1, 600, 24, 0.15, sign=sign), clusters(1, 90, 24, 0.2, sign=sign)
    refs[17] = refs[5]  # ties go to the smaller id
    targets[3] = refs[5]
    cost = SearchCost()
    got = retrieval.nearest(table(spark, enumerate(targets)), table(spark, enumerate(refs)), 24, k, threshold, split=split,
                            cell_rows=30, block_rows=block_rows, cost=cost)
    assert {(r["target_id"], r["reference_id"]) for r in got.collect()} == brute(targets, refs, k, threshold)
    assert cost.all_scores == 90 * 600 and 0 < cost.scores < cost.all_scores / 2


def test_nothing_is_lost_where_bounds_do_not_help(spark):
    rng = np.random.default_rng(4)
    refs, targets = rng.normal(size=(300, 10)), rng.normal(size=(40, 10))
    cost = SearchCost()
    got = retrieval.nearest(table(spark, enumerate(targets)), table(spark, enumerate(refs)), 10, 5, cell_rows=10,
                            block_rows=7, cost=cost)
    assert {(r["target_id"], r["reference_id"]) for r in got.collect()} == brute(targets, refs, 5)
    assert cost.scores <= cost.all_scores


def test_bounds_hold(spark):
    for seed, sign in ((1, True), (2, False)):
        refs, targets = clusters(seed, 400, 16, 0.4, sign=sign), clusters(seed + 9, 50, 16, 1.0, sign=True)
        index = VectorIndex.build(table(spark, enumerate(refs)), 16, 5, cell_rows=20)
        cell = {r["id"]: r["cell"] for r in index.rows.select("id", "cell").collect()}
        reach = index.bounds.of(targets)
        scores = targets @ refs.T
        assert all(scores[i, j] <= reach[i, cell[j]] + 1e-9 for i in range(50) for j in range(400))
        assert index.bounds.sizes.sum() == 400 and len(index.bounds.sizes) == 20


def test_more_cells_than_different_references(spark):
    refs = np.repeat(clusters(3, 3, 8, 0.5), 70, axis=0)  # one group holds a third of all rows
    targets = clusters(4, 10, 8, 0.5)
    got = retrieval.nearest(table(spark, enumerate(targets)), table(spark, enumerate(refs)), 8, 2, cell_rows=5, block_rows=9)
    assert {(r["target_id"], r["reference_id"]) for r in got.collect()} == brute(targets, refs, 2)


def test_stored_index_is_read(spark, tmp_path):
    refs, targets = clusters(6, 200, 12, 0.2), clusters(6, 30, 12, 0.2)
    VectorIndex.build(table(spark, enumerate(refs)), 12, 4, cell_rows=25).write(f"{tmp_path}/index")
    assert len(list((tmp_path / "index" / "rows").glob("cell=*"))) >= 6
    index = VectorIndex.read(spark, f"{tmp_path}/index")
    got = retrieval.nearest(table(spark, enumerate(targets)), index, 12)
    assert {(r["target_id"], r["reference_id"]) for r in got.collect()} == brute(targets, refs, 1)


def test_empty_sides(spark):
    refs = table(spark, enumerate(clusters(1, 5, 6, 0.2)))
    none = refs.where("id < 0")
    assert [(r["reference_id"], r["score"]) for r in retrieval.nearest(refs, none, 6).collect()] == [(None, 0.0)] * 5
    assert retrieval.nearest(none, refs, 6).count() == 0 and retrieval.nearest(refs, none, 6, 3).count() == 0
    zero = spark.createDataFrame([(1, [], [])], "id long, idx array<int>, val array<double>")
    assert retrieval.nearest(zero, refs, 6).first()["score"] == 0.0


def test_without_references_no_features_are_made(spark):
    targets = spark.createDataFrame([(1, "a b"), (2, None)], "id long, code string").withColumn("mark", F.col("id") * 2)
    none = spark.createDataFrame([], "rid long, ref string")
    best = retrieval.hybrid_top1(targets, none, "id", "rid", "code", "ref", carry=("mark",))
    assert sorted(map(tuple, best.collect())) == [(1, None, 0.0, 2), (2, None, 0.0, 4)]
    assert best.inputFiles() == []  # no table of features was written


@pytest.mark.parametrize("k,threshold", [(1, None), (3, 0.1)])
def test_sparse_references_are_held_sparse_and_met_exactly(spark, k, threshold, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_ROWS", 70)
    rng = np.random.default_rng(2)
    refs, targets = np.zeros((400, 900)), np.zeros((60, 900))
    for rows, n in ((refs, 12), (targets, 40)):
        for row in rows:
            row[np.unique(rng.integers(0, 900, n) * rng.random(n)).astype(int)] = rng.random()
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    refs[31] = refs[8]  # ties go to the smaller id

    def sparse(rows):
        return spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(rows)],
                                     "id long, idx array<int>, val array<double>")

    index = VectorIndex.build(sparse(refs), 900, 0)
    assert index.bounds.width < 300  # numbers held of a reference: not one for each coordinate
    for sizes in ({}, {"block_rows": 90}):
        got = retrieval.nearest(sparse(targets), index, 900, k, threshold, **sizes).collect()
        assert {(r["target_id"], r["reference_id"]) for r in got} == brute(targets, refs, k, threshold)


def test_full_rows_are_not_copied():
    values = pa.array(np.arange(6.0))
    batch = pa.table({"idx": pa.ListArray.from_arrays([0, 3, 6], pa.array([0, 1, 2, 0, 1, 2], pa.int32())),
                      "val": pa.ListArray.from_arrays([0, 3, 6], values)}).to_batches()[0]
    dense = retrieval._dense(batch, 3)
    assert dense.tolist() == [[0, 1, 2], [3, 4, 5]] and np.shares_memory(dense, np.asarray(values))


def test_best_ranks_only_what_can_still_win():
    best = retrieval._Best(2, 2, np.array([-np.inf, 0.5]))
    best.add(np.array([0, 1]), np.array([[0.1, 0.7, 0.7, 0.2], [0.4, 0.5, 0.1, 0.2]]), np.array([4, 5, 6, 7]))
    best.add(np.array([0]), np.array([[0.7]]), np.array([1]))
    assert best.ids[0].tolist() == [1, 5] and best.scores[1].tolist() == [0.5, -np.inf]


def sparse_rows(rng, n, dim, most, signed=False):
    rows = np.zeros((n, dim))
    for row in rows:
        at = np.unique((rng.integers(0, dim, most) * rng.random(most)).astype(int))
        row[at] = rng.normal(size=len(at)) if signed else rng.random(len(at))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("signed", [False, True])
def test_no_sparse_score_is_above_its_bound(signed):
    rng = np.random.default_rng(8)
    refs, targets = sparse_rows(rng, 200, 901, 12, signed), sparse_rows(rng, 50, 901, 60, signed)
    table = pa.table({"idx": pa.array([np.flatnonzero(r).tolist() for r in refs], pa.list_(pa.int32())),
                      "val": pa.array([r[r != 0].tolist() for r in refs])})
    group, exact = retrieval._Group(table, 901), targets @ refs.T
    upper, off = group.bounds(targets)
    assert (exact <= upper + off[:, None]).all() and np.median(upper - exact) < 0.3
    row, col = np.nonzero(exact > -np.inf)
    assert np.allclose(group.scores(targets, row, col).reshape(exact.shape), exact) and np.allclose(group.dense(), refs)


@pytest.mark.parametrize("k", [1, 3])
def test_sparse_targets_are_not_copied_for_each_tile(spark, k):
    rng = np.random.default_rng(9)
    refs, targets = sparse_rows(rng, 300, 900, 12), sparse_rows(rng, 40, 900, 40)
    refs[100:200] = refs[7]  # many equal ones: the smallest ids win
    got = retrieval.nearest(table(spark, enumerate(targets)), table(spark, enumerate(refs)), 900, k, block_rows=40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # no row a target and tile
    assert {(r["target_id"], r["reference_id"]) for r in got.collect()} == brute(targets, refs, k)
