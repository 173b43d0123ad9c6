"""Tree ensembles against small brute-force versions."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from patchlens.operators import descent, trees


def points(seed=2, n=300, width=5, classes=4):
    rng = np.random.default_rng(seed)
    y = rng.integers(classes, size=n)
    x = np.round(rng.normal(size=(n, width)) * 0.8, 2)
    x[np.arange(n), y] += 1.5
    return x, y, rng.choice([0.5, 1.0, 2.0], size=n)


def frame(spark, x, y, w, parts=3):
    df = spark.createDataFrame([(float(b), float(c), a.tolist()) for a, b, c in zip(x, y, w)],
                               "label double, weight double, f array<double>")
    return df.select("label", "weight", array_to_vector("f").alias("features")).repartition(parts)


def brute_boosting(x, y, w, classes, rounds, depth, rate, edges):
    """The same trees by plain recursion over rows."""
    bins = trees.binned(x, edges)
    margins = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = trees.softmax(margins)
        step = np.zeros_like(margins)
        for k in range(classes):
            g, h = (p[:, k] - (y == k)) * w, np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * w

            def grow(rows, level):
                a, b = g[rows].sum(), h[rows].sum()
                best, split = a**2 / (b + trees.LAMBDA) + 1e-9, None
                for f in range(x.shape[1]):
                    for cut in range(trees.BINS - 1):
                        left = rows[bins[rows, f] <= cut]
                        right = rows[bins[rows, f] > cut]
                        if min(h[left].sum(), h[right].sum()) < trees.LEAST_CURVATURE:
                            continue
                        worth = round(sum(g[s].sum()**2 / (h[s].sum() + trees.LAMBDA) for s in (left, right)), 9)
                        if worth > best:
                            best, split = worth, (left, right)
                if split is None or level == depth:
                    step[rows, k] = -rate * a / (b + trees.LAMBDA)
                else:
                    grow(split[0], level + 1)
                    grow(split[1], level + 1)

            grow(np.arange(len(x)), 0)
        margins += step
    return margins


def test_softmax_boosting_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trees, "FOLD", 2)
    x, y, w = points(n=120, width=3, classes=3)
    model = trees.fit_softmax_boosting(frame(spark, x, y, w), 3, rounds=3, depth=2, rate=0.3)
    want = brute_boosting(x, y, w, 3, 3, 2, 0.3, model.edges)
    np.testing.assert_allclose(model.scores(x), want, atol=1e-9)


def test_boosting_has_chances_and_learns(spark):
    x, y, w = points()
    df = frame(spark, x, y, w)
    model = trees.fit_softmax_boosting(df, 4, rounds=8, depth=3)
    got = model.transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and r["prediction"] == int(np.argmax(r["p"])) for r in got)
    assert np.mean([r["label"] == r["prediction"] for r in got]) > 0.8
    assert len(model.trees) == 32


def brute_extra(x, y, w, classes, n_trees, depth, seed, edges, m):
    """Class shares by growing each tree over rows with the same draws."""
    bins, width, out = trees.binned(x, edges), x.shape[1], np.zeros((len(x), classes))
    for t in range(n_trees):
        made, todo, at = 1, [(0, np.arange(len(x)))], {}
        for _ in range(depth + 1):
            later = []
            for node, rows in sorted(todo, key=lambda z: z[0]):
                counts = np.bincount(y[rows], w[rows], classes)
                at.update({r: counts / counts.sum() for r in rows})
                if np.count_nonzero(counts) < 2 or counts.sum() < 2 or _ == depth:
                    continue
                rng = np.random.default_rng([seed, t, node])
                mine = rng.choice(width, m, replace=False)
                top, split = (counts**2).sum() / counts.sum() + 1e-9, None
                for f in mine:
                    draw, b = rng.random(), bins[rows, f]
                    if b.min() == b.max():
                        continue
                    cut = trees.random_cut(edges[f], b.min(), b.max(), draw)
                    sides = rows[b <= cut], rows[b > cut]
                    worth = sum((np.bincount(y[s], w[s], classes)**2).sum() / w[s].sum() for s in sides)
                    if worth > top:
                        top, split = worth, sides
                if split:
                    later += [(made, split[0]), (made + 1, split[1])]
                    made += 2
            todo = later
        for r, share in at.items():
            out[r] += share
    return out / n_trees


def test_extra_trees_equal_brute_force(spark):
    x, y, w = points(n=150, width=4, classes=3)
    model = trees.fit_extra_trees(frame(spark, x, y, w), 3, trees=5, depth=4, seed=9)
    np.testing.assert_allclose(model.scores(x), brute_extra(x, y, w, 3, 5, 4, 9, model.edges, 2), atol=1e-9)


def test_extra_trees_are_seeded_and_unlike_each_other(spark, monkeypatch):
    x, y, w = points()
    df = frame(spark, x, y, w)
    one = trees.fit_extra_trees(df, 4, trees=12, depth=6, seed=1)
    monkeypatch.setattr(trees, "PASS_BYTES", 4000)  # many passes a level
    again = trees.fit_extra_trees(df.repartition(5), 4, trees=12, depth=6, seed=1)
    other = trees.fit_extra_trees(df, 4, trees=12, depth=6, seed=2)
    assert (one.scores(x) == again.scores(x)).all() and (one.scores(x) != other.scores(x)).any()
    assert len({tuple(t.feature) for t in one.trees}) > 1
    got = one.transform(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert got > 0.85


def test_fan_in_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(trees, "FAN_IN", 1)
    x, y, w = points(n=80, width=3, classes=3)
    model = trees.fit_softmax_boosting(frame(spark, x, y, w, 4), 3, rounds=1, depth=1)
    np.testing.assert_allclose(model.scores(x), brute_boosting(x, y, w, 3, 1, 1, 0.1, model.edges), atol=1e-9)


@pytest.mark.parametrize("fit", [lambda d: trees.fit_softmax_boosting(d, 3, 2, 2), lambda d: trees.fit_extra_trees(d, 3, 2, 3)])
def test_features_without_values(spark, fit):
    df = frame(spark, np.ones((6, 2)), np.array([0, 1, 2, 0, 1, 0]), np.ones(6))
    got = fit(df).transform(df).select("prediction", vector_to_array("probability").alias("p")).collect()
    assert all(r["prediction"] == 0.0 and abs(sum(r["p"]) - 1) < 1e-9 for r in got)


# stochastic descent


@pytest.mark.parametrize("shard_rows", [1000, 60])
def test_descent_equals_a_numpy_run_on_the_same_batches(spark, shard_rows):
    x, y, w = points(n=200, width=4, classes=3)
    df = frame(spark, x, y, w)
    model = descent.fit_sgd(df, 3, epochs=4, seed=5, shard_rows=shard_rows)
    shards = -(-200 // shard_rows)
    rows = df.select(F.col("label").cast("int").alias("label"), "weight", vector_to_array("features").alias("x")).withColumn(
        "at", F.xxhash64("label", "weight", "x")).withColumn("shard", F.pmod("at", F.lit(shards))).collect()
    weights, base = np.zeros((3, 5)), 2.0 / np.mean((x**2).sum(axis=1))
    for epoch in range(4):
        ends = []
        for s in range(shards):
            mine = sorted((r for r in rows if r["shard"] == s), key=lambda r: (r["at"], r["label"]))
            mx, my, mw = np.array([r["x"] for r in mine]), np.array([r["label"] for r in mine]), np.array([r["weight"] for r in mine])
            ends.append((len(mine), descent.walk(weights, mx, my, mw, descent.rate_at(epoch, base), 1e-4,
                                                 descent.steps_order(5, epoch, s, len(mine)))))
        weights = sum(n * e for n, e in ends) / sum(n for n, _ in ends)
    np.testing.assert_allclose(model.weights, weights, atol=1e-9)


def test_descent_learns(spark):
    x, y, w = points()
    df = frame(spark, x, y, w)
    got = descent.fit_sgd(df, 4).transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r["label"] == r["prediction"] for r in got]) > 0.75
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    assert descent.fit_sgd(df.where("label > 9"), 4).weights.any() == False  # noqa: E712
