import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.operators import models
from patchlens.sources.sinks import tall_metrics


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        y = i % 3
        x = rng.normal(size=6) * 0.3
        x[y] += 2
        rows.append((i, f"t{y}", ["low", "high"][y % 2], x.tolist(), (x + 0.1 * y).tolist(), f"word{y} common {i % 7}",
                     int(y > 0), i % 40))
    return spark.createDataFrame(rows, "pair_id long, bug_type string, severity string, buggy_vector array<double>, "
                                       "fixed_vector array<double>, text string, y int, g long").cache()


def test_type_model_learns_and_predicts(spark, points):
    t = models.train_type_model(points, trees=8, rounds=2, depth=4, iterations=15, terms=20)
    scores = {r["model"]: r["accuracy"] for r in t.results.collect()}
    assert set(scores) == {"forest", "boosted", "mlp"} and max(scores.values()) > 0.9
    assert t.best() in scores and tall_metrics(t.results).where("metric = 'accuracy'").count() == 3


def test_dual_and_pair_order(spark, points):
    out = models.train_dual(points, "g", trees=8, depth=4, iterations=10)
    assert {k: v.results.count() for k, v in out.items()} == {"bug_type": 3, "severity": 3}
    order = models.train_pair_order(points, "pair_id", "buggy_vector", "fixed_vector", 5, 4, 20)
    assert order.results.count() == 2


def test_binary_reports_fold_scores(spark, points):
    trained, folds = models.train_binary(points, "g", "y", {"vector": ["buggy_vector"]}, 3, 5, 2, 4, 10)
    assert folds.count() == 5 and trained.results.count() == 5
    assert folds.agg(F.max("mean")).first()[0] > 0.9


def test_soft_vote_and_prediction_rows(spark, points):
    v = spark.createDataFrame([([0.2, 0.8], [0.6, 0.4])], "a array<double>, b array<double>")
    assert models.soft_vote(v, "a", "b").first()["prediction"] == 1.0
    rows, classes = models.index_labels(models.with_features(points, "buggy_vector"), "bug_type")
    model = models.fit_forest(rows, 8, 4, weight=None)
    got = models.predict_batch(model, points.select("pair_id", F.col("buggy_vector").alias("v")), classes, "v",
                               ["pair_id"], pair_model=False)
    assert got.count() == 240 * 3 and set(got.columns) >= {"rank", "bug_type", "probability", "description", "suggested_fix"}


def test_text_weights_come_from_the_training_side(spark, points):
    train, test = points.where("pair_id < 200"), points.where("pair_id >= 200").withColumn("text", F.lit("unseen"))
    a, b, w = models._term_features(train, test, "text", 50, True)
    assert "unseen" not in w.terms and b.agg(F.max(F.array_max("terms"))).first()[0] == 0.0


def _accuracy(model, test):
    return model.transform(test).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


@pytest.mark.parametrize("name,fit", [
    ("logistic", lambda d: models.fit_linear(d, "logistic", None, 20)), ("svm", lambda d: models.fit_linear(d, "svm", None, 10)),
    ("sgd", lambda d: models.fit_linear(d, "sgd", None, 4)), ("mlp", lambda d: models.fit_mlp(d, 6, 3, 40)),
    ("extra trees", lambda d: models.fit_forest(d, 8, 4, True, None)), ("boosted", lambda d: models.fit_boosted(d, 3, 3, 2, None))])
def test_each_classifier_learns(spark, points, name, fit):
    rows, classes = models.index_labels(models.with_features(points, "buggy_vector"), "bug_type")
    assert classes == ["t0", "t1", "t2"]
    model = fit(rows.where("pair_id < 160").select("label", "features"))
    assert _accuracy(model, rows.where("pair_id >= 160")) > 0.9, name


def test_two_classes_and_bayes(spark, points):
    rows = models.with_features(points.withColumn("v", F.transform("buggy_vector", lambda x: F.greatest(x, F.lit(0.0)))), "v")
    rows = rows.withColumn("label", F.col("y").cast("double"))
    train, test = (rows.where(c).select("label", "features") for c in ("pair_id < 160", "pair_id >= 160"))
    assert _accuracy(models.fit_boosted(train, 2, 3, 2, None), test) > 0.9
    assert _accuracy(models.fit_nb(train, None), test) > 0.9


def test_hybrid_families(spark, points):
    t = models.train_hybrid(points, "pair_id", "bug_type", "text", "buggy_vector", terms=10, trees=4, depth=3, iterations=5,
                            margin=False)
    scores = {r["model"]: r["accuracy"] for r in t.results.collect()}
    assert set(scores) == {"text_logistic", "text_forest", "text_bayes", "vector_logistic", "vector_forest", "both_logistic",
                           "both_forest"}
    assert min(scores[f] for f in ("text_logistic", "vector_logistic", "both_logistic")) > 0.9


def test_passes_of_a_fit_have_as_many_tasks_as_the_rows_fill(spark, points):
    rows = models.with_features(points, "buggy_vector").withColumn("label", F.col("y").cast("double")).repartition(40)
    packed = models.packed(rows.select("label", "features"))
    assert packed.rdd.getNumPartitions() == 1 and packed.count() == points.count()
    packed.unpersist()
    tracker, group = spark.sparkContext.statusTracker(), "one fit"
    spark.sparkContext.setJobGroup(group, group)
    model = models.fit_linear(rows, "logistic", None, iterations=15)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the 40 partitions are read when the rows are measured and dealt, not in each of some 15 passes
    assert 0 < sum(s.numCompletedTasks for s in stages if s) < 250
    assert model.numClasses == 2


def test_binary_gives_fold_and_holdout_scores_of_every_model(spark, points):
    trained, scores = models.train_binary(points, "g", "y", {"vector": ["buggy_vector"]}, 2, 4, 2, 3, 8)
    held_out = {r["model"]: r["accuracy"] for r in trained.results.collect()}
    rows = {r["model"]: r for r in scores.collect()}
    assert set(rows) == set(held_out) and len(rows) == 5
    assert all(r["holdout_accuracy"] == held_out[m] and 0.9 < r["mean_auc"] <= 1 and 0.9 < r["holdout_auc"] <= 1
               for m, r in rows.items())


def test_binary_query_takes_three_feature_sets_and_every_labelled_text(spark, folder, monkeypatch):
    import __spark_entry__ as entry
    called = []
    monkeypatch.setattr(models, "train_binary", lambda *a, **k: called.append(a) or (None, a[0]))
    samples = entry.queries()["train_binary"](spark, folder)
    assert {k: len(v) for k, v in called[0][3].items()} == {"tokens": 1, "vector": 1, "both": 2}
    assert samples.count() == spark.read.parquet(f"{folder}/labels.parquet").count()
    assert samples.where("size(tokens) <> 64 OR size(embedding) <> 64").count() == 0


def test_hybrid_query_trains_with_the_full_settings(spark, folder, monkeypatch):
    import inspect

    import __spark_entry__ as entry
    called = []
    signature = inspect.signature(models.train_hybrid)
    given = spark.createDataFrame([("m", 0, 1.0)], "model string, position int, accuracy double")
    monkeypatch.setattr(models, "train_hybrid", lambda *a, **k: called.append(signature.bind(*a, **k)) or models.Trained(results=given))
    entry.queries()["train_hybrid"](spark, folder)
    # terms, trees, depth and iterations are those of the operator
    assert set(called[0].arguments) == {"samples", "key", "label", "text", "vector"}
