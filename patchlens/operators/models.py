"""Classifiers on Spark ML and the training jobs built from them."""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions import vectors as vx
from patchlens.functions.patterns import bind
from patchlens.operators import evaluate as ev
from patchlens.operators.descent import LinearScores, fit_sgd
from patchlens.operators.quality import drop_rare_classes
from patchlens.operators.report import class_balance, lookup_texts
from patchlens.operators.reshape import swap_pairs, top_predictions
from patchlens.operators.splits import group_kfold, group_split, stratified_split
from patchlens.operators.tfidf import TermWeights, word_grams
from patchlens.operators.trees import TreeEnsemble, fit_extra_trees, fit_softmax_boosting
from patchlens.session import discard, new_table_path, settle

PART_BYTES = 16 << 20  # of features in a partition of training rows
FITS = 8  # models fitted side by side: most of a fit on few rows is spent between its many short jobs


def with_features(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(vx.concat_features(*map(F.col, arrays))))


def plain(model: Model) -> Model:
    """The model without its training summary, by writing and loading it. The summary of a binary model
    holds the session, and tasks cannot be sent with it once the session has run a stream. Models of this
    library have no summary."""
    if not isinstance(model, Model):
        return model
    path = new_table_path(SparkSession.active(), "model")
    model.write().save(path)
    return type(model).load(path)


def packed(rows: DataFrame) -> DataFrame:
    """Training rows, cached in partitions that their features fill. Fitting passes over them many times, and each task of
    a pass sends a result to the driver; so the tasks follow the size of the rows, not files or shuffle partitions."""
    size = rows.select(F.size(vector_to_array("features")).alias("w")).agg(F.sum("w").cast("long").alias("n")).first()
    return rows.repartition(max(1, math.ceil(8 * (size["n"] or 0) / PART_BYTES))).cache()


def fit_linear(train: DataFrame, kind: str = "logistic", weight: str | None = "weight",
               iterations: int = 100) -> Model:
    """logistic, sgd (logistic by stochastic descent) or svm (one against the rest)."""
    if kind == "sgd":
        return fit_sgd(train, class_count(train), iterations, weight=weight)
    extra = {"weightCol": weight} if weight else {}
    if kind == "svm":
        estimator = OneVsRest(classifier=LinearSVC(maxIter=iterations, **extra), parallelism=4, **extra)
    else:
        estimator = LogisticRegression(maxIter=iterations, regParam=1e-2, **extra)
    rows = packed(train.select("label", "features", *extra.values()))
    model = plain(estimator.fit(rows))
    rows.unpersist()
    return model


def class_count(train: DataFrame) -> int:
    return int(train.agg(F.max("label")).first()[0] or 0) + 1


def fit_forest(train: DataFrame, trees: int = 200, depth: int = 20, extra_random: bool = False,
               weight: str | None = "weight", seed: int = 42) -> Model:
    """Random forest, or extremely random trees: all rows, random cuts."""
    if extra_random:
        return fit_extra_trees(train, class_count(train), trees, depth, weight, seed)
    extra = {"weightCol": weight} if weight else {}
    return plain(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **extra).fit(train))


def fit_boosted(train: DataFrame, classes: int, rounds: int = 100, depth: int = 5,
                weight: str | None = "weight", seed: int = 42) -> Model:
    """Gradient boosting; for more than two classes on the softmax loss, all classes in each round."""
    if classes > 2:
        return fit_softmax_boosting(train, classes, rounds, depth, weight=weight)
    extra = {"weightCol": weight} if weight else {}
    return plain(GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, **extra).fit(train))


def fit_mlp(train: DataFrame, width: int, classes: int, iterations: int = 100, seed: int = 42
            ) -> Model:
    return plain(MultilayerPerceptronClassifier(
        layers=[width, 128, 64, classes], maxIter=iterations, seed=seed).fit(train))


def fit_nb(train: DataFrame, weight: str | None = "weight") -> Model:
    """Complement naive Bayes; features must not be negative."""
    extra = {"weightCol": weight} if weight else {}
    return NaiveBayes(modelType="complement", **extra).fit(train)


def probabilities(model: Model, df: DataFrame, name: str = "probabilities") -> DataFrame:
    scored = model.transform(df)
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    made = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn(name, vector_to_array(source)).drop(
        *[c for c in made if c not in df.columns])


def soft_vote(df: DataFrame, *columns: str) -> DataFrame:
    """Mean of the models' probabilities and the first class with the largest mean."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = F.zip_with(total, F.col(c), lambda a, b: a + b)
    mean = F.transform(total, lambda x: x / len(columns))
    return df.withColumn("probabilities", mean).withColumn(
        "prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1)
        .cast("double"))


def score_row(model: Model, test: DataFrame, name: str, position: int) -> DataFrame:
    """accuracy, macro and weighted scores of one model as a row."""
    counts = settle(ev.confusion(model.transform(test), "label", "prediction"), "confusion")
    report = ev.report_of(counts)
    right = counts.agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
                        / F.sum("n")).alias("accuracy"))
    macro = report.where("class = 'macro avg'").select(
        F.col("precision").alias("macro_precision"), F.col("recall").alias("macro_recall"),
        F.col("f1").alias("macro_f1"))
    weighted = report.where("class = 'weighted avg'").select(F.col("f1").alias("weighted_f1"))
    one = F.lit(1).alias("_k")
    joined = (right.select("*", one).join(macro.select("*", one), "_k")
              .join(weighted.select("*", one), "_k").drop("_k"))
    return joined.select(F.lit(name).alias("model"), F.lit(position).alias("position"),
                         *joined.columns)


@dataclass
class Fit:
    """A fitting function in the form of an estimator."""

    fit: Callable[[DataFrame], TreeEnsemble | LinearScores]


@dataclass
class Trained:
    models: dict[str, Model] = field(default_factory=dict)
    results: DataFrame | None = None
    classes: list[str] = field(default_factory=list)
    weights: TermWeights | None = None

    def add(self, name: str, model: Model, test: DataFrame) -> None:
        # scores are settled at once: a handful of rows, so later models do not redo this one
        row = score_row(model, test, name, len(self.models))
        row = test.sparkSession.createDataFrame(row.collect(), row.schema)
        self.models[name] = model
        self.results = row if self.results is None else self.results.unionByName(row)

    def best(self, metric: str = "accuracy") -> str:
        return ev.best_model(self.results, metric).first()["model"]


def index_labels(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """Numeric label by sorted class name. The class list comes to the driver: a model has weights for
    each class anyway."""
    classes = [r[0] for r in df.select(F.col(label).cast("string")).distinct().collect()]
    classes.sort()
    codes = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return df.withColumn("label", codes[F.col(label).cast("string")]), classes


def _term_features(train: DataFrame, test: DataFrame, text: str, terms: int, sublinear: bool
                   ) -> tuple[DataFrame, DataFrame, TermWeights]:
    """Dense term weights, fitted on the training side only."""
    grams = word_grams(F.col(text), pattern=r"\w+")
    weights = TermWeights.fit(train.select(grams.alias("grams")), max_terms=terms,
                              sublinear=sublinear)
    width = max(len(weights.terms), 1)

    def dense(df):
        s = weights.sparse(df.withColumn("grams", grams))
        full = bind({"at": F.map_from_arrays("idx", "val")}, lambda t: F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: F.coalesce(F.try_element_at(t["at"], i), F.lit(0.0))))
        return s.withColumn("terms", full).drop("grams", "idx", "val")

    return dense(train), dense(test), weights


def train_type_model(pairs: DataFrame, key: str = "pair_id", label: str = "bug_type",
                     before: str = "buggy_vector", after: str = "fixed_vector",
                     text: str = "text", terms: int = 300, least: int = 5, trees: int = 100,
                     rounds: int = 100, depth: int = 12, iterations: int = 100) -> Trained:
    """Type from both vectors, their difference and text terms; three models, stratified split."""
    rows = drop_rare_classes(pairs.where(F.col(label).isNotNull()), label, least)
    rows = rows.withColumn("delta", vx.delta_vector(F.col(after), F.col(before)))
    rows, classes = index_labels(rows, label)
    parts = class_balance(stratified_split(rows, label, key), label)
    train, test, weights = _term_features(parts.where("NOT is_test"), parts.where("is_test"), text,
                                          terms, True)
    train, test = (with_features(d, before, after, "delta", "terms").select(
        key, "label", "weight", "features").cache() for d in (train, test))
    out = Trained(classes=classes, weights=weights)
    width = len(train.first()["features"])
    out.add("forest", fit_forest(train, trees, depth), test)
    out.add("boosted", fit_boosted(train, len(classes), rounds), test)
    out.add("mlp", fit_mlp(train, width, len(classes), iterations), test)
    train.unpersist()
    test.unpersist()
    return out


def train_dual(pairs: DataFrame, group: str, targets: tuple[str, ...] = ("bug_type", "severity"),
               before: str = "buggy_vector", after: str = "fixed_vector", trees: int = 200,
               depth: int = 20, iterations: int = 100) -> dict[str, Trained]:
    """One model family per target on [before, after, delta], split by group."""
    rows = pairs.withColumn("delta", vx.delta_vector(F.col(after), F.col(before)))
    rows = with_features(rows, before, after, "delta")
    out = {}
    for target in targets:
        labelled, classes = index_labels(drop_rare_classes(rows, target, 5), target)
        parts = class_balance(group_split(labelled, F.col(group)), target).select(
            "label", "weight", "features", "is_test").cache()
        train, test = parts.where("NOT is_test"), parts.where("is_test")
        t = Trained(classes=classes)
        t.add("forest", fit_forest(train, trees, depth), test)
        t.add("extra_trees", fit_forest(train, trees, depth, extra_random=True), test)
        t.add("sgd", fit_linear(train, "sgd", iterations=iterations), test)
        parts.unpersist()
        out[target] = t
    return out


def train_hybrid(samples: DataFrame, key: str, label: str, text: str, vector: str,
                 terms: int = 1000, trees: int = 100, depth: int = 12, iterations: int = 100,
                 margin: bool = True) -> Trained:
    """Text, vector and text+vector feature families with linear, forest and Bayes models."""
    rows, classes = index_labels(drop_rare_classes(samples, label, 10), label)
    # the split, and then the term weights, serve every family
    parts = settle(class_balance(stratified_split(rows, label, key), label).select(
        "label", "weight", text, vector, "is_test"), "split")
    train, test, weights = _term_features(parts.where("NOT is_test"), parts.where("is_test"), text,
                                          terms, True)
    train, test = (settle(d.drop(text), "terms") for d in (train, test))
    discard(parts)
    out = Trained(classes=classes, weights=weights)
    for family, cols in {"text": ["terms"], "vector": [vector], "both": ["terms", vector]}.items():
        a, b = (packed(with_features(d, *cols).select("label", "weight", "features")) for d in (train, test))
        fits = {"logistic": lambda: fit_linear(a, "logistic", iterations=iterations)}
        if margin:
            fits["svm"] = lambda: fit_linear(a, "svm", iterations=iterations)
        fits["forest"] = lambda: fit_forest(a, trees, depth)
        if family == "text":
            fits["bayes"] = lambda: fit_nb(a)
        with ThreadPool(len(fits)) as pool:
            fitted = pool.map(inheritable_thread_target(samples.sparkSession)(lambda fit: fit()), fits.values(), chunksize=1)
        for name, model in zip(fits, fitted):
            out.add(f"{family}_{name}", model, b)
        a.unpersist()
        b.unpersist()
    discard(train, test)
    return out


def train_binary(samples: DataFrame, group: str, label: str, features: dict[str, list[str]],
                 folds: int = 5, trees: int = 100, rounds: int = 50, depth: int = 10,
                 iterations: int = 100) -> tuple[Trained, DataFrame]:
    """Buggy or clean: feature sets x models, grouped folds for the spread, grouped hold-out for
    the final figure. Returns the hold-out models and, for each of them, accuracy and area under the ROC
    curve over the folds beside the scores of the hold-out."""
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    area = BinaryClassificationEvaluator(numBins=0)  # exact: a point for every score
    spark = samples.sparkSession
    rows = settle(group_kfold(samples.withColumn("label", F.col(label).cast("double")), group, folds), "folds")
    out, scores = Trained(classes=["clean", "buggy"]), []
    for family, cols in features.items():
        parts = packed(group_split(with_features(rows, *cols), F.col(group)).select(
            "label", "features", "fold", "is_test"))
        train, test = parts.where("NOT is_test"), parts.where("is_test")
        models = {
            "logistic": LogisticRegression(maxIter=iterations, regParam=1e-2),
            "svm": LinearSVC(maxIter=iterations),
            "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42),
            "extra_trees": Fit(lambda d: fit_forest(d, trees, depth, True, weight=None)),
            "boosted": GBTClassifier(maxIter=rounds, seed=42)}

        def fitted(task):
            name, f = task
            inside, held = (train, test) if f is None else (parts.where(F.col("fold") != f), parts.where(F.col("fold") == f))
            model = plain(models[name].fit(inside))
            rows_held = model.transform(held)
            return (model, area.evaluate(rows_held)) if f is None else (accuracy.evaluate(rows_held), area.evaluate(rows_held))

        tasks = [(name, f) for name in models for f in [*range(folds), None]]
        with ThreadPool(FITS) as pool:
            done = dict(zip(tasks, pool.map(inheritable_thread_target(spark)(fitted), tasks, chunksize=1)))
        for name in models:
            right, areas = np.array([done[name, f] for f in range(folds)], float).T
            model, holdout = done[name, None]
            out.add(f"{family}_{name}", model, test)
            scores.append((f"{family}_{name}", float(right.mean()), float(right.std()), float(areas.mean()),
                           float(areas.std()), holdout))
        parts.unpersist()
    discard(rows)
    folded = spark.createDataFrame(
        scores, "model string, mean double, deviation double, mean_auc double, deviation_auc double, holdout_auc double")
    held_out = out.results.select("model", *[F.col(c).alias(f"holdout_{c}") for c in out.results.columns
                                             if c not in ("model", "position")])
    return out, folded.join(held_out, "model")


def train_pair_order(pairs: DataFrame, key: str, before: str, after: str, trees: int = 100,
                     depth: int = 10, iterations: int = 100) -> Trained:
    """Which side is buggy, from both orders of a pair; a pair's orders stay on one side."""
    rows = swap_pairs(pairs.select(key, before, after), before, after)
    rows = group_split(rows, F.col(key)).withColumn("label", F.col("label").cast("double"))
    rows = rows.withColumn("features", array_to_vector("features")).cache()
    train, test = rows.where("NOT is_test"), rows.where("is_test")
    out = Trained(classes=["buggy_first", "clean_first"])
    out.add("logistic", fit_linear(train, "logistic", None, iterations), test)
    out.add("forest", fit_forest(train, trees, depth, weight=None), test)
    rows.unpersist()
    return out


def predict_batch(model: Model, snippets: DataFrame, classes: list[str], vector: str,
                  keep: list[str], width: int = 64, k: int = 3, pair_model: bool = True
                  ) -> DataFrame:
    """Score single snippets: a pair model gets the same vector twice and a zero difference.
    Returns the k best types per snippet with their texts."""
    rows = snippets.withColumn("_zero", vx.zeros(width))
    cols = [vector, vector, "_zero"] if pair_model else [vector]
    scored = probabilities(model, with_features(rows, *cols).select(*keep, "features"))
    return lookup_texts(top_predictions(scored.select(*keep, "probabilities"), "probabilities",
                                        classes, k))
