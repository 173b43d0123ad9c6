"""Evaluation aggregates over (label, prediction) and (label, score) tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.session import settle


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: list, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """One row per label, one column per prediction."""
    return df.groupBy(label).pivot(prediction, classes).agg(F.count(F.lit(1))).fillna(0)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means. The raw rows
    are read once, for the confusion counts, which are written; the rest works on classes."""
    return report_of(settle(confusion(df, label, prediction), "confusion"), label, prediction)


def report_of(counts: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Class report from confusion counts."""
    right = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.col("n").alias("s"),
                 F.lit(0).cast("long").alias("p"), right.cast("long").alias("t")),
        F.struct(F.col(prediction).cast("string").alias("class"), F.lit(0).cast("long").alias("s"),
                 F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("x")).select("x.*")
    sums = sides.groupBy("class").agg(F.sum("s").alias("s"), F.sum("p").alias("p"),
                                      F.sum("t").alias("t"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    per = sums.select("class", ratio(F.col("t"), F.col("p")).alias("precision"),
                      ratio(F.col("t"), F.col("s")).alias("recall"), F.col("s").alias("support"))
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", ratio(2 * p * r, p + r))
    scores = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = per.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
                         for c in scores], F.sum("support").alias("support"))
    cols = ["class", *scores, "support"]
    return (per.select(cols)
            .unionByName(macro.withColumn("class", F.lit("macro avg")).select(cols))
            .unionByName(weighted.withColumn("class", F.lit("weighted avg")).select(cols)))


def roc_auc(df: DataFrame, label: str, score: str, bin_: Column | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Scores are counted by value, values are laid in bins that grow with the score, and running
    totals go bin by bin, so no task ranks all rows. `bin_` must grow with the score; the default
    suits probabilities.
    """
    s = F.col(score)
    bin_ = F.floor(s * 4096) if bin_ is None else bin_
    values = df.groupBy(s.alias("s"), bin_.alias("b")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    bins = values.groupBy("b").agg(F.sum("neg").alias("_n"))
    bins = bins.select("b", (F.sum("_n").over(Window.orderBy("b")) - F.col("_n")).alias("_below"))
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(bins, "b").withColumn(
        "below", F.col("_below") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return placed.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def topk_accuracy(ranked: DataFrame, key: str, label: str, prediction: str, k: int = 3,
                  rank: str = "rank") -> DataFrame:
    """Share of keys whose label is among their first k predictions."""
    hit = (F.col(label) == F.col(prediction)) & (F.col(rank) <= k)
    return ranked.groupBy(key).agg(F.max(hit.cast("int")).alias("h")).agg(
        F.avg("h").alias(f"top{k}_accuracy"))


def cv_summary(scores: DataFrame, model: str = "model", value: str = "value") -> DataFrame:
    return scores.groupBy(model).agg(F.avg(value).alias("mean"),
                                     F.stddev_pop(value).alias("deviation"))


def best_model(results: DataFrame, metric: str, order: str = "position") -> DataFrame:
    """Row of the highest metric; the first wins ties. One row per model comes in."""
    return results.orderBy(F.col(metric).desc(), order).limit(1)
