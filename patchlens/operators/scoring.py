"""Columns that a fitted model adds to rows, in the form of Spark ML's classifiers."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def with_scores(rows: DataFrame, scores: Callable[[np.ndarray], np.ndarray], margins: bool) -> DataFrame:
    """rawPrediction, probability and prediction from `scores` of whole batches of features; margins become chances."""
    told = rows.sparkSession.sparkContext.broadcast(scores)

    @F.pandas_udf("array<double>")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(list(told.value(np.stack(values))) if len(values) else [], dtype=object)

    def chances(raw):
        e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    scored = rows.withColumn("_raw", score(vector_to_array("features")))
    scored = scored.withColumn("_p", chances(F.col("_raw")) if margins else F.col("_raw"))
    return scored.withColumns({
        "rawPrediction": array_to_vector("_raw"), "probability": array_to_vector("_p"),
        "prediction": (F.array_position("_p", F.array_max("_p")) - 1).cast("double")}).drop("_raw", "_p")
