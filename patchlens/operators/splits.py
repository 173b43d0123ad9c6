"""Splits, folds, label codes and scaling. Everything is exact and no class sits in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.operators.grouping import hash_bin, id_hash, range_bins, spread_row_number, with_group_count
from patchlens.session import settle


def _ranked_by_hash(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Position of each row inside its class, in hash order."""
    hashed = df.withColumn("_h", id_hash(F.col(key), seed))
    return spread_row_number(hashed, [label], hash_bin(F.col("_h")),
                             [F.col("_h"), F.col(key)], "_rn").drop("_h")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Mark `is_test` on exactly ceil(share * n) rows of every class."""
    ranked = with_group_count(_ranked_by_hash(df, label, key, seed), [label], "_n")
    return ranked.withColumn("is_test", F.col("_rn") <= F.ceil(F.col("_n") * F.lit(test_share))
                             ).drop("_rn", "_n")


def stratified_kfold(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42
                     ) -> DataFrame:
    ranked = _ranked_by_hash(df, label, key, seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_rn")


def group_split(df: DataFrame, group: Column, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Mark `is_test` by a hash of the group, so a group is never divided. No shuffle."""
    return df.withColumn("is_test", F.pmod(id_hash(group, seed), F.lit(100)) < test_percent)


def fold_segments(histogram: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Largest group first to the lightest fold (the first of equals), for a histogram (size, groups) from the largest
    size on. Groups of one size go in turn to a set of folds until a further fold is as light: each segment (size, first,
    last, folds in turn) says so for groups first .. last of the size; a size has at most `folds` segments."""
    loads, out = [0] * folds, []
    for size, groups in histogram:
        at = 1
        while groups:
            turn = sorted(range(folds), key=lambda f: (loads[f], f))
            low, light = loads[turn[0]], turn[0]
            m = sum((loads[f], f) < (low + size, light) for f in turn)
            take = groups
            if m < folds:  # whole turns until the next fold is reached
                gap, level = divmod(loads[turn[m]] - low, size)
                take = min(groups, m * (gap - (level == 0 and turn[m] < light)))
            out.append((size, at, at + take - 1, turn[:m]))
            for place, f in enumerate(turn[:m]):
                loads[f] += size * (take // m + (place < take % m))
            at, groups = at + take, groups - take
    return out


def group_kfold(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Folds of whole groups: the largest group first, each to the lightest fold. Only the histogram of group sizes is
    walked in order; it has at most sqrt(2 n) rows for n rows. Groups of one size go by their key."""
    sizes = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("_k")), "sizes")
    histogram = sorted(((r["_k"], r["c"]) for r in sizes.groupBy("_k").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    segments = df.sparkSession.createDataFrame(
        fold_segments(histogram, folds), "_size long, _first long, _last long, _turn array<int>")
    ranked = spread_row_number(range_bins(sizes, [F.col("_k"), F.col(group)]), ["_k"], F.col("_range"), [F.col(group)], "_rn")
    place = F.pmod(F.col("_rn") - F.col("_first"), F.size("_turn").cast("long")).cast("int")
    dealt = ranked.join(segments, (F.col("_k") == F.col("_size")) & F.col("_rn").between(F.col("_first"), F.col("_last"))).select(
        F.col(group).alias("_group"), F.get("_turn", place).alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def encode_label(df: DataFrame, label: str, name: str = "label_index") -> DataFrame:
    """Classes in sorted order to 0, 1, 2, ... Classes are numbered range by range."""
    classes = range_bins(df.select(label).distinct(), [F.col(label)])
    coded = spread_row_number(classes, [], F.col("_range"), [F.col(label)], "_n")
    return df.join(coded.select(label, (F.col("_n") - 1).alias(name)), label)


def fit_scale(df: DataFrame, vector: str, dim: int) -> tuple[list[float], list[float]]:
    """Mean and population deviation per position: one aggregate, one row back."""
    stats = df.agg(*[f(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"{n}{i}")
                     for i in range(dim) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [stats[f"m{i}"] for i in range(dim)], [stats[f"s{i}"] for i in range(dim)]


def standardise(df: DataFrame, vector: str, fitted: tuple[list[float], list[float]],
                name: str = "scaled") -> DataFrame:
    """Zero mean, unit population deviation; a constant position is only centred."""
    means, devs = (F.array(*map(F.lit, xs)) for xs in (fitted[0], [s or 1.0 for s in fitted[1]]))
    centred = F.zip_with(vector, means, lambda x, m: x.cast("double") - m)
    return df.withColumn(name, F.zip_with(centred, devs, lambda x, s: x / s))
