"""Group-wise ranking that stays safe when one key holds a large share of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.session import settle

SALTS = 32


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each group. The rank filter is applied before the shuffle too, so a hot key
    sends one row per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  spread: list[str], rank: str = "rank") -> DataFrame:
    """Top k rows of each group with their rank, in two rounds: inside salted parts of the group,
    then over what is left. Nothing that could make the top k is lost in the first round."""
    part = F.pmod(F.xxhash64(*spread), F.lit(SALTS))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_part", part)
            .withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k)
            .drop("_rn", "_part")
            .withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k))


def spread_row_number(df: DataFrame, keys: list[str], bin_: Column, order: list[Column],
                      name: str = "rn") -> DataFrame:
    """Exact row_number per group without one task per group.

    `bin_` must grow with `order` (rows of a lower bin come first). Bins are counted, their
    running totals become offsets, and rows are numbered inside their bin only.
    """
    df = df.withColumn("_bin", bin_)
    by = [*keys, "_bin"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_bin")
    offsets = counts.select(*by, (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
    inside = Window.partitionBy(*by).orderBy(*order)
    numbered = df.join(offsets, by)
    return (numbered.withColumn(name, F.col("_offset") + F.row_number().over(inside))
            .drop("_bin", "_offset"))


def range_bins(df: DataFrame, order: list[Column], name: str = "_range") -> DataFrame:
    """Rows with the number of their range of `order`, for `spread_row_number`. Ranges are of near
    equal size whatever the values; the table is written, so that a range stays what it is."""
    ranged = df.repartitionByRange(*order)
    return settle(ranged.withColumn(name, F.spark_partition_id()), "ranges")


def with_group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Group size on every row by count and join, so no group has to sit in one task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, keys)


def id_hash(key: Column, seed: int = 42) -> Column:
    """Plain integer hash in 0 .. 2^31-1 of a whole-number key."""
    k = F.pmod(key.cast("long"), F.lit(2147483647))
    once = F.pmod(k * F.lit(48271) + F.lit(seed), F.lit(2147483647))
    return F.pmod(once * F.lit(69621) + F.lit(seed), F.lit(2147483647))


def hash_bin(h: Column, bits: int = 12) -> Column:
    """Leading bits of `id_hash`, which grow with it."""
    return F.shiftright(h, 31 - bits)
