"""What the operators share: reading tables, the shared folder, settled tables, connected components."""
from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where unset (tests), a fresh temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that a job writes to cut its lineage; each is deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables, and let Spark's cleaner drop the shuffle files of plans that are over: it does so once
        the driver has collected its garbage."""
        for t in tables:
            kept = self.paths.pop(id(t), None)
            if kept:
                remove(self.spark, kept[1])
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds: each keeps at most as many edges as before, and the number of
    rounds grows with the logarithm of the longest chain. A star's centre may hold very many edges, so neighbours
    meet in a partially aggregated minimum joined back by key, never in one group.
    """
    e = scratch.settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour of u points to the smallest node around u
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.settle(large, "edges")
        # small star: u and its smaller neighbours point to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = scratch.settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.free(e, large)
        e = small
        now = e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v")).distinct())


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def has_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise AnalysisException(f"columns {missing} are missing from {df.columns}")
