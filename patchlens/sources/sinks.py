"""Writers: appends, upserts, resumable jobs, metrics and scan documents."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from patchlens.functions import vectors as vx
from patchlens.operators.grouping import first_per_group
from patchlens.operators.report import SCAN_BUCKETS, scan_bucket
from patchlens.operators.retrieval import VectorIndex, dense_as_sparse
from patchlens.session import discard, settle


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(hadoop).exists(target)


def append_records(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append rows; CSV is for exchange, every field quoted and a header per file."""
    if kind == "csv":
        df.write.mode("append").csv(path, header=True, quoteAll=True, escape='"')
    else:
        df.write.mode("append").parquet(path)


def upsert_by_key(current: DataFrame, incoming: DataFrame, key: str, version: list[Column]
                  ) -> DataFrame:
    """Insert or replace: the newest row of each key over both tables."""
    rows = current.unionByName(incoming, allowMissingColumns=True)
    return first_per_group(rows, [key], version)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a keyed table, oldest first."""
    fs, at = _fs(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _listing(spark: SparkSession, path: str, version: int) -> tuple[int, dict[int, str]]:
    """Number of buckets, and the folder of each bucket that has rows, in a version."""
    rows = spark.read.schema("buckets int, bucket int, folder string").json(f"{path}/versions/{version}").collect()
    return rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows}


def read_keyed_table(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None
                     ) -> DataFrame:
    """The newest version of a keyed table or an earlier one; of some buckets only, on demand."""
    _, folders = _listing(spark, path, table_versions(spark, path)[-1] if version is None else version)
    chosen = [f"{path}/data/{f}/bucket={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
    return spark.read.option("mergeSchema", "true").parquet(*chosen)


def upsert_keyed_table(incoming: DataFrame, path: str, key: str, version: list[Column], buckets: int = 64) -> int:
    """Insert or replace rows in a stored table: the newest row of each key stays. Returns the version after it.

    Only buckets that the incoming rows touch are read and written, to folders of their own; then a list of all folders
    is put in place by one rename. Readers see the version before or the one after, and a write that fails leaves the one
    before. One writer at a time; the number of buckets is that of the first write. No rows make no version.
    """
    spark = incoming.sparkSession
    done = table_versions(spark, path)
    number, folders = done[-1] if done else 0, {}
    if done:
        buckets, folders = _listing(spark, path, number)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = settle(incoming.withColumn("_bucket", bucket), "incoming")
    touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most one row a bucket
    if not touched:
        return number
    there = [b for b in touched if b in folders]
    rows = fresh
    if there:
        old = read_keyed_table(spark, path, number, there)
        rows = old.withColumn("_bucket", bucket).unionByName(fresh, allowMissingColumns=True)
    folder = uuid.uuid4().hex
    newest = first_per_group(rows, [key], version).withColumnRenamed("_bucket", "bucket")
    newest.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    listed = {**folders, **{b: folder for b in touched}}
    lines = [json.dumps({"buckets": buckets, "bucket": b, "folder": f}) for b, f in sorted(listed.items())]
    fs, made = _fs(spark, f"{path}/versions/_{folder}")
    out = fs.create(made, False)
    out.write("\n".join(lines).encode())
    out.close()
    _, place = _fs(spark, f"{path}/versions/{number + 1}")
    if fs.exists(place) or not fs.rename(made, place):
        raise RuntimeError(f"version {number + 1} of {path} was written by another job")
    discard(fresh)
    return number + 1


def expire_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete versions but the newest ones, and the folders that only they name."""
    done = table_versions(spark, path)
    old, kept = done[:-keep], done[-keep:]
    used = {f for v in kept for f in _listing(spark, path, v)[1].values()}
    for v in old:
        gone = set(_listing(spark, path, v)[1].values()) - used
        for part in [*(f"data/{f}" for f in sorted(gone)), f"versions/{v}"]:
            fs, at = _fs(spark, f"{path}/{part}")
            fs.delete(at, True)


def seed_if_empty(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows not stored yet are appended, so a repeated seed adds nothing. Returns the table."""
    spark = df.sparkSession
    if table_exists(spark, path):
        stored = spark.read.parquet(path)
        df = df.join(stored.select(key), key, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def index_rows(pairs: DataFrame, key: str, vector: str, dim: int = 64, buckets: int = 64
               ) -> DataFrame:
    """Unit vectors of fixed width with payload and bucket; rows without a vector go."""
    v = F.col(vector)
    return (pairs.where(v.isNotNull() & (F.size(v) > 0))
            .withColumn(vector, vx.l2_normalise(vx.fit_dim(v, dim)))
            .withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))


def write_vector_index(pairs: DataFrame, path: str, key: str, vector: str, dim: int = 64) -> int:
    """Write the rows with their payload by bucket, and beside them their vectors in cells for
    `vector_topk`. Returns the number of rows, counted while writing."""
    seen = Observation("index")
    rows = index_rows(pairs, key, vector, dim).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = pairs.sparkSession.read.parquet(path)
    VectorIndex.build(dense_as_sparse(written, key, F.col(vector), dim), dim).write(f"{path}/_cells")
    return seen.get["n"]


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The cells that `write_vector_index` has written, as they are; ids are the keys of the payload rows."""
    return VectorIndex.read(spark, f"{path}/_cells")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def enrich_resume(df: DataFrame, path: str, key: str, enrich) -> DataFrame:
    """Enrich only rows whose key is not in the output yet, append them, return the output."""
    spark = df.sparkSession
    if table_exists(spark, path):
        try:
            df = not_done(df, spark.read.parquet(path), key)
        except AnalysisException:  # the folder is there but no file was finished
            pass
    enrich(df).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def tall_metrics(results: DataFrame, model: str = "model") -> DataFrame:
    names = [f.name for f in results.schema if f.name not in (model, "position")]
    pieces = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return results.selectExpr(model, f"stack({len(names)}, {pieces}) AS (metric, value)")


def write_metrics(results: DataFrame, path: str) -> None:
    tall_metrics(results).write.mode("overwrite").json(path)


def write_scans(rows: DataFrame, path: str, scan: str = "scan_id", buckets: int = SCAN_BUCKETS) -> None:
    """Append rows of scans by bucket of the scan, so that `get_scan` prunes. The rows of a bucket are dealt to several
    tasks, since one scan may hold a large share of them."""
    placed = rows.withColumn("scan_bucket", scan_bucket(F.col(scan), buckets))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(8))
    placed.repartition("scan_bucket", spread).write.mode("append").partitionBy("scan_bucket").parquet(path)


def scan_documents(rows: DataFrame, scan: str, part: str, item: str) -> DataFrame:
    """One JSON document per scan and part (its file), with the scan's number of rows, so no scan has
    to fit one task."""
    counts = rows.groupBy(scan).agg(F.count(F.lit(1)).alias("rows_total"))
    body = [c for c in rows.columns if c not in (scan, part, item)]
    documents = rows.groupBy(scan, part).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(item, *body)))).alias("document"))
    return documents.join(counts, scan)


def nested_scan_documents(files: DataFrame, ledger: DataFrame, findings: DataFrame, summary: DataFrame,
                          scan: str, file: str, item: str) -> DataFrame:
    """One JSON document per scan and file, as a document store takes it: the file with its ledger and
    its findings, under the totals of the scan."""
    def nested(rows: DataFrame, name: str) -> DataFrame:
        body = [c for c in rows.columns if c not in (scan, file, item)]
        return rows.groupBy(scan, file).agg(
            F.sort_array(F.collect_list(F.struct(item, *body))).alias(name))

    totals = summary.select(scan, F.struct(*[c for c in summary.columns if c != scan]).alias("totals"))
    keys = [scan, file]
    whole = (files.join(nested(ledger, "ledger"), keys, "left").join(nested(findings, "findings_list"), keys, "left")
             .join(totals, scan, "left"))
    body = [c for c in whole.columns if c != scan]
    return whole.select(scan, file, F.to_json(F.struct(*body)).alias("document"))
