"""Readers: pair files, samples, source trees, archives, commit logs."""
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.functions import vectors as vx
from patchlens.operators.grouping import spread_row_number
from patchlens.operators.quality import is_source_file
from patchlens.rules import lexicon as L
from patchlens.sources.json_arrays import SPLIT_BYTES, read_json_array


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SIGNATURE = T.StructType([T.StructField(n, T.IntegerType()) for n in (
    "added_boundary_check", "added_await", "delta_op_gt", "complexity_delta")])
PAIR_JSON = T.StructType([
    T.StructField("pair_id", T.LongType()), T.StructField("id", T.LongType()),
    *_strings("commit_id", "commit_message", "project_name", "file_path", "bug_type", "severity",
              "language", "buggy_code_chunk", "buggy_code", "fixed_code_chunk", "fixed_code"),
    T.StructField("ast_vector_120d", T.ArrayType(T.DoubleType())),
    T.StructField("ast_vector", T.ArrayType(T.DoubleType())),
    T.StructField("delta_signature", SIGNATURE), *_strings("root_cause", "fix_description"),
    T.StructField("gemini_confidence", T.DoubleType())])
SAMPLES_CSV = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("pair_id", T.LongType()),
    T.StructField("is_bug", T.IntegerType()),
    *_strings("label_name", "code", "ast_vector", "language", "bug_type", "severity", "repository",
              "commit_hash", "file_path", "ast_tier", "bug_description", "root_cause",
              "fix_description"),
    T.StructField("confidence", T.DoubleType()), *_strings("validation_status")])
MINED_CSV = T.StructType([
    *_strings("repository", "commit_hash", "file_path", "language", "bug_type",
              "original_commit_message", "buggy_code", "fixed_code", "buggy_ast_vector",
              "fixed_ast_vector", "ast_tier", "bug_description", "root_cause", "fix_description",
              "severity", "bug_pattern", "affected_component"),
    T.StructField("confidence_score", T.DoubleType()), T.StructField("match_margin", T.DoubleType()),
    *_strings("label_source", "gemini_model"), T.StructField("gemini_confidence", T.DoubleType()),
    *_strings("gemini_reason", "gemini_validation_status", "gemini_api_key_slot"),
    T.StructField("gemini_attempts", T.IntegerType())])
COMMITS_JSON = T.StructType([
    *_strings("repository"), T.StructField("position", T.IntegerType()),
    *_strings("sha", "message"),
    T.StructField("parents", T.ArrayType(T.StructType(_strings("sha")))),
    T.StructField("files", T.ArrayType(T.StructType([
        *_strings("filename"), T.StructField("additions", T.IntegerType()),
        T.StructField("deletions", T.IntegerType()), *_strings("patch")])))])


def read_pairs_json(spark: SparkSession, path: str, multi_line: bool = True,
                    split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """Pair records with field aliases settled and vectors of 64. Rows without any id get one
    after the largest known, in code order. Line-delimited files split, and so does one big array,
    every `split_bytes`; with None (compressed files) it is read whole by one task."""
    if multi_line and split_bytes:
        return settle_pairs(read_json_array(spark, path, PAIR_JSON, split_bytes))
    return settle_pairs(spark.read.schema(PAIR_JSON).json(path, multiLine=multi_line))


def settle_pairs(raw: DataFrame) -> DataFrame:
    code = F.coalesce("buggy_code_chunk", "buggy_code")
    rows = raw.withColumn("_id", F.coalesce("pair_id", "id")).withColumn(
        "_key", F.xxhash64(code, F.coalesce("fixed_code_chunk", "fixed_code"), "commit_id"))
    named = rows.where("_id IS NOT NULL")
    last = named.agg(F.coalesce(F.max("_id"), F.lit(0)).alias("_last"))
    nameless = spread_row_number(rows.where("_id IS NULL"), [], F.shiftright("_key", 52),
                                 [F.col("_key")], "_rn").drop("_n")
    one = F.lit(1).alias("_one")
    nameless = (nameless.withColumn("_one", F.lit(1)).join(last.select("*", one), "_one")
                .withColumn("_id", F.col("_last") + F.col("_rn")).drop("_one", "_last", "_rn"))
    both = named.unionByName(nameless)
    return both.select(
        F.col("_id").alias("pair_id"), "commit_id", "commit_message", "project_name", "file_path",
        "bug_type", "severity", "language", code.alias("buggy_code_chunk"),
        F.coalesce("fixed_code_chunk", "fixed_code").alias("fixed_code_chunk"),
        vx.fit_dim(F.coalesce("ast_vector_120d", "ast_vector", F.array().cast("array<double>")), 64)
        .alias("ast_vector"), "delta_signature", "root_cause", "fix_description",
        F.coalesce("gemini_confidence", F.lit(0.9)).alias("label_confidence"))


def read_samples_csv(spark: SparkSession, path: str, schema: T.StructType = SAMPLES_CSV
                     ) -> DataFrame:
    """Labelled CSV with quoted line breaks; malformed lines are left out."""
    return spark.read.schema(schema).csv(
        path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED",
        maxCharsPerColumn=-1)


def _text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def read_source_tree(spark: SparkSession, root: str,
                     ignored: list[str] = L.SCAN_IGNORED_DIRS,
                     extensions: tuple[str, ...] = ("js", "jsx", "ts", "tsx", "mjs")) -> DataFrame:
    """Source files under a root as (path, content, size). File names are filtered while listing,
    folders before any content is decoded."""
    root = root.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root))
    relative = F.regexp_replace(F.col("path"), r"^.*?\Q" + root + r"\E/", "")
    dirs = F.split(relative, "/")
    kept = F.slice(dirs, F.lit(1), F.size(dirs) - 1)
    return (files.withColumn("path", relative)
            .where(~F.arrays_overlap(kept, F.array(*map(F.lit, ignored))))
            .select("path", _text(F.col("content")).alias("content"),
                    F.col("length").alias("size")))


def read_zip_tree(spark: SparkSession, path: str, extensions=("js", "jsx", "ts", "tsx", "json")
                  ) -> DataFrame:
    """Entries of uploaded archives as (archive, path, content, size). Paths that leave the root
    are refused."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    ends = tuple("." + e for e in extensions)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    for entry in archive.infolist():
                        inner = entry.filename.replace("\\", "/")
                        if (entry.is_dir() or inner.startswith("/") or ".." in inner.split("/")
                                or not inner.endswith(ends)):
                            continue
                        text = archive.read(entry).decode("utf-8", "ignore")
                        yield pd.DataFrame([(name, inner, text, entry.file_size)],
                                           columns=["archive", "path", "content", "size"])

    return archives.mapInPandas(expand, "archive string, path string, content string, size long")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Landed commit JSON lines."""
    return spark.read.schema(COMMITS_JSON).json(path)


def commit_files(commits: DataFrame) -> DataFrame:
    """One row per changed file, with the parent commit; first commits have none and go."""
    return (commits.withColumn("parent_sha", F.get(F.col("parents.sha"), F.lit(0)))
            .where("parent_sha IS NOT NULL")
            .select("repository", "position", F.col("sha").alias("commit_hash"), "message",
                    "parent_sha", F.posexplode("files").alias("file_no", "f"))
            .select("*", "f.*").drop("f"))
