"""Removal of lines that stand on many sites.

A line is a key of 128 bits; HyperLogLog sketches of its sites merge by aggregation, and lines near the threshold get
an exact count. A line on enough sites goes everywhere but in the document of the smallest id that holds it.

Edge cases: a null text stays null and has no lines; blank lines and lines of fewer than `least_words` words always
stay; a null source is a site of its own; equal lines inside one document count once for its site; repeated rows are
treated alike; an empty table gives no rows; other columns are kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sites from which on a line is boilerplate, and words below which a line is left alone.
LEAST_SITES = 5
LEAST_WORDS = 3
PRECISION = 12
#: Around the threshold, the share that the sketch's estimate may be off: over five standard errors at PRECISION.
MARGIN = 0.1


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _counts(line: Column, least_words: int) -> Column:
    """Lines that may be boilerplate: enough words."""
    return line.rlike(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (least_words - 1))


def boilerplate(lines: DataFrame, least_sites: int = LEAST_SITES, precision: int = PRECISION,
                margin: float = MARGIN) -> DataFrame:
    """(key, first_doc) of the lines (doc_id, site, key) on at least so many sites.

    Only lines that occur often enough to be on so many sites are sketched. Keys with very many rows meet in partial
    aggregates, one a task.
    """
    often = lines.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(
        F.col("n") >= least_sites).drop("n")
    sketched = lines.join(often.select("key"), "key", "left_semi").groupBy("key").agg(
        F.hll_sketch_agg("site", precision).alias("sketch")).select(
        "key", F.hll_sketch_estimate("sketch").alias("sites"))
    sure = sketched.where(F.col("sites") >= least_sites * (1 + margin)).select("key")
    near = sketched.where((F.col("sites") < least_sites * (1 + margin))
                          & (F.col("sites") >= least_sites * (1 - margin))).select("key")
    exact = lines.join(near, "key", "left_semi").select("key", "site").distinct().groupBy("key").agg(
        F.count("*").alias("n")).where(F.col("n") >= least_sites).select("key")
    return often.join(sure.union(exact), "key")


def remove_boilerplate(docs: DataFrame, scratch, least_sites: int = LEAST_SITES, least_words: int = LEAST_WORDS,
                       id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The documents with all their columns, the text without boilerplate lines, and __n_lines, __n_removed."""
    lines = scratch.settle(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000")).alias(
            "site"), F.explode(F.split(text_col, "\n")).alias("line"))
        .where(_counts(F.col("line"), least_words)).select("doc_id", "site", _key(F.col("line")).alias("key")), "lines")
    bad = scratch.settle(boilerplate(lines, least_sites), "boilerplate")
    drop = lines.join(bad, "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy("doc_id").agg(
        F.collect_set("key").alias("__drop")).withColumnRenamed("doc_id", "__id")
    d = docs.join(drop, docs[id_col].eqNullSafe(drop["__id"]), "left")
    parts = F.split(text_col, "\n")
    kept = F.when(F.col("__drop").isNull(), parts).otherwise(
        F.filter(parts, lambda x: ~F.array_contains("__drop", _key(x)) | ~_counts(x, least_words)))
    d = d.withColumn("__n_lines", F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(parts)), F.lit(0)))
    d = d.withColumn("__kept", kept).withColumn(
        "__n_removed", F.when(F.col("__kept").isNull(), 0).otherwise(F.col("__n_lines") - F.size("__kept")))
    return d.withColumn(text_col, F.when(F.col("__n_removed") == 0, F.col(text_col)).otherwise(
        F.array_join("__kept", "\n"))).select(*docs.columns, "__n_lines", "__n_removed")


def cleaned(docs: DataFrame, scratch, **settings) -> DataFrame:
    return remove_boilerplate(docs, scratch, **settings).select(
        "doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"),
        "text")


ORACLE = r"""
WITH numbered AS (SELECT *, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM numbered WHERE text IS NOT NULL),
marked AS (
  SELECT *, regexp_matches(line, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]') AS able
  FROM lines),
bad AS (
  SELECT line, min(doc_id) AS first_doc FROM marked WHERE able GROUP BY line HAVING count(DISTINCT site) >= 5),
kept AS (
  SELECT r, line, pos, NOT (able AND bad.line IS NOT NULL AND doc_id IS DISTINCT FROM first_doc) AS stays
  FROM marked LEFT JOIN bad USING (line)),
joined AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text
  FROM kept GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  joined.text
FROM numbered LEFT JOIN joined USING (r)
"""
