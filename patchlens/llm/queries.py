"""Registered queries of the corpus operators: each applies its operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchlens.llm import decontaminate, filter_audit, ftrl, itq, jaccard, license_scan, lines, mixing, prefix_trie
from patchlens.llm import secret_scan, tokens, toxic, warc
from patchlens.llm.common import Scratch, fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


@query("op7_secret_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, folder, "documents"))


@query("op9_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return ftrl.score_quality(docs, ftrl.fit_quality(docs, table(spark, folder, "labels")))


@query("op10_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxic.score_toxicity(docs, toxic.fit_toxicity(docs, table(spark, folder, "labels")))


@query("op8_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), Scratch(spark))


@query("op5_line_dedup", lines.ORACLE)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.cleaned(table(spark, folder, "documents"), Scratch(spark))


@query("op6_source_mix", mixing.ORACLE)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"), Scratch(spark))


@query("op2_warc_archive")
def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    warc.write_archive(table(spark, folder, "pages"), path, Scratch(spark))
    return warc.read_records(spark, path)


@query("op1_token_blocks")
def token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"), fresh_path(spark, "tokens"))


@query("op4_vector_near_dedup")
def vector_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_vectors(table(spark, folder, "embeddings"), Scratch(spark))


@query("op3_jaccard_join")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"), Scratch(spark), shingle=4, t=85)


@query("op11_filter_audit", filter_audit.ORACLE)
def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"), Scratch(spark))


@query("op12_prefix_trie", prefix_trie.ORACLE)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"), Scratch(spark))


@query("op13_license_scan")
def license_labels(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"))
