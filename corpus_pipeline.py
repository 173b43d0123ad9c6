"""The corpus pipeline: each stage reads what the one before it kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchlens.llm import decontaminate, ftrl, jaccard, mixing, tokens
from patchlens.llm.common import Scratch, fresh_path, table


#: Blocks coded together: the last stage shares its executors with what the stages before have left in memory.
LANES = 1024


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return ftrl.keep_quality(docs, ftrl.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id."""
    return jaccard.keep_one(docs, Scratch(spark))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the source mix takes them."""
    return mixing.mixed_documents(docs, Scratch(spark))


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files say of each document: doc_id, start, n_tokens, ids_crc32."""
    return tokens.encoded(docs, fresh_path(spark, "tokens"), lanes=LANES)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", mix),
    ("token_blocks", token_blocks),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
