"""The corpus pipeline: quality rules, near duplicates, decontamination, PII and tokens, each over what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import bpe, decontaminate, neardup, pii, quality
from kestrel.llm.queries import PII_KEY
from kestrel.session import drop_path, scratch, work


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymize_rows(docs, PII_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs)


STAGES = [("quality", rules), ("near duplicates", copies), ("decontamination", leaks), ("pii", surrogates), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage's rows are written in the shared folder and read again.

    Documents with a null or blank text go at the first stage; a null doc_id,
    language or source stays one. Of repeated rows, near copies and ties the
    near-duplicate stage keeps one. Very long texts are read whole by each
    stage. An empty table gives an empty one, and further columns, whatever
    their names, go along as far as the last stage. What a stage makes for
    itself, and its input once the next is written, is deleted.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        with work(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
