"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, chat, decontaminate, mixing, neardup, pii, quality, sharding, suffixes, toxicity

#: Key of the surrogates; a production job passes its own secret.
PII_KEY = "kestrel-surrogates"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_tree(_table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.bits_per_byte(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the compacted store's last version holds, texts by their digest."""
    return sharding.shard(_table(spark, sf_dir, "documents")).read().select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_toxicity, op3_decontaminate, op4_mixing, op5_near_duplicates, op6_sharding, op7_bpe, op8_pii, op9_quality, op10_suffixes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": sharding.ORACLE_SQL, "op9_quality": quality.oracle_sql()}
