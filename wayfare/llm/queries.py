"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, chat, mixing, near_dup, pii, quality_classifier, quality_rules, secrets, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_in(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_probe(spark, table(spark, sf_dir, "conversations"))))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.duplicates(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rules of op8_quality_rules, which SQL can express."""
    return quality_rules.base_rules(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text"))


QUERIES: dict[str, Query] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "base_rules": base_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_bm25_topk": op10_bm25_topk,
}

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "base_rules": quality_rules.BASE_ORACLE,
    "op10_bm25_topk": bm25.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op6_near_duplicates": near_dup.ORACLE,
}
