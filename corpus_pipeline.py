"""Stages of the corpus pipeline over the documents table.

Each stage takes all rows that its predecessor kept and returns the columns of documents, the last one the
encoded documents. Nulls, empty texts, repeated rows and empty tables behave as the operators' modules say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, mixing, near_dup, pii, quality_classifier
from wayfare.llm.common import crc_mod, materialize, table


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be poor go; it learns from labels outside the held-out fold."""
    machine = quality_classifier.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality_classifier.keep_good(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return near_dup.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in the place of personal data."""
    return pii.replace_in(docs, counted=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice."""
    return mixing.apply_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit integers), n_tokens; texts come back from the ids."""
    keep = ["doc_id", "lang", "source"]
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep)
    return found.select(*keep, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII surrogates", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: A trained model, keyed surrogates and sketches have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
