"""From raw documents to training tokens: five stages, each over all that the one before kept.

Each stage takes rows with any column null, texts empty or very long, repeated rows and empty tables, and passes
other columns on, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import bpe, minhash, mixing, pii, quality
from meshwright.llm.common import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text fails; equal rows share their fate."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; of rows with one doc_id one stays, and all rows without one."""
    return minhash.dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents that make up the sources' targets, in training order; texts without words are in no mix."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to; a null text has no tokens."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Expectation-maximisation, near duplicates and byte-pair merges have no SQL form; tests/llm/test_methods.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage{i}")
    return docs
