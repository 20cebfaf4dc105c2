"""A training-data pipeline over the documents: each stage works on all rows that its predecessor kept.

1. Quality rules: rows that the base or the labelled cutoffs reject go.
2. Near-duplicates (five words, 80 %): of each group the row with the least doc_id stays, of repeated rows one.
3. Benchmark decontamination: benchmark passages are cut out; rows that are mostly passages go.
4. Secret scans: spans of secrets are replaced by a mark.
5. Packing: the pieces of the remaining texts and their places in sequences of 2048 tokens.

All stages but the last return the columns of documents; where a text changes, ``n_chars`` follows it. Null doc_ids are kept; rows
are told apart by doc_id and a hash of the text. Each stage accepts empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastelake.llm import decontam, near, packing, quality, secrets
from tastelake.session import stored

WORDS, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, labels)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near.one_of_each(docs, words=WORDS, percent=PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with sequence_id and offset, as ``op1`` gives them."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: The fitted cutoffs and the packing have no SQL form that gives the same rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i + 1}")
    return docs
