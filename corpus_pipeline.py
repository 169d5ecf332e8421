"""A training corpus from documents, stage by stage; each stage's result is the next one's input.

Every stage keeps the columns of documents and works on all its predecessor kept; the last adds how
many words of a document the mix takes.  Of all stages: an empty table gives an empty result, texts are
read whole whatever their length, and further columns come through unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphquarry.llm import decontam, mixing, quality, secretscan, shingles, simhash
from graphquarry.llm.common import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive fences.

    Null and empty texts fail; a null language or source is a group of its own; rows that repeat are
    judged alike.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.  Null texts,
    and those without words, are one group; of rows alike in id and text one stays; a null id stays only
    where its group has no other.
    """
    return simhash.keep_one(docs, find=shingles.near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: cut out, or dropped where they are over half the words.

    Null and empty texts stay as they are; rows that repeat are treated alike; a benchmark without items
    changes nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.remove_contamination(docs, items)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked.

    Null and empty texts stay as they are; rows that repeat are treated alike.
    """
    return secretscan.masked_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken.

    Null and empty texts have size 0 and are never taken; a null source is one of its own; rows that
    repeat are documents of their own.
    """
    return mixing.taken_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("source_mixing", source_mixing),
]

#: Decontamination and masking can't be told in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents, each stage's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
