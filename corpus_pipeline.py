"""A pipeline of the text operators over ``documents``; each stage reads what the one before it has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from synthmill.llm.common import documents, written
from synthmill.llm.jaccard import one_each
from synthmill.llm.packing import pack
from synthmill.llm.quality import kept
from synthmill.llm.repeats import trimmed
from synthmill.llm.secrets import masked


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest key of each group of near copies."""
    return one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller keys have too; those of which nothing is left go."""
    return measured(trimmed(docs))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    return measured(masked(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("n-gram jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("secret scans", secret_masks), ("best-fit packing", packed_sequences)]

#: None: suffix arrays and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
