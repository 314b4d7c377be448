"""A training-corpus pipeline out of the operators in ``dwelltrace.llm``.

Each stage takes all that its predecessor kept. All but the last return the columns of the
documents; the last returns the tokens' digests of every document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwelltrace.llm.common import staged, table
from dwelltrace.llm.exact_dedup import drop_exact_copies
from dwelltrace.llm.registry import bpe_digest
from dwelltrace.llm.simhash import drop_near_copies
from dwelltrace.llm.source_mix import mixed_documents
from dwelltrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within 4 bits, over runs of four words."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, encoded and decoded again."""
    return bpe_digest(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("tokenize", tokenize),
]

# Learning, components and balanced sampling are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
