"""Corpus pipeline: documents through the operators of ``kiln.llm``.

Each stage works on all rows its predecessor kept. The last but one keep the
columns of documents; the last lays the texts out in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.llm import line_dedup, mixing, order_minhash, packing, quality
from kiln.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier line."""
    return line_dedup.rewrite(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return order_minhash.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the source weights; one taken in two epochs is two rows."""
    return mixing.select_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Rolling hashes, alignment and the tokenizer are outside SQL; the tests hold
#: each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
