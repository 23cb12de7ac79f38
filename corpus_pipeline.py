"""Documents to training sequences, stage by stage.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns
the documents it lets through, with their columns, and the last one the packed pieces.
Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import exact_dedup, mixing, near_dedup, packing, quality
from trailmark.llm.common import discard, stored, table
from trailmark.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    prepare(spark)
    return quality.keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    prepare(spark)
    return exact_dedup.deduplicate(docs)


#: Percent of shared five-word shingles from which two documents are near-duplicates.
NEAR_PERCENT = 85


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    prepare(spark)
    return near_dedup.deduplicate(docs, percent=NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole, in the order of its slots."""
    prepare(spark)
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, placed in sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: Tokenising and minhashing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
