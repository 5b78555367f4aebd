"""Raw documents to packed training sequences: the stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``; the last returns one row per packed piece.
Null and empty texts go through all stages (each operator says how it takes them); tables that are empty
give empty results, and further columns of ``documents`` are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from eventlens.session import settle


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest id stays."""
    return near_dedup.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats an earlier passage; every document stays, its characters counted anew."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

# A network, sampled candidates and a tokenizer are no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
