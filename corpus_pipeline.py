"""A corpus pipeline of five stages over ``documents``; each stage is one of the operators in ``factloom.llm``.

A stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a frame; the driver writes it as Parquet and reads it
back for the next stage. All stages but the last return the columns of ``docs``. Nulls, empty texts, repeated rows and extra columns
are handled as the operators define it; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, langid, mixing, quality, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the models reject; learn from the labelled rows of ``docs`` that are not held out."""
    return langid.keep_known(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or the thresholds of their language and source."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights."""
    return mixing.sample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every document of the mix: token counts and digests."""
    return bpe.encode(docs, digest=True)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: The stages are not SQL (language models, XXH64, BPE): tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents`` in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
