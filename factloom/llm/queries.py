"""Queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, langid, licenses, mixing, oracles, quality, simhash, sstable, token_counts, vector_dedup
from .common import documents


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir, ["doc_id", "text"]), digest=True)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(spark, documents(spark, sf_dir, ["doc_id", "text"]))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, ["doc_id", "text"]))


def op5_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.rate(documents(spark, sf_dir, ["doc_id", "text", "lang", "source"])).select(*names)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, ["doc_id", "text", "lang"]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, ["doc_id", "text"]))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir, ["doc_id", "text", "source"])).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, ["doc_id", "text"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [op1_bpe, op2_main_text, op3_token_shards, op4_licenses, op5_vector_near_dedup, op6_quality, op7_language_id, op8_token_counts, op9_mixing, op10_simhash]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
