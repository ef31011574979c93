"""The queries of this subpackage, one per operator, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, decontaminate, license_scan, passage_dedup, quality_rules, secret_scan, simhash_dedup, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_report(spark, _table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(spark, _table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passage_report(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_dedup, op2_decontaminate, op3_token_counts, op4_secret_scan, op5_quality_rules,
        op6_license_scan, op7_toxicity, op8_passage_dedup, op9_bpe_codec, op10_suffix_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.oracle(), "op6_license_scan": license_scan.oracle()}
