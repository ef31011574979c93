"""Corpus pipeline: quality rules, near-dedup, decontamination, secret masking, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written
as Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``; further columns are dropped.

Defined results: an empty table goes through every stage as one.  A null text counts as
empty, so the quality rules reject it; the other stages, run alone, keep it as it is but
for one of several empty ones in near-dedup, and secret masking and encoding make it the
empty text.  Rows with a null ``doc_id`` are treated like others; near-dedup prefers a row
with an id.  Of equal rows one stays in near-dedup, and rows that share an id are
different documents.  Very long texts are handled whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, quality_rules, secret_scan, simhash_dedup
from keelson.llm.decontaminate import BROADCAST_ROWS, contaminated_texts
from keelson.llm.shared import counted, release_all, stage, staging, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule table rejects go."""
    return docs.select(*COLUMNS).where(quality_rules.verdict(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id: SimHash proposes pairs,
    five-word shingles with a similarity of 0.8 or more decide."""
    return simhash_dedup.keep_one(spark, docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(*COLUMNS, text_key(F.col("text")).alias("__key"))
    found = contaminated_texts(spark, docs.select("text"), benchmark).select(F.col("text_key").alias("__key")).distinct()
    found = counted(spark, found, "leaked", BROADCAST_ROWS)
    return keyed.join(found, "__key", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is masked; ``n_chars`` follows."""
    found = secret_scan.scan(docs.select(*COLUMNS))
    masked = F.when(F.col("spans") == "", F.col("text")).otherwise(F.col("redacted"))
    length = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return found.select("doc_id", masked.alias("text"), "lang", "source", length.alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text that they decode to."""
    return bpe.digests(docs.select(*COLUMNS), with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secrets),
    ("bpe_encode", encode),
]

#: SQL has no byte-pair encoding and no SimHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with staging() as held:
        for name, step in STAGES[:-1]:
            docs, path = stage(spark, step(spark, docs, sf_dir), name)
            release_all(spark, held, path)  # what the stage has staged on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
