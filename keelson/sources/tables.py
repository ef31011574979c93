"""Input tables, and the fixtures derived from them: access streams, version log, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accesses(spark: SparkSession, sf_dir: str, per_page: int = 16) -> DataFrame:
    """Unordered accesses: (rec, page_id, slot_id)."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS rec", f"l_partkey div {per_page} AS page_id", f"l_partkey % {per_page} AS slot_id")


def access_sequence(spark: SparkSession, sf_dir: str, window: int = 1000, per_page: int = 8) -> DataFrame:
    """Ordered accesses with count-based epochs: (seq, ts, rec, page_id, slot_id, epoch, event_type)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "ts", "user_id AS rec", f"user_id div {per_page} AS page_id", f"user_id % {per_page} AS slot_id",
        f"event_id div {window} AS epoch", "event_type",
    )


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, commit_ts, op, v): one version per event."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS k", "event_id AS commit_ts", "IF(event_type = 'error', 'D', 'U') AS op", "value AS v")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, v, op, start_ts, commit_ts, worker, mode, command_id); commit_ts is null for aborted ones."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS k", "value AS v", "IF(event_type = 'error', 'D', 'U') AS op", "event_id AS start_ts",
        "IF(event_id % 13 = 0, NULL, event_id + 1 + event_id % 7) AS commit_ts", "user_id % 4 AS worker",
        "IF(event_id % 50 = 0, 'OLAP', 'OLTP') AS mode", "event_id AS command_id",
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(us): one latency in microseconds per lineitem."""
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("us"))


#: The same fixtures as DuckDB common table expressions.
SQL = {
    "acc": "acc AS (SELECT l_partkey AS rec, l_partkey // 16 AS page_id, l_partkey % 16 AS slot_id FROM lineitem)",
    "acc_seq": "acc_seq AS (SELECT event_id AS seq, ts, user_id AS rec, user_id // 8 AS page_id, user_id % 8 AS slot_id, event_id // 1000 AS epoch, event_type FROM events)",
    "vlog": "vlog AS (SELECT user_id AS k, event_id AS commit_ts, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, value AS v FROM events)",
    "tx": "tx AS (SELECT user_id AS k, value AS v, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, event_id AS start_ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id + 1 + event_id % 7 END AS commit_ts, user_id % 4 AS worker, CASE WHEN event_id % 50 = 0 THEN 'OLAP' ELSE 'OLTP' END AS mode, event_id AS command_id FROM events)",
    "lat": "lat AS (SELECT CAST(floor(l_extendedprice / 100) AS BIGINT) AS us FROM lineitem)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
