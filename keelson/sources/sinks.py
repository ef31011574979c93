"""Sinks with fixed headers: metric and analysis tables as CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the analysis files.
SHAPES = {
    "page_stats": ("page_id", "page_hits", "page_hit_ratio", "page_type", "max_slot_hits", "max_slot_ratio", "active_slots"),
    "slot_stats": ("page_id", "slot_id", "slot_hits", "slot_ratio_within_page", "page_type"),
    "admission": ("query_count", "threshold_coarse", "threshold_fine", "num_candidates", "global_requests"),
    "cache_hits": ("query_count", "record_cache_hit", "record_cache_miss", "dram_buffer_pool_hit", "cxl_buffer_pool_hit", "record_cache_hit_rate_pct"),
    "payload_sweep": ("payload_bytes", "entry_size", "on_page_size", "records_per_page", "total_records", "cache_capacity", "coverage_pct", "hit_ratio_pct"),
}


def append_metrics(df: DataFrame, path: str, t: str = "t", config: str = "c_hash") -> None:
    """Append metric rows, time and configuration hash first, as CSV with a header in each part."""
    df.select(t, config, *(c for c in df.columns if c not in (t, config))).write.mode("append").option("header", True).csv(path)


def write_shape(df: DataFrame, shape: str, path: str, fmt: str = "csv") -> None:
    """Write a table in one of the fixed shapes; missing columns are null."""
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SHAPES[shape]]
    df.select(*columns).write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as rows (value), colour codes stripped."""
    return spark.read.text(path).select(F.regexp_replace("value", "\x1b\\[[0-9;]*m", "").alias("value"))
