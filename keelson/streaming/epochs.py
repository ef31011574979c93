"""Streaming twins: count-based epochs, event-time windows, decayed counters.

Event-time aggregation uses watermarks; per-key decay is a stateful operator keyed by
page, so its state is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream.  Its timestamps carry no zone: they are read as the session's time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        stream = source.parquet(path)
    else:  # a stream reads folders: take the one file of its folder
        parent, name = path.rsplit("/", 1)
        stream = source.option("pathGlobFilter", name).parquet(parent)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value per window and type; windows close behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def epochs(events: DataFrame, size: int) -> DataFrame:
    """Requests and about how many distinct pages per count-based epoch."""
    return events.groupBy(F.expr(f"event_id div {size}").alias("epoch")).agg(F.count("*").alias("requests"), F.approx_count_distinct(F.expr("user_id div 8"), 0.01).alias("pages"))


def decay(key, frames: Iterator, state) -> Iterator:
    """Counter of one page: halved at each new epoch, then increased; late epochs add nothing back."""
    import pandas as pd

    epoch, count = state.get if state.exists else (0, 0)
    rows = pd.concat(list(frames))
    for e, n in rows.groupby("epoch").size().sort_index().items():
        count = (count >> max(0, int(e) - epoch)) + int(n)
        epoch = max(epoch, int(e))
    state.update((epoch, count))
    yield pd.DataFrame({"page_id": [key[0]], "epoch": [epoch], "aged": [count]})


def decayed(events: DataFrame, size: int) -> DataFrame:
    rows = events.selectExpr("user_id div 8 AS page_id", f"event_id div {size} AS epoch")
    return rows.groupBy("page_id").applyInPandasWithState(decay, "page_id bigint, epoch bigint, aged bigint", "epoch bigint, count bigint", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all input that is there, into an in-memory table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
