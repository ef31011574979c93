"""Streaming queries, drained over the input that is there; their batch twins are the SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.plans.registry import register
from keelson.streaming import epochs


def _name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex}"


@register("stream_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Daily windows that the watermark has closed."""
    out = epochs.drain(epochs.windowed(epochs.read_events(spark, sf_dir)), _name("windows"), "append")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", "total")


@register("stream_epochs", "SELECT event_id // 1000 AS epoch, count(*) AS requests FROM events GROUP BY 1")
def stream_epochs(spark, sf_dir):
    return epochs.drain(epochs.epochs(epochs.read_events(spark, sf_dir), 1000), _name("epochs"), "complete").select("epoch", "requests")


@register("stream_decay", "WITH c AS (SELECT user_id // 8 AS page_id, event_id // 1000 AS epoch, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT page_id, max(epoch) AS epoch FROM c GROUP BY 1), e AS (SELECT p.page_id, p.epoch, r.i, coalesce(c.n, 0) AS n FROM p JOIN range(0, (SELECT max(epoch) + 1 FROM c)) r(i) ON r.i <= p.epoch LEFT JOIN c ON c.page_id = p.page_id AND c.epoch = r.i) SELECT page_id, epoch, list_reduce(list(n ORDER BY i), lambda s, x: s // 2 + x) AS aged FROM e GROUP BY 1, 2")
def stream_decay(spark, sf_dir):
    """Page counters halved at every epoch, kept as streaming state; the last update of each page."""
    out = epochs.drain(epochs.decayed(epochs.read_events(spark, sf_dir), 1000), _name("decay"), "update")
    return out.groupBy("page_id").agg(F.max(F.struct("epoch", "aged")).alias("s")).select("page_id", "s.epoch", "s.aged")
