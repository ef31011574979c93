"""Queries over the version log: snapshots, isolation, conflicts, clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import versions
from keelson.operators.versions import VersionLog
from keelson.plans.registry import register
from keelson.sources.tables import transactions, with_sql

WITH = with_sql("tx")


def log(spark, sf_dir):
    return VersionLog(transactions(spark, sf_dir), ["k"], ["v"])


def latest(where: str, order: str = "commit_ts") -> str:
    return f"{WITH}, l AS (SELECT k, op, v, row_number() OVER (PARTITION BY k ORDER BY {order} DESC, command_id DESC) AS rn FROM tx WHERE {where}) SELECT k, v FROM l WHERE rn = 1 AND op <> 'D'"


@register("snapshot_si", latest("commit_ts < 5000"))
def snapshot_si(spark, sf_dir):
    return log(spark, sf_dir).snapshot(5000)


@register("snapshot_own_worker", latest("commit_ts < 5000 OR worker = 2", "coalesce(commit_ts, 4611686018427387904)"))
def snapshot_own_worker(spark, sf_dir):
    return log(spark, sf_dir).snapshot(5000, worker=2)


@register("snapshot_rc", latest("commit_ts IS NOT NULL"))
def snapshot_rc(spark, sf_dir):
    return log(spark, sf_dir).snapshot(level="rc")


@register("snapshot_ru", latest("true", "coalesce(commit_ts, 4611686018427387904)"))
def snapshot_ru(spark, sf_dir):
    return log(spark, sf_dir).snapshot(level="ru")


@register("aborted_invisible", f"{WITH} SELECT mode, count(*) AS n, count(commit_ts) AS visible FROM tx GROUP BY mode")
def aborted_invisible(spark, sf_dir):
    seen = log(spark, sf_dir).visible(level="rc").groupBy("mode").agg(F.count("*").alias("visible"))
    return log(spark, sf_dir).log.groupBy("mode").agg(F.count("*").alias("n")).join(seen, "mode")


@register("partial_updates", f"{WITH}, p AS (SELECT k, commit_ts, command_id, CASE WHEN command_id % 2 = 0 THEN v END AS a, CASE WHEN command_id % 3 = 0 THEN v END AS b FROM tx WHERE commit_ts < 6000) SELECT k, arg_max(a, (commit_ts, command_id)) FILTER (WHERE a IS NOT NULL) AS a, arg_max(b, (commit_ts, command_id)) FILTER (WHERE b IS NOT NULL) AS b FROM p GROUP BY k")
def partial_updates(spark, sf_dir):
    """Delta updates touch some columns; a snapshot takes each column's last setting."""
    tx = transactions(spark, sf_dir).selectExpr("k", "'U' AS op", "start_ts", "commit_ts", "worker", "command_id", "IF(command_id % 2 = 0, v, NULL) AS a", "IF(command_id % 3 = 0, v, NULL) AS b")
    return VersionLog(tx, ["k"], ["a", "b"]).snapshot(6000)


@register(
    "ww_conflicts",
    f"{WITH.replace('WITH', 'WITH RECURSIVE')}, w AS (SELECT k, command_id, start_ts, commit_ts, row_number() OVER (PARTITION BY k ORDER BY commit_ts, command_id) AS rn FROM tx WHERE commit_ts IS NOT NULL), "
    "f AS (SELECT k, rn, command_id, start_ts, commit_ts, commit_ts AS last, NULL::BIGINT AS blocked_by_ts FROM w WHERE rn = 1 UNION ALL SELECT w.k, w.rn, w.command_id, w.start_ts, w.commit_ts, CASE WHEN f.last > w.start_ts THEN f.last ELSE w.commit_ts END, CASE WHEN f.last > w.start_ts THEN f.last END FROM f JOIN w ON w.k = f.k AND w.rn = f.rn + 1) "
    "SELECT k, command_id, start_ts, commit_ts, blocked_by_ts FROM f WHERE blocked_by_ts IS NOT NULL",
)
def ww_conflicts(spark, sf_dir):
    return log(spark, sf_dir).conflicts()


CLOCK = "q AS (SELECT event_id AS command_id, event_id * 3 AS begin_seq, event_id * 3 + 1 + event_id % 7 * 2 AS end_seq, event_type = 'error' AS aborted FROM events), e AS (SELECT command_id, begin_seq AS seq, 0 AS kind FROM q UNION ALL SELECT command_id, end_seq, 1 FROM q WHERE NOT aborted), d AS (SELECT *, row_number() OVER (ORDER BY seq, kind, command_id) AS ts FROM e)"


@register("tx_timestamps", f"WITH {CLOCK} SELECT command_id, begin_seq, end_seq, aborted, max(ts) FILTER (WHERE kind = 0) AS start_ts, max(ts) FILTER (WHERE kind = 1) AS commit_ts FROM q JOIN d USING (command_id) GROUP BY 1, 2, 3, 4")
def tx_timestamps(spark, sf_dir):
    """Begin and commit draw from one clock; an abort draws nothing at its end."""
    asks = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS command_id", "event_id * 3 AS begin_seq", "event_id * 3 + 1 + event_id % 7 * 2 AS end_seq", "event_type = 'error' AS aborted")
    return versions.draw_timestamps(asks)


@register("fat_tuples", f"{WITH} SELECT k, count(*) AS updates, count(*) FILTER (WHERE commit_ts >= 5000) AS deltas, arg_max(v, (commit_ts, command_id)) FILTER (WHERE commit_ts < 5000) AS v FROM tx WHERE commit_ts IS NOT NULL GROUP BY k HAVING count(*) > 8")
def fat_tuples(spark, sf_dir):
    return log(spark, sf_dir).fat_tuples(8, 5000)


ENTRIES = f"{WITH}, e AS (SELECT worker, command_id, 0 AS step, 'TX_START' AS kind, NULL AS op, NULL AS payload FROM tx UNION ALL SELECT worker, command_id, 1, 'DT_SPECIFIC', op, k || '|' || CAST(floor(v) AS BIGINT) FROM tx UNION ALL SELECT worker, command_id, 2, CASE WHEN commit_ts IS NULL THEN 'TX_ABORT' ELSE 'TX_COMMIT' END, NULL, NULL FROM tx)"


@register("wal_entries", f"{ENTRIES} SELECT worker, command_id, kind, op, payload, row_number() OVER (PARTITION BY worker ORDER BY command_id, step) AS lsn, CAST(32 + coalesce(strlen(payload), 0) AS INTEGER) AS size, true AS intact FROM e")
def wal_entries(spark, sf_dir):
    """Every worker's log, its entries checked; the checksums themselves are tested against another CRC-32."""
    tx = transactions(spark, sf_dir).withColumn("v", F.floor("v").cast("bigint"))
    return versions.checked(versions.wal_entries(tx, ["k", "v"])).drop("crc")


@register("chain_length", f"{WITH} SELECT k, 1 + count(*) FILTER (WHERE commit_ts >= 7000) AS chain_length FROM tx WHERE commit_ts IS NOT NULL GROUP BY k")
def chain_length(spark, sf_dir):
    return log(spark, sf_dir).chain_length(7000)


@register("diff_roundtrip", f"{WITH} SELECT k, command_id, CAST(floor(v) AS BIGINT) AS new_value, coalesce(lag(CAST(floor(v) AS BIGINT)) OVER (PARTITION BY k ORDER BY command_id), 0) AS old_value, true AS restored FROM tx")
def diff_roundtrip(spark, sf_dir):
    """XOR deltas undo themselves: new ^ delta is the value before."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("command_id")
    v = F.floor("v").cast("bigint")
    rows = transactions(spark, sf_dir).withColumn("new_value", v).withColumn("old_value", F.coalesce(F.lag("new_value").over(w), F.lit(0)))
    delta = F.col("new_value").bitwiseXOR(F.col("old_value"))
    return rows.select("k", "command_id", "new_value", "old_value", (F.col("new_value").bitwiseXOR(delta) == F.col("old_value")).alias("restored"))


@register("watermarks", f"{WITH} SELECT min(start_ts) AS oldest_any, min(start_ts) FILTER (WHERE mode = 'OLTP') AS oldest_oltp, max(start_ts) FILTER (WHERE mode = 'OLAP') AS newest_olap FROM tx WHERE start_ts <= 800 AND (commit_ts IS NULL OR commit_ts > 800)")
def watermarks(spark, sf_dir):
    return versions.watermarks(transactions(spark, sf_dir), F.lit(800))


@register("worker_low_water", f"{WITH} SELECT worker, min(start_ts) AS low_water FROM tx WHERE start_ts <= 800 AND (commit_ts IS NULL OR commit_ts > 800) GROUP BY worker")
def worker_low_water(spark, sf_dir):
    tx = transactions(spark, sf_dir).where("start_ts <= 800 AND (commit_ts IS NULL OR commit_ts > 800)")
    return tx.groupBy("worker").agg(F.min("start_ts").alias("low_water"))


@register("gc_purge", f"{WITH}, n AS (SELECT k, command_id, commit_ts, lead(commit_ts) OVER (PARTITION BY k ORDER BY commit_ts, command_id) AS nx FROM tx WHERE commit_ts IS NOT NULL) SELECT k, command_id, commit_ts FROM n WHERE nx IS NULL OR nx >= 4000")
def gc_purge(spark, sf_dir):
    return log(spark, sf_dir).purge(4000).select("k", "command_id", "commit_ts")


@register("graveyard_classify", f"{WITH}, l AS (SELECT k, op, commit_ts, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC, command_id DESC) AS rn FROM tx WHERE commit_ts IS NOT NULL) SELECT k, commit_ts, CASE WHEN commit_ts < least(9000, 5000) THEN 'drop' WHEN commit_ts < 9000 THEN 'graveyard' ELSE 'keep' END AS fate FROM l WHERE rn = 1 AND op = 'D'")
def graveyard_classify(spark, sf_dir):
    return log(spark, sf_dir).classify_tombstones(9000, 5000)


@register(
    "compaction",
    f"{WITH}, s AS (SELECT *, (commit_ts < 3000)::INT + (commit_ts < 6000)::INT + (commit_ts < 9000)::INT AS slot FROM tx WHERE commit_ts IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY k, slot ORDER BY commit_ts DESC, command_id DESC) AS rn FROM s) SELECT k, command_id, commit_ts FROM r WHERE slot = 0 OR rn = 1",
)
def compaction(spark, sf_dir):
    return log(spark, sf_dir).compact([3000, 6000, 9000])


@register("olap_merge_scan", f"{WITH}, l AS (SELECT k, op, commit_ts, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC, command_id DESC) AS rn FROM tx WHERE commit_ts < 6000) SELECT k, commit_ts, CASE WHEN op = 'D' THEN 'graveyard' ELSE 'live' END AS side FROM l WHERE rn = 1")
def olap_merge_scan(spark, sf_dir):
    return log(spark, sf_dir).merged_scan(6000)


@register("graveyard_two_snapshots", "SELECT count(*) AS before_delete, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS after_delete FROM orders")
def graveyard_two_snapshots(spark, sf_dir):
    """Half of the keys are deleted; the old snapshot still sees all of them, the new one the rest."""
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_totalprice AS v")
    born = base.selectExpr("k", "v", "'I' AS op", "0L AS start_ts", "1L AS commit_ts", "0 AS worker", "k AS command_id")
    dead = base.where("k % 2 = 0").selectExpr("k", "CAST(NULL AS DOUBLE) AS v", "'D' AS op", "2L AS start_ts", "10L AS commit_ts", "0 AS worker", "k AS command_id")
    both = VersionLog(born.unionByName(dead), ["k"], ["v"])
    old, new = (both.snapshot(ts).agg(F.count("*").alias(n)) for ts, n in ((5, "before_delete"), (20, "after_delete")))
    return old.crossJoin(new)


@register("group_commit_ready", f"{WITH} SELECT worker, count(*) AS n, count(*) FILTER (WHERE start_ts % 5 <> 0 OR (commit_ts <= (SELECT min(f) FROM (SELECT worker, max(commit_ts) - 100 AS f FROM tx GROUP BY worker)) AND start_ts <= (SELECT min(f) FROM (SELECT worker, max(commit_ts) - 200 AS f FROM tx GROUP BY worker)))) AS durable FROM tx WHERE commit_ts IS NOT NULL GROUP BY worker")
def group_commit_ready(spark, sf_dir):
    tx = transactions(spark, sf_dir).withColumn("remote_dependency", F.expr("start_ts % 5 = 0"))
    flushed = tx.groupBy("worker").agg((F.max("commit_ts") - 100).alias("flushed_ts"), (F.max("commit_ts") - 200).alias("hardened_ts"))
    return versions.durable(tx, flushed).groupBy("worker").agg(F.count("*").alias("n"), F.count(F.when(F.col("durable"), 1)).alias("durable"))


@register("graveyard_fallback", f"{WITH}, l AS (SELECT k, op, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC, command_id DESC) AS rn FROM tx WHERE commit_ts < 6000) SELECT c_custkey, CASE WHEN op IS NULL THEN 'not_found' WHEN op = 'D' THEN 'removed' ELSE 'found' END AS state FROM customer LEFT JOIN l ON k = c_custkey AND rn = 1")
def graveyard_fallback(spark, sf_dir):
    """Existence check of keys against live rows first, then tombstones."""
    seen = log(spark, sf_dir).merged_scan(6000)
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    state = F.when(F.col("side").isNull(), "not_found").when(F.col("side") == "graveyard", "removed").otherwise("found")
    return keys.join(seen, F.col("k") == F.col("c_custkey"), "left").select("c_custkey", state.alias("state"))


@register("log_replay", f"{WITH}, l AS (SELECT k, op, v, row_number() OVER (PARTITION BY k ORDER BY command_id DESC) AS rn FROM tx WHERE commit_ts IS NOT NULL) SELECT k, v FROM l WHERE rn = 1 AND op <> 'D'")
def log_replay(spark, sf_dir):
    """Recovery: committed log records applied in log order."""
    done = transactions(spark, sf_dir).where("commit_ts IS NOT NULL").withColumn("commit_ts", F.col("command_id"))
    return VersionLog(done, ["k"], ["v"]).snapshot(level="rc")


@register("log_records", f"{WITH} SELECT worker, op, count(*) AS records, count(commit_ts) AS committed FROM tx GROUP BY 1, 2")
def log_records(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy("worker", "op").agg(F.count("*").alias("records"), F.count("commit_ts").alias("committed"))


@register("history_lookup", f"{WITH} SELECT worker, start_ts, command_id, op, v FROM tx WHERE worker = 3 AND start_ts BETWEEN 100 AND 400")
def history_lookup(spark, sf_dir):
    """Versions of one worker in a range of transactions."""
    return transactions(spark, sf_dir).where("worker = 3 AND start_ts BETWEEN 100 AND 400").select("worker", "start_ts", "command_id", "op", "v")


@register("update_diffs", f"{WITH}, d AS (SELECT k, command_id, v AS new_value, lag(v) OVER (PARTITION BY k ORDER BY command_id) AS old_value FROM tx) SELECT * FROM d WHERE old_value IS NOT NULL AND old_value <> new_value")
def update_diffs(spark, sf_dir):
    """Before and after images of every update that changes its row."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("command_id")
    rows = transactions(spark, sf_dir).select("k", "command_id", F.col("v").alias("new_value"), F.lag("v").over(w).alias("old_value"))
    return rows.where("old_value IS NOT NULL AND old_value <> new_value")


@register("bulk_visible", "SELECT count(*) AS n FROM orders")
def bulk_visible(spark, sf_dir):
    """Bulk-loaded rows carry timestamp 0 and are visible to every snapshot."""
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_totalprice AS v", "'I' AS op", "0L AS start_ts", "0L AS commit_ts", "0 AS worker", "o_orderkey AS command_id")
    return VersionLog(base, ["k"], ["v"]).snapshot(1).agg(F.count("*").alias("n"))
