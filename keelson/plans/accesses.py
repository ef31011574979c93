"""Queries over access streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.functions.generators import shard
from keelson.operators import access, simulate
from keelson.plans.generating import FNV
from keelson.plans.registry import register
from keelson.sources.tables import access_sequence, accesses, table, with_sql

ACC, SEQ = with_sql("acc"), with_sql("acc_seq")
LOG2 = "least(length(bin({0})) - 1, 15)"
PAGES = f"{ACC}, pages AS (SELECT page_id, count(*) AS n FROM acc GROUP BY 1), keyed AS (SELECT *, {LOG2.format('n')} AS bucket FROM pages), hist AS (SELECT bucket, count(*) AS keys FROM keyed GROUP BY 1)"


def pages(spark, sf_dir):
    return accesses(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"))


@register("exact_freq", f"{ACC} SELECT rec, count(*) AS n FROM acc GROUP BY rec")
def exact_freq(spark, sf_dir):
    return accesses(spark, sf_dir).groupBy("rec").agg(F.count("*").alias("n"))


@register("cms_bounds", f"{ACC} SELECT rec, count(*) AS n, true AS never_below FROM acc GROUP BY rec")
def cms_bounds(spark, sf_dir):
    """Sketch estimates are never below the true count."""
    stream = accesses(spark, sf_dir)
    exact = stream.groupBy("rec").agg(F.count("*").alias("n"))
    guessed = access.estimate(exact, "rec", access.count_min(stream, "rec"))
    return guessed.select("rec", "n", (F.col("estimate") >= F.col("n")).alias("never_below"))


@register("cms_error")
def cms_error(spark, sf_dir):
    """Overestimates of the sketch: mean and tail, on used and on never used keys (values depend on the hash)."""
    stream = accesses(spark, sf_dir)
    used = stream.groupBy("rec").agg(F.count("*").alias("n"))
    top = used.agg(F.max("rec")).first()[0] or 0
    ghosts = spark.range(top + 1, top + 1001).select(F.col("id").alias("rec"), F.lit(0).cast("bigint").alias("n"))
    guessed = access.estimate(used.unionByName(ghosts), "rec", access.count_min(stream, "rec"))
    over = F.col("estimate") - F.col("n")
    return guessed.groupBy((F.col("n") > 0).alias("used")).agg(
        F.count("*").alias("keys"), F.avg(over).alias("mean_over"), F.percentile(over, 0.95).alias("p95_over"), F.max(over).alias("max_over")
    )


#: Every page in every epoch of the stream, with its uses there.
GRID = f"{SEQ}, top AS (SELECT max(epoch) AS t FROM acc_seq), e AS (SELECT p.page_id, r.epoch, count(a.seq) AS n FROM (SELECT DISTINCT page_id FROM acc_seq) p CROSS JOIN (SELECT unnest(range(0, t + 1)) AS epoch FROM top) r LEFT JOIN acc_seq a ON a.page_id = p.page_id AND a.epoch = r.epoch GROUP BY ALL)"


@register("cms_aging", f"{GRID} SELECT page_id, list_reduce(list(n ORDER BY epoch), lambda s, c: s // 2 + c) AS aged FROM e GROUP BY page_id")
def cms_aging(spark, sf_dir):
    return access.aged_counts(access_sequence(spark, sf_dir), "page_id", "epoch")


@register("page_clock", f"{SEQ}, u AS (SELECT page_id, (SELECT max(epoch) FROM acc_seq) - max(epoch) AS idle FROM acc_seq GROUP BY page_id) SELECT page_id, idle, CASE WHEN idle = 0 THEN 'HOT' ELSE 'COOL' END AS state, CASE WHEN idle <= 1 THEN 'DRAM' WHEN idle <= 3 THEN 'CXL' ELSE 'SSD' END AS tier FROM u")
def page_clock(spark, sf_dir):
    return access.page_clock(access_sequence(spark, sf_dir), "page_id", "epoch")


@register("sketch_bounds", f"{ACC}, r AS (SELECT page_id, slot_id, count(*) AS n FROM acc GROUP BY 1, 2) SELECT 'page' AS sketch, count(*) AS keys, 0::BIGINT AS below FROM (SELECT page_id FROM r GROUP BY 1) UNION ALL SELECT 'record', count(*), 0 FROM r")
def sketch_bounds(spark, sf_dir):
    """Page and record sketches in the sizes they are used in: no estimate is below the true count."""
    stream, out = accesses(spark, sf_dir), None
    for name, key, (rows, cols) in (("page", ["page_id"], access.PAGE_SKETCH), ("record", ["page_id", "slot_id"], access.RECORD_SKETCH)):
        exact = stream.groupBy(*key).agg(F.count("*").alias("n"))
        guessed = access.estimate(exact, key, access.count_min(stream, key, rows, cols), rows, cols)
        one = guessed.agg(F.lit(name).alias("sketch"), F.count("*").alias("keys"), F.count(F.when(F.col("estimate") < F.col("n"), 1)).alias("below"))
        out = one if out is None else out.unionByName(one)
    return out


@register("first_n_distinct", f"{SEQ}, f AS (SELECT epoch, page_id, min(seq) AS first_seq FROM acc_seq GROUP BY 1, 2) SELECT epoch, page_id, first_seq FROM f QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY first_seq) <= 6")
def first_n_distinct(spark, sf_dir):
    return access.first_distinct(access_sequence(spark, sf_dir), "page_id", "epoch", "seq", 6).drop("place")


@register("epoch_windows", f"{SEQ} SELECT epoch, count(*) AS requests, count(DISTINCT page_id) AS pages, count(*) >= 1000 AS triggers FROM acc_seq GROUP BY epoch")
def epoch_windows(spark, sf_dir):
    rows = access_sequence(spark, sf_dir).groupBy("epoch").agg(F.count("*").alias("requests"), F.countDistinct("page_id").alias("pages"))
    return rows.withColumn("triggers", F.col("requests") >= 1000)


@register("log2_hist", f"{PAGES} SELECT CAST(bucket AS INTEGER) AS bucket, keys FROM hist")
def log2_hist(spark, sf_dir):
    return access.histogram(pages(spark, sf_dir), "n")


@register("rev_cumulative", f"{PAGES} SELECT CAST(bucket AS INTEGER) AS bucket, keys, CAST(sum(keys) OVER (ORDER BY bucket DESC) AS BIGINT) AS at_least FROM hist")
def rev_cumulative(spark, sf_dir):
    return access.reverse_cumulative(access.histogram(pages(spark, sf_dir), "n"))


@register("hist_aging", f"{PAGES} SELECT CAST(bucket - 1 AS INTEGER) AS bucket, keys FROM hist WHERE bucket >= 1")
def hist_aging(spark, sf_dir):
    return access.aged_histogram(access.histogram(pages(spark, sf_dir), "n"))


THRESHOLD = (
    ", cum AS (SELECT {g} bucket, keys, sum(keys) OVER (PARTITION BY {p} ORDER BY bucket DESC) AS cum, greatest(1, floor(sum(keys) OVER (PARTITION BY {p}) * 1 / 4)) AS target FROM hist), "
    "crit AS (SELECT {g} bucket, target - (cum - keys) AS rest, keys, 1::BIGINT << bucket::INTEGER AS coarse FROM cum WHERE cum >= target QUALIFY row_number() OVER (PARTITION BY {p} ORDER BY bucket DESC) = 1), "
    "rk AS (SELECT c.*, n, row_number() OVER (PARTITION BY {cp} ORDER BY n DESC) AS rn FROM crit c JOIN keyed k ON k.bucket = c.bucket {j}) "
    "SELECT {g} coarse, CAST(CASE WHEN rest < keys THEN n ELSE coarse END AS BIGINT) AS fine FROM rk WHERE rn = rest"
)


@register("thresholds", PAGES + THRESHOLD.format(g="", p="1", cp="1", j=""))
def thresholds(spark, sf_dir):
    """Coarse and fine admission thresholds for a fast tier of one part in four."""
    return access.thresholds(pages(spark, sf_dir), "n", 1, 3)


@register("epoch_thresholds", f"{SEQ}, pages AS (SELECT epoch, page_id, count(*) AS n FROM acc_seq GROUP BY 1, 2), keyed AS (SELECT *, {LOG2.format('n')} AS bucket FROM pages), hist AS (SELECT epoch, bucket, count(*) AS keys FROM keyed GROUP BY 1, 2)" + THRESHOLD.format(g="epoch,", p="epoch", cp="c.epoch", j="AND k.epoch = c.epoch").replace("c.*, n", "c.*, k.n"))
def epoch_thresholds(spark, sf_dir):
    counts = access_sequence(spark, sf_dir).groupBy("epoch", "page_id").agg(F.count("*").alias("n"))
    return access.thresholds(counts, "n", 1, 3, ["epoch"])


@register("admit_pages", f"{PAGES}, t AS (SELECT max(1::BIGINT << bucket::INTEGER) AS coarse FROM (SELECT bucket, sum(keys) OVER (ORDER BY bucket DESC) AS cum, greatest(1, floor(sum(keys) OVER () / 4)) AS target FROM hist) WHERE cum >= target) SELECT page_id, n FROM pages, t WHERE n >= coarse")
def admit_pages(spark, sf_dir):
    counts = pages(spark, sf_dir)
    limit = access.thresholds(counts, "n", 1, 3).select("coarse")
    return counts.crossJoin(F.broadcast(limit)).where("n >= coarse").select("page_id", "n")


@register("histogram_report", f"{PAGES}, c AS (SELECT bucket, keys, sum(keys) OVER (ORDER BY bucket) AS upto, sum(keys) OVER (ORDER BY bucket DESC) AS down, sum(keys) OVER () AS total FROM hist), t AS (SELECT max(bucket) AS b FROM c WHERE down >= greatest(1, floor(total / 4))) SELECT CAST(bucket AS INTEGER) AS bucket, CASE WHEN bucket = 0 THEN '[1]' ELSE '[' || (1::BIGINT << bucket::INTEGER) || ', ' || ((2::BIGINT << bucket::INTEGER) - 1) || ']' END AS visit_range, keys, CAST(upto AS BIGINT) AS cumulative, round(100.0 * keys / total, 1) AS pct, repeat('█', CAST(50 * keys // total AS INTEGER)) AS bar, CASE WHEN bucket = b THEN '<- THRESHOLD' ELSE '' END AS marker FROM c, t")
def histogram_report(spark, sf_dir):
    """The histogram as it is printed: ranges, cumulative counts, shares, bars, and the coarse threshold's bucket."""
    counts = pages(spark, sf_dir)
    hist = access.histogram(counts, "n")
    whole, upto = Window.partitionBy(), Window.orderBy("bucket")
    low = F.pow(F.lit(2), F.col("bucket")).cast("bigint")
    coarse = access.thresholds(counts, "n", 1, 3).select("coarse")
    rows = hist.withColumn("total", F.sum("keys").over(whole)).withColumn("cumulative", F.sum("keys").over(upto)).join(F.broadcast(coarse), how="left")
    return rows.select(
        "bucket", F.when(F.col("bucket") == 0, "[1]").otherwise(F.concat(F.lit("["), low, F.lit(", "), 2 * low - 1, F.lit("]"))).alias("visit_range"), "keys", "cumulative",
        F.round(100.0 * F.col("keys") / F.col("total"), 1).alias("pct"), F.expr("repeat('█', CAST(50 * keys div total AS INT))").alias("bar"),
        F.when(low == F.col("coarse"), "<- THRESHOLD").otherwise("").alias("marker"),
    )


@register("dyn_threshold", "SELECT i, f, CASE WHEN i = 0 THEN 0 ELSE greatest(2, CAST(ceil(i * (0.25 + 0.75 * least(greatest(f / 4.0, 0), 1))) AS BIGINT)) END AS threshold FROM range(0, 20) a(i), range(0, 6) b(f)")
def dyn_threshold(spark, sf_dir):
    grid = spark.range(20).select(F.col("id").alias("i")).crossJoin(spark.range(6).select(F.col("id").alias("f")))
    return grid.select("i", "f", access.dynamic_threshold(F.col("i"), F.col("f") / 4.0).cast("bigint").alias("threshold"))


@register("first_crossing", f"{SEQ} SELECT epoch, page_id, seq AS admit_seq FROM acc_seq QUALIFY row_number() OVER (PARTITION BY epoch, page_id ORDER BY seq) = 50")
def first_crossing(spark, sf_dir):
    return access.first_crossing(access_sequence(spark, sf_dir), "page_id", "epoch", "seq", 50)


@register("page_slot_stats", f"{SEQ}, a AS (SELECT epoch, page_id, seq AS admit_seq FROM acc_seq QUALIFY row_number() OVER (PARTITION BY epoch, page_id ORDER BY seq) = 50) SELECT epoch, page_id, count(*) AS visits, count(DISTINCT slot_id) AS slots FROM acc_seq JOIN a USING (epoch, page_id) WHERE seq >= admit_seq GROUP BY 1, 2")
def page_slot_stats(spark, sf_dir):
    """Accounting of a candidate page from its admission on."""
    stream = access_sequence(spark, sf_dir)
    admitted = access.first_crossing(stream, "page_id", "epoch", "seq", 50)
    return stream.join(admitted, ["epoch", "page_id"]).where("seq >= admit_seq").groupBy("epoch", "page_id").agg(F.count("*").alias("visits"), F.countDistinct("slot_id").alias("slots"))


def rules_sql(t: int, visits: int, scan: bool) -> str:
    even = "true" if scan else "top <= skew_at"
    hot = "false" if scan else f"top >= {t}"
    last = "full_scan" if scan else "none"
    return f"""{ACC}, s AS (SELECT page_id, slot_id, count(*) AS n FROM acc GROUP BY 1, 2),
p AS (SELECT page_id, CAST(sum(n) AS BIGINT) AS visits, count(*) AS n_slots, max(n) AS top, CAST(greatest(1, ceil(sum(n) * 0.10::DOUBLE)) AS BIGINT) AS skew_at FROM s GROUP BY 1),
r AS (SELECT *, CASE WHEN {hot} THEN 'hot_records' WHEN visits >= {visits} AND {even} THEN 'full_visits' WHEN n_slots >= 8 AND {even} THEN 'full_slots' WHEN top > skew_at THEN 'skew' ELSE '{last}' END AS rule FROM p),
c AS (SELECT r.page_id, count(*) FILTER (WHERE (rule = 'hot_records' AND n >= {t}) OR (rule = 'skew' AND n > skew_at)) AS k FROM r JOIN s USING (page_id) GROUP BY 1)
SELECT page_id, visits, n_slots, skew_at, rule, CASE WHEN rule LIKE 'full%' THEN 16 ELSE k END AS promoted, rule LIKE 'full%' OR (rule = 'skew' AND k = n_slots) AS leaves_candidates FROM r JOIN c USING (page_id)"""


@register("promotion_rules", rules_sql(50, 500, False))
def promotion_rules(spark, sf_dir):
    return access.promotion(access.slot_counts(accesses(spark, sf_dir)), 50, 500, 16)


@register("promotion_rules_strict", rules_sql(1000, 480, False))
def promotion_rules_strict(spark, sf_dir):
    return access.promotion(access.slot_counts(accesses(spark, sf_dir)), 1000, 480, 16)


@register("promotion_scan_mode", rules_sql(50, 500, True))
def promotion_scan_mode(spark, sf_dir):
    return access.promotion(access.slot_counts(accesses(spark, sf_dir)), 50, 500, 16, scan_mode=True)


@register("lru_topk", f"{SEQ}, l AS (SELECT epoch, page_id, max(seq) AS last_seq FROM acc_seq GROUP BY 1, 2) SELECT epoch, page_id, last_seq FROM l QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY last_seq DESC) <= 5")
def lru_topk(spark, sf_dir):
    """The most recent pages of every cycle, a batch of five."""
    last = access_sequence(spark, sf_dir).groupBy("epoch", "page_id").agg(F.max("seq").alias("last_seq"))
    w = Window.partitionBy("epoch").orderBy(F.col("last_seq").desc())
    return last.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@register("page_only_admission", f"{SEQ}, l AS (SELECT epoch, page_id, max(seq) AS last_seq, count(*) AS n FROM acc_seq GROUP BY 1, 2) SELECT epoch, page_id, n FROM l WHERE n >= 40 QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY last_seq DESC) <= 8")
def page_only_admission(spark, sf_dir):
    last = access_sequence(spark, sf_dir).groupBy("epoch", "page_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n")).where("n >= 40")
    w = Window.partitionBy("epoch").orderBy(F.col("last_seq").desc())
    return last.withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("epoch", "page_id", "n")


@register("dynamic_ceiling", "WITH h AS (SELECT sum(pow(i, -0.9)) FILTER (WHERE i <= 2000) AS hd, sum(pow(i, -0.9)) AS hn FROM range(1, 10001) r(i)) SELECT least(CAST(ceil(1000000 * (hd / hn) / 2000) AS BIGINT), 1000) AS ceiling FROM h")
def dynamic_ceiling(spark, sf_dir):
    """Visits a page can be expected to get at most: window x share of the fast tier / its pages."""
    both = access.harmonic(spark, 2000, 0.9).select(F.col("h").alias("hd")).crossJoin(access.harmonic(spark, 10000, 0.9))
    return both.select(F.least(F.ceil(1000000 * (F.col("hd") / F.col("h")) / 2000).cast("bigint"), F.lit(1000).cast("bigint")).alias("ceiling"))


@register("unpromote", f"{SEQ} SELECT page_id, slot_id, NOT arg_max(event_type = 'purchase', seq) AS promoted FROM acc_seq WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2")
def unpromote(spark, sf_dir):
    """A view promotes a slot, a purchase (an update) takes it back: the last event wins."""
    rows = access_sequence(spark, sf_dir).where("event_type IN ('purchase', 'view')")
    return rows.groupBy("page_id", "slot_id").agg((~F.max_by(F.col("event_type") == "purchase", "seq")).alias("promoted"))


@register("cache_intervals", f"{SEQ} SELECT rec, seq AS valid_from, lead(seq) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY rec ORDER BY seq) AS never FROM acc_seq WHERE false UNION ALL SELECT rec, seq, (SELECT min(u.seq) FROM acc_seq u WHERE u.rec = a.rec AND u.seq > a.seq AND u.event_type = 'purchase') FROM acc_seq a WHERE event_type = 'signup'".replace("SELECT rec, seq AS valid_from, lead(seq) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY rec ORDER BY seq) AS never FROM acc_seq WHERE false UNION ALL SELECT rec, seq, (", "SELECT rec, seq AS valid_from, (").replace("u.event_type = 'purchase') FROM", "u.event_type = 'purchase') AS valid_to FROM"))
def cache_intervals(spark, sf_dir):
    """A cached copy is valid from its promotion (here a signup) to the next update (a purchase)."""
    w = Window.partitionBy("rec").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = access_sequence(spark, sf_dir).where("event_type IN ('signup', 'purchase')")
    marked = rows.withColumn("valid_to", F.min(F.when(F.col("event_type") == "purchase", F.col("seq"))).over(w))
    return marked.where("event_type = 'signup'").select("rec", F.col("seq").alias("valid_from"), "valid_to")


@register("cache_lookups", f"{SEQ}, s AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN seq END) OVER w AS promoted, max(CASE WHEN event_type = 'purchase' THEN seq END) OVER w AS updated FROM acc_seq WINDOW w AS (PARTITION BY rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT epoch, count(*) AS lookups, count(*) FILTER (WHERE promoted IS NOT NULL AND promoted > coalesce(updated, -1)) AS hits FROM s WHERE event_type = 'view' GROUP BY epoch")
def cache_lookups(spark, sf_dir):
    """A view hits if the record was promoted after its last update."""
    w = Window.partitionBy("rec").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("seq"))).over(w)
    rows = access_sequence(spark, sf_dir).withColumn("promoted", last("signup")).withColumn("updated", last("purchase"))
    hit = F.col("promoted").isNotNull() & (F.col("promoted") > F.coalesce("updated", F.lit(-1)))
    return rows.where("event_type = 'view'").groupBy("epoch").agg(F.count("*").alias("lookups"), F.count(F.when(hit, 1)).alias("hits"))


#: Entry states and what an event makes of them.
TRANSITIONS = (
    ("absent", "promote", "promoting"), ("promoting", "publish", "read_only"), ("read_only", "update", "deleted"),
    ("promoting", "update", "deleted"), ("deleted", "reclaim", "unlinked"), ("unlinked", "promote", "promoting"),
)


@register("state_machine", "SELECT k, CASE WHEN e = 0 THEN 'promoting' WHEN e = 1 THEN 'deleted' ELSE 'refused' END AS next_state, count(*) AS n FROM (SELECT user_id % 3 AS k, CASE WHEN event_type = 'signup' AND user_id % 3 IN (0, 2) THEN 0 WHEN event_type = 'purchase' AND user_id % 3 = 1 THEN 1 ELSE 2 END AS e FROM events WHERE event_type IN ('signup', 'purchase')) GROUP BY 1, 2")
def state_machine(spark, sf_dir):
    """Events met with the transition table; a missing transition is refused."""
    names = F.array(F.lit("absent"), F.lit("read_only"), F.lit("unlinked"))
    rows = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')")
    rows = rows.select((F.col("user_id") % 3).alias("k"), F.when(F.col("event_type") == "signup", "promote").otherwise("update").alias("event"))
    rows = rows.withColumn("state", F.element_at(names, (F.col("k") + 1).cast("int")))
    steps = spark.createDataFrame(list(TRANSITIONS), "state string, event string, next_state string")
    met = rows.join(F.broadcast(steps), ["state", "event"], "left")
    return met.groupBy("k", F.coalesce("next_state", F.lit("refused")).alias("next_state")).agg(F.count("*").alias("n"))


@register("dead_drain", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 12")
def dead_drain(spark, sf_dir):
    """The oldest dead entries of each shard, up to a limit."""
    dead = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 16).alias("shard"))
    w = Window.partitionBy("shard").orderBy("event_id")
    return dead.withColumn("rn", F.row_number().over(w)).where("rn <= 12").select("event_id")


@register("eviction_policy", "SELECT shard, used, dead, CASE WHEN used / 400.0 >= 0.95 THEN 'evict_batch' WHEN dead >= 60 THEN 'drain_dead' ELSE 'idle' END AS action FROM (SELECT user_id % 25 AS shard, count(*) AS used, count(*) FILTER (WHERE event_type = 'error') AS dead FROM events GROUP BY 1)")
def eviction_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25).alias("shard")).agg(F.count("*").alias("used"), F.count(F.when(F.col("event_type") == "error", 1)).alias("dead"))
    action = F.when(F.col("used") / 400.0 >= 0.95, "evict_batch").when(F.col("dead") >= 60, "drain_dead").otherwise("idle")
    return rows.withColumn("action", action)


@register("promotion_intake", "WITH live AS (SELECT DISTINCT user_id AS rec FROM events WHERE event_type = 'view' AND value > 80), c AS (SELECT l_partkey AS rec, count(*) AS n FROM lineitem GROUP BY 1) SELECT rec, n FROM c WHERE rec NOT IN (SELECT rec FROM live) QUALIFY row_number() OVER (ORDER BY n DESC, rec) <= 40")
def promotion_intake(spark, sf_dir):
    """Candidates that are not cached yet, as many as the cache has room for."""
    live = table(spark, sf_dir, "events").where("event_type = 'view' AND value > 80").select(F.col("user_id").alias("rec")).distinct()
    counts = accesses(spark, sf_dir).groupBy("rec").agg(F.count("*").alias("n"))
    return counts.join(live, "rec", "left_anti").orderBy(F.col("n").desc(), "rec").limit(40)


@register("epoch_safe", "SELECT event_id, e AS epoch, (SELECT min(event_id % 40 + 5) FROM events WHERE event_type = 'click') > e AS safe FROM (SELECT event_id, event_id % 12 AS e FROM events WHERE event_type = 'error')")
def epoch_safe(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    deleted = rows.where("event_type = 'error'").selectExpr("event_id", "event_id % 12 AS epoch")
    active = rows.where("event_type = 'click'").selectExpr("event_id % 40 + 5 AS epoch")
    return access.safe_to_delete(deleted, active)


@register("slab_classes", "SELECT size_class, count(*) AS n, CAST(sum(size) AS BIGINT) AS used_bytes, round(sum(size) / (count(*) * size_class), 4) AS usage FROM (SELECT size, greatest(24, CAST(ceil(size / 8.0) * 8 AS BIGINT)) AS size_class FROM (SELECT CAST(floor(l_extendedprice / 10) AS BIGINT) + 1 AS size FROM lineitem)) WHERE size_class <= 16384 GROUP BY 1")
def slab_classes(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_extendedprice") / 10) + 1).alias("size"))
    classed = sizes.withColumn("size_class", access.slab_class(F.col("size"))).where("size_class IS NOT NULL")
    return classed.groupBy("size_class").agg(F.count("*").alias("n"), F.sum("size").alias("used_bytes"), F.round(F.sum("size") / (F.count("*") * F.first("size_class")), 4).alias("usage"))


@register("cache_capacity", "SELECT p AS payload, 16777216 // (CAST(ceil((p + 40) / 8.0) AS BIGINT) * 8) AS capacity, round((SELECT count(*) FROM orders) * 1.0 / (16777216 // (CAST(ceil((p + 40) / 8.0) AS BIGINT) * 8)), 6) AS fill FROM range(50, 201, 25) r(p)")
def cache_capacity(spark, sf_dir):
    """Entries that a cache of 16 MiB holds by payload size, and its fill ratio with every order cached."""
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    entry = F.ceil((F.col("payload") + 40) / 8.0) * 8
    rows = spark.range(50, 201, 25).select(F.col("id").alias("payload")).withColumn("entry", entry.cast("bigint")).withColumn("capacity", F.expr("16777216 div entry"))
    return rows.crossJoin(F.broadcast(n)).select("payload", "capacity", F.round(F.col("n") * 1.0 / F.col("capacity"), 6).alias("fill"))


@register("shard_counts", f"SELECT CAST({FNV.format('l_partkey')} % 16 AS BIGINT) AS shard, count(*) AS n FROM lineitem GROUP BY 1")
def shard_counts(spark, sf_dir):
    """Keys by shard; each distinct key is hashed once."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k"))
    return per.groupBy(shard(F.col("l_partkey"), 16).alias("shard")).agg(F.sum("k").alias("n"))


@register("merge_candidates", f"{PAGES} SELECT page_id FROM (SELECT page_id, sum(least(n, 600) / 600.0) OVER w AS fill, count(*) OVER w AS k FROM pages WINDOW w AS (PARTITION BY page_id // 64 ORDER BY page_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5 AND 5 - ceil(round(fill, 6)) >= 1")
def merge_candidates(spark, sf_dir):
    """Runs of five neighbouring pages of one parent whose contents fit into fewer."""
    w = Window.partitionBy(F.expr("page_id div 64")).orderBy("page_id").rowsBetween(0, 4)
    rows = pages(spark, sf_dir).select("page_id", F.sum(F.least("n", F.lit(600)) / 600.0).over(w).alias("fill"), F.count("*").over(w).alias("k"))
    return rows.where("k = 5 AND 5 - ceil(round(fill, 6)) >= 1").select("page_id")


@register("sieve_simulation")
def sieve_simulation(spark, sf_dir):
    """Sequential by nature; tests hold it against a plain list implementation."""
    return simulate.simulate(access_sequence(spark, sf_dir), "rec", "seq", "sieve", 10, 8)


@register("lru_simulation")
def lru_simulation(spark, sf_dir):
    return simulate.simulate(access_sequence(spark, sf_dir), "rec", "seq", "lru", 10, 8)


@register("epoch_histograms", f"{GRID}, l AS (SELECT page_id, list(n ORDER BY epoch) AS ns FROM e GROUP BY 1), i AS (SELECT unnest(range(0, t + 1)) AS i FROM top), c AS (SELECT i AS epoch, ns[i + 1] AS n, list_reduce(ns[1:i + 1], lambda s, x: s // 2 + x) AS c FROM l, i), b AS (SELECT epoch, {LOG2.format('c')} AS b FROM c WHERE n > 0) SELECT i.i AS epoch, CAST(b - (i.i - epoch) AS INTEGER) AS bucket, count(*) AS keys FROM b JOIN i ON i.i >= epoch AND b - (i.i - epoch) >= 0 GROUP BY 1, 2")
def epoch_histograms(spark, sf_dir):
    return access.epoch_histograms(access_sequence(spark, sf_dir), "page_id", "epoch")


def _by_epoch(sql: str) -> str:
    """The rules' SQL with the epoch as one more key."""
    sql = sql.replace(ACC, SEQ).replace("FROM acc GROUP BY 1, 2", "FROM acc_seq GROUP BY 1, 2, 3").replace("s AS (SELECT page_id", "s AS (SELECT epoch, page_id")
    sql = sql.replace("p AS (SELECT page_id", "p AS (SELECT epoch, page_id").replace("AS skew_at FROM s GROUP BY 1)", "AS skew_at FROM s GROUP BY 1, 2)")
    sql = sql.replace("c AS (SELECT r.page_id", "c AS (SELECT r.epoch, r.page_id").replace("JOIN s USING (page_id) GROUP BY 1)", "JOIN s USING (epoch, page_id) GROUP BY 1, 2)")
    return sql.replace("SELECT page_id, visits, n_slots", "SELECT epoch, page_id, visits, n_slots").replace("JOIN c USING (page_id)", "JOIN c USING (epoch, page_id)")


@register("epoch_promotions", _by_epoch(rules_sql(20, 60, False)))
def epoch_promotions(spark, sf_dir):
    """Decisions at every epoch tick, each from that epoch's candidates."""
    return access.promotion(access.slot_counts(access_sequence(spark, sf_dir), ["epoch"]), 20, 60, 16, group=["epoch"])


@register("freq_export", f"{ACC} SELECT rec, count(*) - 1 AS repeats FROM acc GROUP BY rec")
def freq_export(spark, sf_dir):
    """Frequencies that count repeats only: the first use is zero."""
    return accesses(spark, sf_dir).groupBy("rec").agg((F.count("*") - 1).alias("repeats"))


@register("set_operations", f"{ACC}, a AS (SELECT DISTINCT page_id FROM acc WHERE slot_id < 4), b AS (SELECT DISTINCT page_id FROM acc WHERE page_id % 3 = 0) SELECT 'union' AS op, page_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', page_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'distinct', page_id FROM a")
def set_operations(spark, sf_dir):
    rows = accesses(spark, sf_dir)
    a, b = rows.where("slot_id < 4").select("page_id").dropDuplicates(), rows.where("page_id % 3 = 0").select("page_id").dropDuplicates()
    named = lambda op, df: df.select(F.lit(op).alias("op"), "page_id")
    return named("union", a.union(b).distinct()).unionByName(named("difference", a.join(b, "page_id", "left_anti"))).unionByName(named("distinct", a))
