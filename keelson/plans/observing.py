"""Observability queries: rates, histograms, percentiles, hit-ratio models, page classes, log analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.functions.scalar import labelled_bucket
from keelson.operators import observe
from keelson.operators.keyed import shifted
from keelson.operators.workloads import upper_median
from keelson.plans.registry import register
from keelson.sources.tables import accesses, latencies, table, with_sql

ACC, LAT = with_sql("acc"), with_sql("lat")
BOUNDS = "[" + ", ".join(map(str, observe.LATENCY_BOUNDS)) + "]"
HIST = f"{LAT}, hist AS (SELECT len(list_filter({BOUNDS}, lambda b: b < us)) AS bucket, count(*) AS n, sum(us) AS total_us FROM lat GROUP BY 1)"
PROFILE = f"{ACC}, s AS (SELECT page_id, slot_id, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC) AS rn FROM acc GROUP BY 1, 2), prof AS (SELECT page_id, sum(n) AS visits, count(*) AS slots, sum(n) FILTER (WHERE rn <= 1) / sum(n) AS top1, sum(n) FILTER (WHERE rn <= 3) / sum(n) AS top3, sum(n) FILTER (WHERE rn <= 5) / sum(n) AS top5 FROM s GROUP BY 1)"


def profile(spark, sf_dir):
    return observe.page_profile(accesses(spark, sf_dir))


@register("tier_rates", "WITH r AS (SELECT user_id % 5 AS run, count(*) FILTER (WHERE event_type = 'view') AS rc, count(*) FILTER (WHERE event_type IN ('click', 'signup')) AS raw_dram, count(*) FILTER (WHERE event_type = 'purchase') AS cxl, count(*) FILTER (WHERE event_type = 'error') AS ssd FROM events GROUP BY 1), d AS (SELECT *, greatest(raw_dram - ssd, 0) AS dram FROM r) SELECT *, round(100.0 * rc / (rc + dram + cxl + ssd), 4) AS rc_pct, round(100.0 * dram / (rc + dram + cxl + ssd), 4) AS dram_pct, round(100.0 * cxl / (rc + dram + cxl + ssd), 4) AS cxl_pct, round(100.0 * ssd / (rc + dram + cxl + ssd), 4) AS ssd_pct FROM d")
def tier_rates(spark, sf_dir):
    count = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    raw = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("run")).agg(
        count("view").alias("rc"), count("click", "signup").alias("raw_dram"), count("purchase").alias("cxl"), count("error").alias("ssd")
    )
    return observe.tier_rates(raw)


@register("latency_hist", HIST + " SELECT CAST(bucket AS INTEGER) AS bucket, n, CAST(total_us AS BIGINT) AS total_us FROM hist")
def latency_hist(spark, sf_dir):
    return observe.latency_histogram(latencies(spark, sf_dir), "us")


def interpolated(p: float) -> str:
    return f"SELECT {p}::DOUBLE AS p, round(low + (high - low) * (target - (upto - n)) / n, 4) AS us FROM (SELECT *, list_extract([0] || {BOUNDS} || [2000000], bucket + 1) AS low, list_extract([0] || {BOUNDS} || [2000000], bucket + 2) AS high FROM (SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS upto, ceil({p}::DOUBLE * sum(n) OVER ()) AS target FROM hist) WHERE upto >= target ORDER BY bucket LIMIT 1)"


@register("latency_pct_interp", HIST + " " + " UNION ALL ".join(interpolated(p) for p in (0.5, 0.95, 0.99)))
def latency_pct_interp(spark, sf_dir):
    hist = observe.latency_histogram(latencies(spark, sf_dir), "us")
    out = None
    for p in (0.5, 0.95, 0.99):
        one = observe.percentile(hist, p).select(F.lit(p).alias("p"), F.round("us", 4).alias("us"))
        out = one if out is None else out.unionByName(one)
    return out


@register("exact_pct", f"{LAT} SELECT round(quantile_cont(us, 0.5), 4) AS p50, round(quantile_cont(us, 0.95), 4) AS p95, round(quantile_cont(us, 0.99), 4) AS p99, max(us) AS worst FROM lat")
def exact_pct(spark, sf_dir):
    pct = lambda p: F.round(F.percentile("us", p), 4)
    return latencies(spark, sf_dir).agg(pct(0.5).alias("p50"), pct(0.95).alias("p95"), pct(0.99).alias("p99"), F.max("us").alias("worst"))


@register("topk_theory", "WITH z AS (SELECT i, sum(pow(i, -0.9)) OVER (ORDER BY i) AS h, sum(pow(i, -0.9)) OVER () AS hn FROM range(1, 5001) r(i)) SELECT i AS k, round(h / hn, 8) AS hit_ratio FROM z WHERE i % 500 = 0")
def topk_theory(spark, sf_dir):
    """Hit ratio of caching the k hottest of 5000 keys under a Zipf law."""
    ks = spark.range(500, 5001, 500).select(F.col("id").alias("k"))
    return ks.select("k", F.round(observe.zeta(F.col("k"), 0.9) / observe.zeta(F.lit(5000), 0.9), 8).alias("hit_ratio"))


@register("payload_sweep", "WITH z AS (SELECT i, sum(pow(i, -0.9)) OVER (ORDER BY i) AS h FROM range(1, 4001) r(i)), p AS (SELECT payload, working_mb, least(4000, working_mb * 4096 // (payload + 40)) AS cached FROM range(50, 201, 50) a(payload), range(1, 5) b(working_mb)) SELECT payload, working_mb, cached, round(h / (SELECT max(h) FROM z), 8) AS hit_ratio FROM p JOIN z ON i = cached")
def payload_sweep(spark, sf_dir):
    """Hit ratio by payload size and cache size."""
    grid = spark.range(50, 201, 50).select(F.col("id").alias("payload")).crossJoin(spark.range(1, 5).select(F.col("id").alias("working_mb")))
    grid = grid.withColumn("cached", F.expr("least(4000, working_mb * 4096 div (payload + 40))"))
    return grid.select("payload", "working_mb", "cached", F.round(observe.zeta(F.col("cached"), 0.9) / observe.zeta(F.lit(4000), 0.9), 8).alias("hit_ratio"))


CLASS_A = PROFILE + ", c AS (SELECT page_id, visits, CASE WHEN top1 >= 0.10 THEN 'SKEW' WHEN visits >= 1.05 * (SELECT avg(visits) FROM prof) THEN 'HOT' ELSE 'COLD' END AS class FROM prof)"


def class_a(spark, sf_dir):
    rows = profile(spark, sf_dir)
    mean = rows.agg(F.avg("visits").alias("mean"))
    kind = F.when(F.col("top1") >= 0.10, "SKEW").when(F.col("visits") >= 1.05 * F.col("mean"), "HOT").otherwise("COLD")
    return rows.crossJoin(F.broadcast(mean)).select("page_id", "visits", kind.alias("class"))


@register("classify_a", CLASS_A + " SELECT page_id, CAST(visits AS BIGINT) AS visits, class FROM c")
def classify_a(spark, sf_dir):
    """Skewed first, then hot by a multiple of the mean."""
    return class_a(spark, sf_dir)


@register("classify_b", PROFILE + " SELECT page_id, CASE WHEN rn <= ceil(n * 0.1::DOUBLE) THEN 'HOT' WHEN top1 >= 0.085 THEN 'SKEW' ELSE 'COLD' END AS class FROM (SELECT *, row_number() OVER (ORDER BY visits DESC, page_id) AS rn, count(*) OVER () AS n FROM prof)")
def classify_b(spark, sf_dir):
    """Hottest tenth first, then skewed.  The cut is the visits and id of the last page of the tenth."""
    rows = profile(spark, sf_dir)
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    top = -(-n // 10) if n else 0
    cut = rows.orderBy(F.col("visits").desc(), "page_id").limit(max(1, top)).agg(F.min(F.struct("visits", (-F.col("page_id")).alias("p"))).alias("cut"))
    hot = F.struct("visits", (-F.col("page_id")).alias("p")) >= F.col("cut")
    return rows.crossJoin(F.broadcast(cut)).select("page_id", F.when(hot, "HOT").when(F.col("top1") >= 0.085, "SKEW").otherwise("COLD").alias("class"))


@register("classify_c", PROFILE + " SELECT page_id, CASE WHEN top1 >= 0.085 THEN 'SKEW' ELSE 'COLD' END AS class FROM prof")
def classify_c(spark, sf_dir):
    return profile(spark, sf_dir).select("page_id", F.when(F.col("top1") >= 0.085, "SKEW").otherwise("COLD").alias("class"))


@register("type_traffic", CLASS_A + ", u AS (SELECT p AS page_id, coalesce(class, 'COLD') AS class, coalesce(visits, 0) AS visits FROM range(0, (SELECT max(page_id) + 11 FROM prof)) r(p) LEFT JOIN c ON c.page_id = p) SELECT class, count(*) AS pages, CAST(sum(visits) AS BIGINT) AS traffic FROM u GROUP BY 1")
def type_traffic(spark, sf_dir):
    """Pages and traffic by class; pages of the universe that nobody visited count as cold."""
    classed = class_a(spark, sf_dir)
    top = classed.agg(F.max("page_id")).first()[0] or 0
    pages = spark.range(top + 11).select(F.col("id").alias("page_id")).join(classed, "page_id", "left")
    return pages.groupBy(F.coalesce("class", F.lit("COLD")).alias("class")).agg(F.count("*").alias("pages"), F.sum(F.coalesce("visits", F.lit(0))).alias("traffic"))


@register("domination", PROFILE + " SELECT count(*) FILTER (WHERE top1 >= 0.08) AS one, count(*) FILTER (WHERE top3 >= 0.22) AS three, count(*) FILTER (WHERE top5 >= 0.35) AS five, count(*) FILTER (WHERE top1 >= 0.6 OR top3 >= 0.7 OR top5 >= 0.8) AS dominated FROM prof")
def domination(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    one, three, five = F.col("top1"), F.col("top3"), F.col("top5")
    return profile(spark, sf_dir).agg(n(one >= 0.08).alias("one"), n(three >= 0.22).alias("three"), n(five >= 0.35).alias("five"), n((one >= 0.6) | (three >= 0.7) | (five >= 0.8)).alias("dominated"))


@register("bandwidth_waste", PROFILE + " SELECT round(avg(100 - 100 * top5), 6) AS waste_pct FROM prof")
def bandwidth_waste(spark, sf_dir):
    """Share of a page move that serves none of its five busiest slots."""
    return profile(spark, sf_dir).agg(F.round(F.avg(100 - 100 * F.col("top5")), 6).alias("waste_pct"))


@register("top_pages", f"{ACC} SELECT page_id, count(*) AS n FROM acc GROUP BY 1 ORDER BY n DESC, page_id LIMIT 30")
def top_pages(spark, sf_dir):
    return accesses(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "page_id").limit(30)


@register("slot_shares", f"{ACC}, s AS (SELECT page_id, slot_id, count(*) AS n FROM acc GROUP BY 1, 2) SELECT page_id, slot_id, n, round(sum(n) OVER w / sum(n) OVER (PARTITION BY page_id), 8) AS share FROM s WINDOW w AS (PARTITION BY page_id ORDER BY n DESC, slot_id ROWS UNBOUNDED PRECEDING) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, slot_id) <= 3")
def slot_shares(spark, sf_dir):
    """The three busiest slots of each page with their cumulative share."""
    w = Window.partitionBy("page_id")
    order = w.orderBy(F.col("n").desc(), "slot_id")
    s = accesses(spark, sf_dir).groupBy("page_id", "slot_id").agg(F.count("*").alias("n"))
    s = s.withColumn("share", F.round(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w), 8)).withColumn("rn", F.row_number().over(order))
    return s.where("rn <= 3").drop("rn")


@register("cdf_points", f"{ACC}, p AS (SELECT page_id, count(*) AS n FROM acc GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, page_id) AS rn, count(*) OVER () AS total, sum(n) OVER (ORDER BY n DESC, page_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS share FROM p), c AS (SELECT unnest([0.1, 0.5, 1, 5, 10, 20, 50]::DOUBLE[]) AS pct) SELECT pct, min(rn) AS pages, round(min(share), 8) AS share FROM c JOIN r ON 100.0 * rn / total >= pct GROUP BY pct")
def cdf_points(spark, sf_dir):
    """Share of traffic of the hottest 0.1 .. 50 % of pages.  Ranks come from the few distinct counts, so no
    window covers all pages."""
    counts = accesses(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"))
    hist = counts.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    cum = hist.select("n", "k", F.sum("k").over(w).alias("upto"), F.sum(F.col("n") * F.col("k")).over(w).alias("traffic"), F.sum("k").over(all_).alias("total"), F.sum(F.col("n") * F.col("k")).over(all_).alias("all"))
    points = spark.createDataFrame([(p,) for p in (0.1, 0.5, 1.0, 5.0, 10.0, 20.0, 50.0)], "pct double")
    met = points.join(F.broadcast(cum), F.expr("100.0 * upto >= pct * total"))
    first = met.groupBy("pct").agg(F.min(F.struct("upto", "n", "k", "traffic", "total", "all")).alias("c")).select("pct", "c.*")
    pages = F.greatest(F.ceil(F.col("pct") * F.col("total") / 100), F.col("upto") - F.col("k") + 1)
    first = first.withColumn("pages", pages.cast("bigint"))
    return first.select("pct", "pages", F.round((F.col("traffic") - F.col("n") * (F.col("upto") - F.col("pages"))) / F.col("all"), 8).alias("share"))


BUCKET = "CASE WHEN {0} = 0 THEN '0' WHEN {0} = 1 THEN '1' WHEN {0} >= 16384 THEN '>=16384' ELSE (1::BIGINT << (length(bin({0})) - 1)::INTEGER) || '-' || ((2::BIGINT << (length(bin({0})) - 1)::INTEGER) - 1) END"


@register("joint_buckets", PROFILE + f" SELECT {BUCKET.format('visits::BIGINT')} AS visit_bucket, {BUCKET.format('slots')} AS slot_bucket, count(*) AS pages FROM prof GROUP BY 1, 2")
def joint_buckets(spark, sf_dir):
    rows = profile(spark, sf_dir)
    return rows.groupBy(labelled_bucket(F.col("visits")).alias("visit_bucket"), labelled_bucket(F.col("slots")).alias("slot_bucket")).agg(F.count("*").alias("pages"))


@register("crosstab", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def crosstab(spark, sf_dir):
    pivoted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return pivoted.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@register("branch_stats", f"{ACC}, s AS (SELECT page_id, slot_id, count(*) AS n FROM acc GROUP BY 1, 2) SELECT CASE WHEN n >= 40 THEN 'hot' WHEN n >= 28 THEN 'warm' ELSE 'cold' END AS branch, count(*) AS n, count(DISTINCT page_id) AS pages, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM s GROUP BY 1")
def branch_stats(spark, sf_dir):
    s = accesses(spark, sf_dir).groupBy("page_id", "slot_id").agg(F.count("*").alias("c"))
    branch = F.when(F.col("c") >= 40, "hot").when(F.col("c") >= 28, "warm").otherwise("cold")
    return s.groupBy(branch.alias("branch")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.round(F.avg("c"), 6).alias("mean"), F.min("c").alias("least"), F.max("c").alias("most"))


@register("upper_median_value", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn = n // 2 + 1")
def upper_median_value(spark, sf_dir):
    return upper_median(table(spark, sf_dir, "events"), ["event_type"], ["value", "event_id"]).select("event_type", "value")


@register("counter_deltas", "SELECT bucket, n, n - coalesce(lag(n) OVER (ORDER BY bucket), 0) AS delta FROM (SELECT event_id // 1000 AS bucket, max(event_id) AS n FROM events GROUP BY 1)")
def counter_deltas(spark, sf_dir):
    """Cumulative counters read once an interval, as increments (one row an interval)."""
    per = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 1000").alias("bucket")).agg(F.max("event_id").alias("n"))
    return shifted(per, ["bucket", "n"]).select("bucket", "n", (F.col("n") - F.coalesce("prev_key.n", F.lit(0))).alias("delta"))


@register("console_row", "SELECT user_id % 4 AS worker, count(*) AS tx, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS abort_pct, round(sum(value) / count(*), 4) AS per_tx FROM events GROUP BY 1")
def console_row(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("worker"))
    return rows.agg(F.count("*").alias("tx"), F.round(100.0 * F.count(F.when(F.col("event_type") == "error", 1)) / F.count("*"), 4).alias("abort_pct"), F.round(F.sum("value") / F.count("*"), 4).alias("per_tx"))


@register("metrics_join", "WITH c AS (SELECT DISTINCT user_id % 6 AS c_hash, 'cfg' || (user_id % 6) AS config FROM events), m AS (SELECT event_id // 2000 AS t, user_id % 6 AS c_hash, count(*) AS tx, round(sum(value), 2) AS work FROM events GROUP BY 1, 2) SELECT t, config, tx, work FROM m JOIN c USING (c_hash)")
def metrics_join(spark, sf_dir):
    """Metric tables meet their configuration by its hash."""
    events = table(spark, sf_dir, "events").withColumn("c_hash", F.col("user_id") % 6)
    config = events.select("c_hash").distinct().withColumn("config", F.concat(F.lit("cfg"), "c_hash"))
    metric = events.groupBy(F.expr("event_id div 2000").alias("t"), "c_hash").agg(F.count("*").alias("tx"), F.round(F.sum("value"), 2).alias("work"))
    return metric.join(F.broadcast(config), "c_hash").select("t", "config", "tx", "work")


@register("best_of_sweep", "SELECT user_id % 9 AS theta, arg_max(event_id % 100, (event_type = 'view', value, event_id)) AS variant, max(value) FILTER (WHERE event_type = 'view') AS best FROM events GROUP BY 1")
def best_of_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 9).alias("theta"))
    return rows.agg(F.max_by(F.col("event_id") % 100, F.struct(F.col("event_type") == "view", "value", "event_id")).alias("variant"), F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("best"))


@register("trace_summary", "SELECT event_id // 500 AS round, count(*) FILTER (WHERE event_type = 'signup') AS skew_records, count(*) FILTER (WHERE event_type = 'purchase') AS uniform_pages, count(*) FILTER (WHERE event_type = 'signup') = 0 AS idle, min(event_id) - coalesce(lag(min(event_id)) OVER (ORDER BY event_id // 500), 0) AS interval FROM events GROUP BY 1")
def trace_summary(spark, sf_dir):
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    rows = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 500").alias("round")).agg(n("signup").alias("skew_records"), n("purchase").alias("uniform_pages"), F.min("event_id").alias("first"))
    found = shifted(rows, ["round", "first"])
    return found.select("round", "skew_records", "uniform_pages", (F.col("skew_records") == 0).alias("idle"), (F.col("first") - F.coalesce("prev_key.first", F.lit(0))).alias("interval"))


@register("expected_visits", "WITH z AS (SELECT i, 100000 * pow(i, -0.9) / (SELECT sum(pow(j, -0.9)) FROM range(1, 5001) s(j)) AS lam FROM range(1, 5001) r(i)) SELECT count(*) FILTER (WHERE 1 - exp(-lam) * (1 + lam + lam * lam / 2) > 0.5) AS likely_thrice, round(sum(1 - pow(1 - lam / 100000, 100000)), 4) AS distinct_pages FROM z")
def expected_visits(spark, sf_dir):
    """Pages likely seen three times in a window, and distinct pages expected in it, under a Zipf law."""
    h = spark.range(1, 5001).agg(F.sum(F.pow("id", F.lit(-0.9))).alias("h"))
    lam = 100000 * F.pow("id", F.lit(-0.9)) / F.col("h")
    rows = spark.range(1, 5001).crossJoin(F.broadcast(h)).select(lam.alias("lam"))
    thrice = 1 - F.exp(-F.col("lam")) * (1 + F.col("lam") + F.col("lam") * F.col("lam") / 2)
    return rows.agg(F.count(F.when(thrice > 0.5, 1)).alias("likely_thrice"), F.round(F.sum(1 - F.pow(1 - F.col("lam") / 100000, F.lit(100000))), 4).alias("distinct_pages"))


@register("max_rank", "SELECT k, CAST(floor(pow(1000000 / (k * (SELECT sum(pow(j, -0.9)) FROM range(1, 5001) s(j))), 1 / 0.9)) AS BIGINT) AS rank FROM range(1, 21) r(k)")
def max_rank(spark, sf_dir):
    """Coldest rank that still gets k visits out of a million."""
    h = spark.range(1, 5001).agg(F.sum(F.pow("id", F.lit(-0.9))).alias("h"))
    return spark.range(1, 21).crossJoin(F.broadcast(h)).select(F.col("id").alias("k"), F.floor(F.pow(1000000 / (F.col("id") * F.col("h")), F.lit(1 / 0.9))).alias("rank"))


@register("tier_probe", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 15 THEN 'RC' WHEN count(*) FILTER (WHERE event_type = 'error') > 14 THEN 'SSD' WHEN count(*) FILTER (WHERE event_type = 'purchase') > 12 THEN 'CXL' ELSE 'DRAM' END AS tier FROM events GROUP BY 1")
def tier_probe(spark, sf_dir):
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    tier = F.when(n("view") > 15, "RC").when(n("error") > 14, "SSD").when(n("purchase") > 12, "CXL").otherwise("DRAM")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(tier.alias("tier"))


@register("sorted_runs", "SELECT workload, run, mqps FROM (SELECT event_type AS workload, user_id % 7 AS run, count(*) / 1000 AS mqps FROM events GROUP BY 1, 2) ORDER BY workload, mqps DESC")
def sorted_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("workload"), (F.col("user_id") % 7).alias("run")).agg((F.count("*") / 1000).alias("mqps"))
    return rows.orderBy("workload", F.col("mqps").desc())


@register("log_epoch_ticks", "SELECT event_id AS req, event_id % 9 AS l1_fine_threshold, user_id AS promotions, event_id % 31 AS cleared_candidates FROM events WHERE event_type = 'view'")
def log_epoch_ticks(spark, sf_dir):
    """Log lines written out, a tick for every view and noise for the rest, and parsed back."""
    line = F.format_string("\x1b[32madmission_epoch_tick\x1b[0m req=%d l1_fine_threshold=%d promotions=%d cleared_candidates=%d", "event_id", F.col("event_id") % 9, "user_id", F.col("event_id") % 31)
    return observe.parse_epoch_ticks(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", line).otherwise("noise").alias("value")))


@register("log_progress", "SELECT event_id * 1000 AS done, 20000000 AS total, round(user_id / 100.0, 2)::DOUBLE AS mqps, (event_id % 100)::DOUBLE AS rc_hit_pct FROM events")
def log_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    dots = F.replace(F.format_number(F.col("event_id") * 1000, 0), F.lit(","), F.lit("."))
    line = F.concat(F.lit("Progress "), dots, F.lit("/20.000.000, throughput="), F.format_string("%.2f", F.col("user_id") / 100.0), F.lit(" Mqps, RC_HR="), F.format_string("%d", F.col("event_id") % 100), F.lit("%"))
    return observe.parse_progress(e.select(line.alias("value"))).withColumn("total", F.col("total").cast("int"))


SWEEP = "SELECT chr(CAST(65 + user_id % 3 AS INTEGER)) || (user_id % 4) AS run_group, CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'c' END AS workload, event_id, user_id, value FROM events"


@register(
    "sweep_table",
    f"WITH e AS ({SWEEP}), l AS (SELECT run_group, workload, max(event_id) AS last FROM e GROUP BY 1, 2) SELECT run_group, 'YCSB-' || upper(e.workload) AS workload, '64K' AS cms_cols, last * 100 AS trigger_window, (last % 100)::DOUBLE AS rc_fill, (last % 97)::DOUBLE AS rc_hr, (last % 13)::DOUBLE AS mqps, (last % 50)::DOUBLE AS p95_us, (last % 70)::DOUBLE AS p99_us, last % 1000 AS skew_promote, user_id AS uniform_promote, last % 11 AS sieve_evicted FROM l JOIN e USING (run_group, workload) WHERE event_id = last",
)
def sweep_table(spark, sf_dir):
    """A sweep's result files parsed into one table: of each field the last line that has it counts."""
    e = table(spark, sf_dir, "events").select(F.concat(F.chr(65 + F.col("user_id") % 3), F.col("user_id") % 4).alias("g"), F.when(F.col("user_id") % 2 == 0, "b").otherwise("c").alias("w"), "event_id", "user_id")
    n = F.col("event_id")
    lines = F.array(
        F.format_string("\x1b[33mDEBUG\x1b[0m trigger_window=%d", n * 100), F.format_string("RC State (Final) fill=%d.0", n % 100),
        F.format_string("mode=two_level RC_HR=%d.0 Mqps=%d.0 p95_us=%d.0 p99_us=%d.0", n % 97, n % 13, n % 50, n % 70),
        F.format_string("skew_promote=%d uniform_promote=%d", n % 1000, F.col("user_id")), F.format_string("SIEVE evicted_entries %d", n % 11), F.lit("noise"),
    )
    files = e.select(F.concat(F.lit("result_"), "g", F.lit("_ycsb"), "w", F.lit("_cols64K_7.csv")).alias("file"), F.posexplode(lines).alias("at", "value"), n.alias("part"))
    return observe.sweep_table(files.select("file", (F.col("part") * 10 + F.col("at")).alias("line"), "value"))


METRIC = "m AS (SELECT event_id // 2000 AS t, user_id % 6 AS c_hash, * FROM events), c AS (SELECT DISTINCT c_hash, 'cfg' || c_hash AS c_tag, c_hash + 1 AS c_worker_threads FROM m)"


def metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("t", F.expr("event_id div 2000")).withColumn("c_hash", F.col("user_id") % 6)
    config = events.select("c_hash").distinct().select("c_hash", F.concat(F.lit("cfg"), "c_hash").alias("c_tag"), (F.col("c_hash") + 1).alias("c_worker_threads"))
    return observe.metric_tables(events, config)


@register("metrics_bm", f"WITH {METRIC} SELECT t, c_tag, c_worker_threads, count(DISTINCT user_id) AS consumed_pages, round(count(DISTINCT user_id) * 4.0, 4) AS space_usage_kib, round(count(*) FILTER (WHERE event_type = 'error') / 256.0, 4) AS evicted_mib, round(count(*) FILTER (WHERE event_type = 'purchase') / 256.0, 4) AS w_mib, round(count(*) FILTER (WHERE event_type = 'view') / 256.0, 4) AS r_mib, count(*) FILTER (WHERE event_type = 'signup') AS allocate_ops FROM m JOIN c USING (c_hash) GROUP BY 1, 2, 3")
def metrics_bm(spark, sf_dir):
    return metrics(spark, sf_dir)["bm"]


@register("metrics_dt", f"WITH {METRIC} SELECT t, c_tag, c_worker_threads, event_type AS dt_name, count(*) AS dt_page_reads, count(*) FILTER (WHERE value > 100) AS dt_page_writes FROM m JOIN c USING (c_hash) GROUP BY 1, 2, 3, 4")
def metrics_dt(spark, sf_dir):
    return metrics(spark, sf_dir)["dt"]


@register("metrics_cpu", f"WITH {METRIC} SELECT t, c_tag, c_worker_threads, user_id % 4 AS worker, round(sum(value), 2) AS cycles, round(sum(value) / count(*), 4) AS cycles_per_tx FROM m JOIN c USING (c_hash) GROUP BY 1, 2, 3, 4")
def metrics_cpu(spark, sf_dir):
    return metrics(spark, sf_dir)["cpu"]


@register("metrics_cr", f"WITH {METRIC} SELECT t, c_tag, c_worker_threads, count(*) FILTER (WHERE event_type <> 'error') AS tx, count(*) FILTER (WHERE event_type = 'error') AS tx_abort, count(*) FILTER (WHERE event_type = 'view') AS olap_tx, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS abort_pct FROM m JOIN c USING (c_hash) GROUP BY 1, 2, 3")
def metrics_cr(spark, sf_dir):
    return metrics(spark, sf_dir)["cr"]


@register("metrics_configs", f"WITH {METRIC} SELECT * FROM c")
def metrics_configs(spark, sf_dir):
    return metrics(spark, sf_dir)["configs"]


@register("sweep_summary", "SELECT c_mktsegment AS variant, max(c_acctbal) FILTER (WHERE c_nationkey % 3 = 0) AS t0, max(c_acctbal) FILTER (WHERE c_nationkey % 3 = 1) AS t1, max(c_acctbal) FILTER (WHERE c_nationkey % 3 = 2) AS t2 FROM customer GROUP BY 1")
def sweep_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("variant"), F.concat(F.lit("t"), F.col("c_nationkey") % 3).alias("k"), "c_acctbal")
    return rows.groupBy("variant").pivot("k", ["t0", "t1", "t2"]).agg(F.max("c_acctbal"))
