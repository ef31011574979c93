"""Observability: latency histograms and percentiles, hit-ratio models, page classes, log parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in microseconds.
LATENCY_BOUNDS = (
    1, 2, 3, 5, 7, 10, 15, 22, 33, 50, 75, 112, 168, 252, 378, 567, 850, 1275, 1912, 2868, 4302, 6453, 9679, 14519,
    21778, 32667, 49000, 73500, 110250, 165375, 248062, 372093, 558139, 837208, 1255812, 1883718, 2000000,
)


def bound_index(us: Column) -> Column:
    """Place of the first bound >= us: the number of bounds below; one past the last beyond all."""
    return F.size(F.filter(F.array(*(F.lit(b) for b in LATENCY_BOUNDS)), lambda b: b < us))


def latency_histogram(df: DataFrame, us: str) -> DataFrame:
    """(bucket, n, total_us): counts by bucket, few rows whatever the input."""
    return df.groupBy(bound_index(F.col(us)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(us).alias("total_us"))


def percentile(hist: DataFrame, p: float) -> DataFrame:
    """(us): linear interpolation inside the bucket that the ceil(p n)-th latency falls into."""
    bounds = F.array(*(F.lit(b) for b in (0, *LATENCY_BOUNDS, LATENCY_BOUNDS[-1])))
    up = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    cum = cum.withColumn("target", F.ceil(F.lit(p) * F.col("all")))
    hit = cum.where("upto >= target").groupBy().agg(F.min(F.struct("bucket", "n", "upto", "target")).alias("c")).select("c.*")
    low = F.element_at(bounds, F.col("bucket") + 1)
    high = F.element_at(bounds, F.col("bucket") + 2)
    return hit.select((low + (high - low) * (F.col("target") - (F.col("upto") - F.col("n"))) / F.col("n")).alias("us"))


def tier_rates(raw: DataFrame) -> DataFrame:
    """Exclusive tier counts and rates: fast-memory hits counted a miss to storage too."""
    dram = F.greatest(F.col("raw_dram") - F.col("ssd"), F.lit(0))
    total = F.col("rc") + dram + F.col("cxl") + F.col("ssd")
    rate = lambda c: F.round(100.0 * c / total, 4)
    return raw.select("*", dram.alias("dram")).select("*", rate(F.col("rc")).alias("rc_pct"), rate(dram).alias("dram_pct"), rate(F.col("cxl")).alias("cxl_pct"), rate(F.col("ssd")).alias("ssd_pct"))


def zeta(n: Column, theta: float, exact: int = 10_000) -> Column:
    """Generalized harmonic number: exact terms up to ``exact``, an integral for the tail."""
    first = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(exact)).cast("int")), F.lit(0.0), lambda s, i: s + F.pow(i, F.lit(-theta)))
    tail = (F.pow(n + 0.5, F.lit(1 - theta)) - F.pow(F.lit(exact + 0.5), F.lit(1 - theta))) / (1 - theta)
    return first + F.when(n > exact, tail).otherwise(0.0)


def page_profile(accesses: DataFrame) -> DataFrame:
    """(page_id, visits, slots, top1, top3, top5): shares of the busiest slots of each page."""
    slots = accesses.groupBy("page_id", "slot_id").agg(F.count("*").alias("n"))
    page = slots.groupBy("page_id").agg(F.sum("n").alias("visits"), F.count("*").alias("slots"), F.sort_array(F.collect_list("n"), asc=False).alias("s"))
    share = lambda k: F.aggregate(F.slice("s", 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x) / F.col("visits")
    return page.select("page_id", "visits", "slots", share(1).alias("top1"), share(3).alias("top3"), share(5).alias("top5"))


def parse_epoch_ticks(lines: DataFrame) -> DataFrame:
    """Fields of epoch-tick log lines; colour codes are stripped."""
    clean = F.regexp_replace("value", "\x1b\\[[0-9;]*m", "")
    field = lambda k: F.regexp_extract(clean, rf"\b{k}=([0-9.]+)", 1).cast("bigint").alias(k)
    return lines.where(F.col("value").contains("admission_epoch_tick")).select(*(field(k) for k in ("req", "l1_fine_threshold", "promotions", "cleared_candidates")))


def parse_progress(lines: DataFrame) -> DataFrame:
    """Throughput and hit ratio of progress lines; numbers may hold thousands dots."""
    clean = F.regexp_replace("value", "\x1b\\[[0-9;]*m", "")
    number = lambda c: F.regexp_replace(c, r"[.,](?=[0-9]{3}\b)", "").cast("bigint")
    return lines.where(F.col("value").contains("Progress")).select(
        number(F.regexp_extract(clean, r"Progress ([0-9.,]*[0-9])/", 1)).alias("done"), number(F.regexp_extract(clean, r"/([0-9.,]*[0-9])", 1)).alias("total"),
        F.regexp_extract(clean, r"throughput=([0-9.]+)", 1).cast("double").alias("mqps"), F.regexp_extract(clean, r"RC_HR=([0-9.]+)%", 1).cast("double").alias("rc_hit_pct"),
    )


#: The fields of a sweep's result lines: column, what marks the line, the pattern of the value, its type.
SWEEP_FIELDS = (
    ("trigger_window", "trigger_window=", r"trigger_window=([0-9]+)", "bigint"),
    ("rc_fill", "Final", r"fill=([0-9.]+)", "double"),
    ("rc_hr", "mode=two_level", r"RC_HR=([0-9.]+)", "double"),
    ("mqps", "mode=two_level", r"Mqps=([0-9.]+)", "double"),
    ("p95_us", "mode=two_level", r"p95_us=([0-9.]+)", "double"),
    ("p99_us", "mode=two_level", r"p99_us=([0-9.]+)", "double"),
    ("skew_promote", "skew_promote=", r"skew_promote=([0-9]+)", "bigint"),
    ("uniform_promote", "skew_promote=", r"uniform_promote=([0-9]+)", "bigint"),
    ("sieve_evicted", "SIEVE evicted_entries", r"([0-9]+)[^0-9]*$", "bigint"),
)


def sweep_table(lines: DataFrame) -> DataFrame:
    """One row per run of a parameter sweep, from the lines (file, line, value) of its result files.

    Run group, workload and sketch columns stand in the file's name; of every other field the last line that has it
    counts, and a field that no line has is null."""
    clean = F.regexp_replace("value", "\x1b\\[[0-9;]*m", "")
    name = lambda pattern: F.nullif(F.regexp_extract("file", pattern, 1), F.lit(""))
    rows = lines.select(
        name(r"result_([A-Z][0-9])_ycsb").alias("run_group"), name(r"result_[A-Z][0-9]_ycsb([bc])_").alias("w"), name(r"cols([0-9]+[KMG]?)").alias("cms_cols"), "line", clean.alias("v")
    ).where("run_group IS NOT NULL AND w IS NOT NULL")
    found = [
        F.max_by(F.nullif(F.regexp_extract("v", pattern, 1), F.lit("")), F.when(F.col("v").contains(mark), F.col("line"))).cast(kind).alias(column)
        for column, mark, pattern, kind in SWEEP_FIELDS
    ]
    return rows.groupBy("run_group", F.concat(F.lit("YCSB-"), F.upper("w")).alias("workload"), "cms_cols").agg(*found)


def metric_tables(events: DataFrame, config: DataFrame) -> dict[str, DataFrame]:
    """The metric tables of a run, each joined to its configuration by ``c_hash``: buffer manager (bm), data structures
    (dt), processor (cpu), concurrency and recovery (cr), and the configurations.

    ``events``: (t, c_hash, event_id, user_id, event_type, value); a page is 4 KiB, and a worker is one of four by user.
    Cycles are added from the latest event to the first, so that the last digit does not depend on the order of tasks; a
    worker's events of one ``t`` are held in one row for it."""
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    mib = lambda kind, name: F.round(n(kind) / 256.0, 4).alias(name)
    pages = F.countDistinct("user_id")
    used = F.transform(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))), asc=False), lambda e: e["value"])
    ordered = F.aggregate(F.slice(used, 2, F.greatest(F.size(used), F.lit(1))), F.get(used, 0), lambda s, v: s + v)
    base = ["t", "c_hash"]
    tables = {
        "bm": events.groupBy(*base).agg(
            pages.alias("consumed_pages"), F.round(pages * 4.0, 4).alias("space_usage_kib"), mib("error", "evicted_mib"), mib("purchase", "w_mib"), mib("view", "r_mib"), n("signup").alias("allocate_ops")
        ),
        "dt": events.groupBy(*base, F.col("event_type").alias("dt_name")).agg(F.count("*").alias("dt_page_reads"), F.count(F.when(F.col("value") > 100, 1)).alias("dt_page_writes")),
        "cpu": events.groupBy(*base, (F.col("user_id") % 4).alias("worker")).agg(F.round(ordered, 2).alias("cycles"), F.round(ordered / F.count("*"), 4).alias("cycles_per_tx")),
        "cr": events.groupBy(*base).agg(
            (F.count("*") - n("error")).alias("tx"), n("error").alias("tx_abort"), n("view").alias("olap_tx"), F.round(100.0 * n("error") / F.count("*"), 4).alias("abort_pct")
        ),
    }
    return {name: df.join(config, "c_hash").drop("c_hash") for name, df in tables.items()} | {"configs": config}
