"""Access-stream analytics: frequency sketches, aging, histograms, thresholds, promotion rules.

Everything here is grouped aggregation; windows without a partition run only over
histogram-sized inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.scalar import log2_bucket

ALPHA, SKEW_RATIO, SLOT_RATIO, TOP_BUCKET = 0.25, 0.10, 0.5, 15


#: Fixed values: (rows, columns) of the sketches of pages and of records.
PAGE_SKETCH, RECORD_SKETCH = (12, 1024 * 1024), (4, 64 * 1024)


def _cells(key: str | list[str], rows: int, cols: int) -> Column:
    """A key's cell in every row; a key of several columns, such as (page, slot), is hashed as a whole."""
    parts = [F.col(k) for k in ([key] if isinstance(key, str) else key)]
    return F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(*parts, F.lit(r)), F.lit(cols)).alias("col")) for r in range(rows))))


def count_min(stream: DataFrame, key: str | list[str], rows: int = 4, cols: int = 1024) -> DataFrame:
    """Sketch cells (row, col, n): every key counts once in each row."""
    cells = stream.select(_cells(key, rows, cols).alias("c"))
    return cells.groupBy("c.row", "c.col").agg(F.count("*").alias("n"))


def estimate(keys: DataFrame, key: str | list[str], sketch: DataFrame, rows: int = 4, cols: int = 1024) -> DataFrame:
    """``keys`` with the least of their cells: never below the true count.  The sketch has at most rows x cols rows; one
    of more than a quarter of a million is joined, not broadcast."""
    asked = keys.select("*", _cells(key, rows, cols).alias("c"))
    cell = sketch.select(F.col("row").alias("r"), F.col("col").alias("k"), F.col("n").alias("__n"))
    cell = F.broadcast(cell) if rows * cols <= 1 << 18 else cell
    met = asked.join(cell, (F.col("c.row") == F.col("r")) & (F.col("c.col") == F.col("k")), "left")
    return met.groupBy(*keys.columns).agg(F.min(F.coalesce("__n", F.lit(0))).alias("estimate"))


def running_counters(stream: DataFrame, key: str, epoch: str) -> DataFrame:
    """(key, epoch, n, counter) for every epoch that a key is used in: its uses there, and its counter after them,
    halved (rounding down) before each epoch is added.

    Idle epochs are one shift by their number.  The rule is sequential in a key's epochs, so these are sorted and passed
    over once, in batches: a task's memory does not grow with a key's history."""
    per = stream.groupBy(F.col(key).alias("key"), F.col(epoch).cast("bigint").alias("epoch")).agg(F.count("*").alias("n"))
    parts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = per.schema["key"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        held, at, counter = object(), 0, 0
        for batch in batches:
            out = []
            for k, e, n in zip(*(batch.column(c).to_pylist() for c in ("key", "epoch", "n")), strict=True):
                counter = (counter >> (e - at) if k == held else 0) + n
                held, at = k, e
                out.append(counter)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["key", "epoch", "n", "counter"])

    ordered = per.repartition(parts, "key").sortWithinPartitions("key", "epoch")
    return ordered.mapInArrow(run, f"key {kind}, epoch bigint, n bigint, counter bigint")


def aged_counts(stream: DataFrame, key: str, epoch: str, epochs: int | None = None) -> DataFrame:
    """Counter of every key after the last epoch of the stream, or as it was after the first ``epochs``."""
    stream = stream if epochs is None else stream.where(F.col(epoch) < epochs)
    last = stream.agg(F.max(F.col(epoch).cast("bigint")).alias("last"))
    final = running_counters(stream, key, epoch).groupBy("key").agg(F.max(F.struct("epoch", "counter")).alias("c"))
    idle = F.least(F.col("last") - F.col("c.epoch"), F.lit(63)).cast("int")
    return final.crossJoin(F.broadcast(last)).select(F.col("key").alias(key), F.call_function("shiftright", F.col("c.counter"), idle).alias("aged"))


def first_distinct(stream: DataFrame, key: str, epoch: str, order: str, limit: int) -> DataFrame:
    """First ``limit`` distinct keys of every epoch by first use; each task sends on no more than its own first ``limit``."""
    first = stream.groupBy(epoch, key).agg(F.min(order).alias("first_seq"))
    w = Window.partitionBy(epoch).orderBy("first_seq")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def histogram(counts: DataFrame, n: str, group: list[str] | None = None) -> DataFrame:
    """Keys per log2 bucket of their count; zero counts are left out."""
    return counts.where(F.col(n) > 0).groupBy(*(group or []), log2_bucket(F.col(n), TOP_BUCKET).alias("bucket")).agg(F.count("*").alias("keys"))


def reverse_cumulative(hist: DataFrame, group: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(group or [])).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("at_least", F.sum("keys").over(w))


def aged_histogram(hist: DataFrame) -> DataFrame:
    """Halved counts: every bucket moves down, bucket 0 drops out."""
    return hist.where("bucket >= 1").withColumn("bucket", F.col("bucket") - 1)


def thresholds(counts: DataFrame, n: str, fast: int, slow: int, group: list[str] | None = None) -> DataFrame:
    """(coarse, fine) per group.  ``coarse``: lower bound of the hottest buckets that together hold the
    share of keys that fits the fast tier.  ``fine``: the count of the key that fills it, inside the last of these buckets."""
    group = group or []
    keyed = counts.where(F.col(n) > 0).withColumn("bucket", log2_bucket(F.col(n), TOP_BUCKET))
    hist = keyed.groupBy(*group, "bucket").agg(F.count("*").alias("keys"))
    down = Window.partitionBy(*group).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("cum", F.sum("keys").over(down)).withColumn("total", F.sum("keys").over(Window.partitionBy(*group)))
    cum = cum.withColumn("target", F.greatest(F.lit(1), F.floor(F.col("total") * fast / (fast + slow))))
    critical = cum.where("cum >= target").groupBy(*group).agg(F.max(F.struct("bucket", "keys", "cum", "target")).alias("c")).select(*group, "c.*")
    critical = critical.withColumn("rest", F.col("target") - (F.col("cum") - F.col("keys"))).withColumn("coarse", F.pow(F.lit(2), F.col("bucket")).cast("bigint"))
    # The rest-th largest count: cumulate the few distinct counts of the bucket instead of ranking its keys.
    inside = keyed.groupBy(*group, "bucket", F.col(n).alias("n")).agg(F.count("*").alias("k"))
    inside = inside.join(F.broadcast(critical), [*group, "bucket"])
    w = Window.partitionBy(*group).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("upto", F.sum("k").over(w)).where("upto >= rest")
    fine = F.max(F.when(F.col("rest") < F.col("keys"), F.col("n")).otherwise(F.col("coarse")))
    return reached.groupBy(*group, "coarse").agg(fine.cast("bigint").alias("fine"))


def dynamic_threshold(threshold: Column, fill: Column, floor_: int = 2) -> Column:
    """Threshold that grows with the fill ratio of the cache; 0 stays 0."""
    grown = F.ceil(threshold * (ALPHA + (1 - ALPHA) * F.least(F.greatest(fill, F.lit(0.0)), F.lit(1.0)))).cast("bigint")
    return F.when(threshold == 0, F.lit(0)).otherwise(F.greatest(F.lit(floor_), grown))


def first_crossing(stream: DataFrame, key: str, epoch: str, order: str, threshold: int) -> DataFrame:
    """Where in its epoch a key's count first reaches ``threshold``: the admission of a candidate."""
    w = Window.partitionBy(epoch, key).orderBy(order)
    return stream.withColumn("nth", F.row_number().over(w)).where(F.col("nth") == threshold).select(epoch, key, F.col(order).alias("admit_seq"))


def slot_counts(stream: DataFrame, group: list[str] | None = None) -> DataFrame:
    return stream.groupBy(*(group or []), "page_id", "slot_id").agg(F.count("*").alias("n"))


def promotion(slots: DataFrame, threshold: int, full_page_visits: int, slots_per_page: int, scan_mode: bool = False, group: list[str] | None = None) -> DataFrame:
    """Decision for every page (of every ``group``, such as an epoch, at whose end candidates are cleared) from its slot counts, first rule that holds:

    hot_records  a slot reaches the threshold (not in scan mode): these slots
    full_visits  enough visits and no skewed slot: the page
    full_slots   enough distinct slots and no skewed slot: the page
    skew         a slot holds over a tenth of the visits: these slots
    full_scan    in scan mode: the page; otherwise none
    """
    page = slots.groupBy(*(group or []), "page_id").agg(
        F.sum("n").alias("visits"), F.count("*").alias("n_slots"), F.max("n").alias("top"), F.sort_array(F.collect_list(F.struct("slot_id", "n"))).alias("s")
    )
    skew_at = F.greatest(F.lit(1), F.ceil(F.col("visits") * SKEW_RATIO))
    page = page.withColumn("skew_at", skew_at.cast("bigint"))
    skewed = F.col("top") > F.col("skew_at")
    even = ~skewed | F.lit(scan_mode)
    rule = F.when((F.col("top") >= threshold) & F.lit(not scan_mode), "hot_records")
    rule = rule.when((F.col("visits") >= full_page_visits) & even, "full_visits")
    rule = rule.when((F.col("n_slots") >= int(slots_per_page * SLOT_RATIO)) & even, "full_slots")
    rule = rule.when(skewed, "skew").when(F.lit(scan_mode), "full_scan").otherwise("none")
    page = page.withColumn("rule", rule)
    least = F.when(F.col("rule") == "hot_records", F.lit(threshold)).when(F.col("rule") == "skew", F.col("skew_at") + 1)
    chosen = F.when(F.col("rule").startswith("full"), F.lit(slots_per_page)).otherwise(F.size(F.filter("s", lambda x: x["n"] >= least)))
    chosen = F.when(F.col("rule") == "none", F.lit(0)).otherwise(chosen)
    done = F.col("rule").startswith("full") | ((F.col("rule") == "skew") & (chosen == F.col("n_slots")))
    return page.select(*(group or []), "page_id", "visits", "n_slots", "skew_at", "rule", chosen.cast("bigint").alias("promoted"), done.alias("leaves_candidates"))


def harmonic(spark, n: int, theta: float) -> DataFrame:
    """Exact generalized harmonic number as one row (h)."""
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.col("id"), F.lit(-theta))).alias("h"))


def slab_class(size: Column, smallest: int = 24, largest: int = 16384, align: int = 8) -> Column:
    """Aligned entry size; null beyond the largest."""
    aligned = F.greatest(F.lit(smallest), (F.ceil(size / align) * align).cast("bigint"))
    return F.when(aligned <= largest, aligned)


def safe_to_delete(deleted: DataFrame, active: DataFrame) -> DataFrame:
    """Deleted entries with ``safe``: every active worker's epoch is beyond theirs.  One minimum decides for all."""
    least = active.agg(F.min("epoch").alias("__least"))
    return deleted.crossJoin(F.broadcast(least)).withColumn("safe", F.col("__least").isNull() | (F.col("__least") > F.col("epoch"))).drop("__least")


def epoch_histograms(stream: DataFrame, key: str, epoch: str) -> DataFrame:
    """(epoch, bucket, keys): the running histogram after the update of each epoch, up to the last of the stream.

    At an epoch's end every used key's aged counter is put into its bucket, after all buckets
    have moved down by one.  So a key of bucket b counts in bucket b - d of the d-th
    epoch after it, for d = 0 .. b: at most sixteen rows a key, and no loop over epochs."""
    last = stream.agg(F.max(F.col(epoch).cast("bigint")).alias("last"))
    seen = running_counters(stream, key, epoch).select("epoch", log2_bucket(F.col("counter"), TOP_BUCKET).alias("b"))
    moved = seen.groupBy("epoch", "b").agg(F.count("*").alias("k")).select("epoch", "b", "k", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("d"))
    moved = moved.select((F.col("epoch") + F.col("d")).alias("epoch"), (F.col("b") - F.col("d")).alias("bucket"), "k")
    moved = moved.crossJoin(F.broadcast(last)).where("epoch <= last")
    return moved.groupBy("epoch", "bucket").agg(F.sum("k").alias("keys"))


def page_clock(stream: DataFrame, page: str, epoch: str) -> DataFrame:
    """(page, idle, state, tier): what an epoch clock makes of a page after the last epoch.  A used page is hot and in
    DRAM; idle ones cool first, then go down a tier for every two further idle epochs."""
    last = stream.agg(F.max(F.col(epoch).cast("bigint")).alias("__last"))
    used = stream.groupBy(page).agg(F.max(F.col(epoch).cast("bigint")).alias("__used")).crossJoin(F.broadcast(last))
    idle = F.col("__last") - F.col("__used")
    return used.select(
        page, idle.alias("idle"), F.when(idle == 0, "HOT").otherwise("COOL").alias("state"),
        F.when(idle <= 1, "DRAM").when(idle <= 3, "CXL").otherwise("SSD").alias("tier"),
    )
