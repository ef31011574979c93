"""Literal expectations and invariants of the operators on tiny inputs."""

import pytest
from pyspark.sql import functions as F

from keelson.functions.scalar import fnv1a_long, log2_bucket
from keelson.operators import access, observe, simulate
from keelson.operators.keyed import KeyedTable, ceiling, floor
from keelson.operators.versions import VersionLog
from keelson.operators.workloads import lower_median, stock_after, upper_median


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def stream(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, epoch bigint, seq bigint")


def test_sketch_counts_and_aging(spark):
    rows = spark.createDataFrame([(12345,), (12345,), (67890,)], "rec bigint")
    keys = rows.groupBy("rec").agg(F.count("*").alias("n"))
    got = access.estimate(keys, "rec", access.count_min(rows, "rec"))
    assert values(got, "rec", "estimate") == [(12345, 2), (67890, 1)]
    aged = access.aged_counts(stream(spark, [(12345, 0, 1), (12345, 0, 2), (1, 1, 3)]), "page_id", "epoch", 2)
    assert values(aged, "page_id", "aged") == [(1, 1), (12345, 1)]


def test_sketch_never_underestimates(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("rec"))
    keys = rows.groupBy("rec").agg(F.count("*").alias("n"))
    got = access.estimate(keys, "rec", access.count_min(rows, "rec", 4, 64), 4, 64)
    assert got.where("estimate < n").count() == 0


@pytest.mark.parametrize(
    ("value", "bucket"), [(1, 0), (2, 1), (3, 1), (4, 2), (7, 2), (8, 3), (15, 3), (16, 4), (20, 4), (50, 5), (100, 6), (1000, 9), (10000, 13), (1 << 20, 15)]
)
def test_bucket_index(spark, value, bucket):
    assert spark.range(1).select(log2_bucket(F.lit(value))).first()[0] == bucket


def test_bucket_fill_and_reverse_cumulative(spark):
    counts = [1, 1, 1, 2, 3, 3, 5, 7, 7, 7, 10, 15, 20, 20, 20, 100, 100]
    hist = access.histogram(spark.createDataFrame([(c,) for c in counts], "n bigint"), "n")
    assert values(hist, "bucket", "keys") == [(0, 3), (1, 3), (2, 4), (3, 2), (4, 3), (6, 2)]
    given = spark.createDataFrame(list(enumerate([100, 80, 60, 40, 20, 10])), "bucket int, keys bigint")
    cum = dict(values(access.reverse_cumulative(given), "bucket", "at_least"))
    assert (cum[0], cum[2], cum[4]) == (310, 130, 30)


def test_histogram_aging(spark):
    given = spark.createDataFrame(list(enumerate([50, 100, 200, 300, 400])), "bucket int, keys bigint")
    assert values(access.aged_histogram(given), "bucket", "keys") == [(0, 100), (1, 200), (2, 300), (3, 400)]


def test_thresholds_need_data_and_grow_with_scarcity(spark):
    empty = spark.createDataFrame([], "n bigint")
    assert access.thresholds(empty, "n", 1, 1).count() == 0
    counts = spark.range(1, 1001).select(F.col("id").alias("n"))
    fine = [access.thresholds(counts, "n", 1, slow).first()["fine"] for slow in (1, 3, 9)]
    assert fine == sorted(fine) and fine[0] == 501


def test_first_distinct_limit(spark):
    rows = stream(spark, [(k % 1500, 0, k) for k in range(3000)])
    assert access.first_distinct(rows, "page_id", "epoch", "seq", 1024).count() == 1024


def test_promotion_rules_exclude_each_other(spark):
    slots = spark.createDataFrame(
        [(1, s, 40) for s in range(12)] + [(2, 0, 90), (2, 1, 1)] + [(3, s, 2) for s in range(12)] + [(4, 0, 300), *[(4, s, 100) for s in range(1, 12)]],
        "page_id bigint, slot_id bigint, n bigint",
    )
    got = dict(values(access.promotion(slots, 250, 400, 16), "page_id", "rule"))
    assert got == {1: "full_visits", 2: "skew", 3: "full_slots", 4: "hot_records"}
    scan = dict(values(access.promotion(slots, 250, 400, 16, scan_mode=True), "page_id", "rule"))
    assert scan == {1: "full_visits", 2: "full_scan", 3: "full_slots", 4: "full_visits"} or scan[2] == "skew"


def naive_sieve(keys, capacity):
    queue, hand, hits, evictions = [], None, 0, 0  # head first; entries [key, visited]
    for key in keys:
        found = next((e for e in queue if e[0] == key), None)
        if found:
            found[1], hits = True, hits + 1
            continue
        if len(queue) >= capacity:
            at = queue.index(hand) if hand in queue else len(queue) - 1
            while queue[at][1]:
                queue[at][1] = False
                at = at - 1 if at else len(queue) - 1
            hand = queue[at - 1] if at else None
            queue.pop(at)
            evictions += 1
        queue.insert(0, [key, False])
    return hits, evictions


def test_sieve_against_a_plain_list():
    import random

    rng = random.Random(7)
    for _ in range(30):
        keys = [rng.randrange(12) for _ in range(200)]
        assert simulate.sieve(keys, 5) == naive_sieve(keys, 5)


def test_sieve_evicts_cold_first_and_spares_hot():
    assert simulate.sieve([1, 2, 1, 3, 1], 2) == (2, 1)
    assert simulate.lru([1, 2, 1, 3, 2], 2) == (1, 2)


def test_probes_at_edges_and_gaps(spark):
    t = KeyedTable(spark.createDataFrame([(10, "a"), (20, "b"), (500, "c")], "k bigint, v string"), ["k"])
    probes = spark.createDataFrame([(5,), (10,), (15,), (400,), (900,)], "p bigint")
    assert values(floor(t, probes, "p", ["v"]), "p", "k", "v") == [(5, None, None), (10, 10, "a"), (15, 10, "a"), (400, 20, "b"), (900, 500, "c")]
    assert values(ceiling(t, probes, "p"), "p", "k") == [(5, 10), (10, 10), (15, 20), (400, 500), (900, None)]


def test_probes_take_nulls_repeats_and_skewed_keys(spark):
    keys = [*range(100), 10**12, 10**15]
    t = KeyedTable(spark.createDataFrame([(k,) for k in keys], "k bigint"), ["k"])
    probes = spark.createDataFrame([(None,), (50,), (50,), (10**13,), (10**16,), (-1,)], "p bigint")
    assert values(floor(t, probes, "p"), "p", "k") == [(None, None), (-1, None), (50, 50), (50, 50), (10**13, 10**12), (10**16, 10**15)]


def test_scans_take_tuple_order(spark):
    t = KeyedTable(spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int"), ["a", "b"])
    assert [tuple(r) for r in t.scan_asc(1, 1).collect()] == [(1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert [tuple(r) for r in t.scan_desc(1, 1, limit=3).collect()] == [(1, 1), (1, 0), (0, 2)]


def test_empty_table_reads(spark):
    t = KeyedTable(spark.createDataFrame([], "k bigint, v string"), ["k"])
    assert t.lookup(1).count() == 0
    assert floor(t, spark.createDataFrame([(5,)], "p bigint"), "p").first()["k"] is None
    assert t.page_stats(16, 8).first()["n"] == 0


def test_partial_page_stops_page_removal(spark):
    t = KeyedTable(spark.range(100).withColumnRenamed("id", "k"), ["k"])
    assert t.range_remove_pages(10, 60, 10).df.count() == 50
    assert t.range_remove_pages(11, 60, 10).df.count() == 100


def log(spark, rows):
    return VersionLog(spark.createDataFrame(rows, "k int, op string, v double, start_ts long, commit_ts long, worker int, command_id long"), ["k"], ["v"])


def test_snapshots_are_monotone_and_conflicts_take_the_first(spark):
    versions = log(spark, [(1, "I", 1.0, 0, 1, 0, 1), (1, "U", 2.0, 2, 5, 0, 2), (1, "U", 3.0, 3, 6, 1, 3), (2, "I", 9.0, 0, None, 0, 4), (1, "D", None, 7, 8, 0, 5)])
    seen = [values(versions.snapshot(ts), "k", "v") for ts in (1, 2, 6, 7, 9)]
    assert seen == [[], [(1, 1.0)], [(1, 2.0)], [(1, 3.0)], []]
    assert values(versions.conflicts(), "command_id", "blocked_by_ts") == [(3, 5)]
    assert values(versions.snapshot(2, worker=0), "k", "v") == [(2, 9.0)]
    with pytest.raises(ValueError, match="serializable"):
        versions.visible(5, "ser")


def test_reinsert_after_delete(spark):
    versions = log(spark, [(1, "I", 1.0, 0, 1, 0, 1), (1, "D", None, 2, 3, 0, 2), (1, "I", 4.0, 4, 5, 0, 3)])
    assert values(versions.snapshot(9), "k", "v") == [(1, 4.0)]


def test_medians_differ_for_even_groups(spark):
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v int")
    assert lower_median(rows, ["g"], ["v"]).first()["v"] == 2
    assert upper_median(rows, ["g"], ["v"]).first()["v"] == 3


def test_stock_never_runs_out(spark):
    lines = spark.range(2000).select((F.col("id") % 7).alias("i"), F.col("id").alias("seq"), (F.col("id") % 10 + 1).alias("qty"))
    got = stock_after(lines, "i", 50)
    assert got.where("quantity < 10 OR quantity > 101").count() == 0


def test_fnv_of_a_zero(spark):
    assert str(spark.range(1).select(fnv1a_long(F.col("id"))).first()[0]) == "12161962213042174405"


def test_latency_bucket_is_the_lower_bound(spark):
    bounds = observe.LATENCY_BOUNDS
    assert len(bounds) == 37 and list(bounds) == sorted(bounds)
    rows = spark.createDataFrame([(0,), (1,), (11,), (2_000_000,), (9_999_999,)], "us bigint")
    assert [r[0] for r in rows.select(observe.bound_index(F.col("us"))).collect()] == [0, 0, 6, 36, 37]


def test_zeta_tail_is_close_to_the_sum(spark):
    exact = sum(i**-0.9 for i in range(1, 50_001))
    got = spark.range(1).select(observe.zeta(F.lit(50_000), 0.9, exact=1000)).first()[0]
    assert abs(got - exact) < 1e-4


def test_perturbed_parameters_stay_in_bounds():
    from keelson.functions.generators import perturbed

    bounds = {"alpha": (0.1, 0.9, 0.05), "window": (1000, 5000, 500)}
    for seed in range(50):
        got = perturbed({"alpha": 0.5, "window": 4800}, bounds, seed)
        assert 0.1 <= got["alpha"] <= 0.9 and 1000 <= got["window"] <= 5000 and got["window"] % 500 == 0
    assert perturbed({"alpha": 0.5}, bounds, 3) == perturbed({"alpha": 0.5}, bounds, 3)


def test_checksums_and_hashes_equal_other_implementations(spark):
    import zlib

    import xxhash

    from keelson.operators import versions
    from keelson.plans import registry

    sf = "/root/testdata/sf0.001"
    orders = {r.o_orderkey: f"{r.o_orderkey}|{r.o_custkey}|{r.o_orderstatus}" for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    got = {r.o_orderkey: r.crc for r in registry.queries()["row_checksum"](spark, sf).collect()}
    assert got == {k: zlib.crc32(v.encode()) for k, v in orders.items()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    nations = {r.n_nationkey: "\x1f".join(map(str, (r.n_name, r.n_nationkey, r.n_regionkey))) for r in spark.read.parquet(f"{sf}/nation.parquet").collect()}
    got = {r.n_nationkey: r.c_hash for r in registry.queries()["config_hash"](spark, sf).collect()}
    assert got == {k: signed(xxhash.xxh64_intdigest(v.encode(), 42)) for k, v in nations.items()}
    tx = spark.createDataFrame([(1, 7, "U", 5, 9, "a"), (1, 8, "D", 6, None, None), (2, 9, "I", 7, 11, "b")], "worker int, command_id bigint, op string, start_ts bigint, commit_ts bigint, v string")
    entries = versions.wal_entries(tx, ["v"])
    rows = entries.orderBy("worker", "lsn").collect()
    assert [(r.worker, r.lsn, r.kind) for r in rows] == [
        (1, 1, "TX_START"), (1, 2, "DT_SPECIFIC"), (1, 3, "TX_COMMIT"), (1, 4, "TX_START"), (1, 5, "DT_SPECIFIC"), (1, 6, "TX_ABORT"), (2, 1, "TX_START"), (2, 2, "DT_SPECIFIC"), (2, 3, "TX_COMMIT"),
    ]
    text = lambda x: "" if x is None else str(x)
    for r in rows:
        assert r.crc == zlib.crc32("\x1f".join(map(text, (r.worker, r.lsn, r.kind, r.command_id, r.op, r.payload, r.size))).encode())
    broken = versions.checked(entries.withColumn("size", F.col("size") + 1))
    assert not any(r.intact for r in broken.collect()) and all(r.intact for r in versions.checked(entries).collect())


def test_losers_block_nobody(spark):
    from keelson.operators.versions import VersionLog

    rows = [("a", 1, 0, 10), ("a", 2, 5, 12), ("a", 3, 11, 15), ("a", 4, 20, 25), ("b", 5, 0, 30), ("b", 6, 1, 31), ("b", 7, 2, 32), ("b", 8, 3, None)]
    log = spark.createDataFrame([(k, "U", 1, s, c, 0, i) for k, i, s, c in rows], "k string, op string, v int, start_ts bigint, commit_ts bigint, worker int, command_id bigint")
    lost = {(r.command_id, r.blocked_by_ts) for r in VersionLog(log, ["k"], ["v"]).conflicts().collect()}
    assert lost == {(2, 10), (6, 30), (7, 30)}


def test_ranges_are_found_in_two_steps(spark, monkeypatch):
    from keelson.operators import keyed

    monkeypatch.setattr(keyed, "COARSE", 3)
    monkeypatch.setattr(keyed, "RANGE_ROWS", 10)
    rows = [(f"k{i * 37 % 400:03d}", i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b int")
    ranked = keyed.global_rank(df, "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(rows)
    assert sorted(r["rank"] for r in ranked) == list(range(1, 401))
    found = keyed.floor(keyed.KeyedTable(df, ["a", "b"]), spark.createDataFrame([("k0005", 3), ("a", 0), (None, 1), ("zz", 9)], "p string, q int"), ["p", "q"]).collect()
    want = {"k0005": max(r for r in rows if r <= ("k0005", 3)), "a": (None, None), None: (None, None), "zz": max(rows)}
    assert {r.p: (r.a, r.b) for r in found} == want


def test_queue_rotates_beyond_its_length(spark):
    from keelson.operators.workloads import rotate

    queue = spark.createDataFrame([(k,) for k in (3, 5, 9)], "k bigint")
    for times in range(7):
        want = [3, 5, 9]
        for _ in range(times):
            want = [*want[1:], max(want) + 1]
        assert sorted(r.k for r in rotate(queue, "k", times).collect()) == want
    assert rotate(queue.limit(0), "k", 2).count() == 0


def test_grown_key_space_equals_a_new_one():
    from keelson.functions import generators as G

    assert abs(G.GrowingZipf(100, 0.8).grow_to(500).zeta - G.zeta(500, 0.8)) < 1e-9
    assert abs(G.zeta(5000, 0.9, exact=1000) - G.zeta(5000, 0.9)) < 0.01
