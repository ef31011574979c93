"""Generators: skewed keys, placements, names; seeded by row number, so every run agrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import generators
from keelson.functions.scalar import fnv1a_long, fnv1a_text, last_name, nurand, unfolded_int, zip_code
from keelson.functions.scalar import folded_int, folded_text, labelled_bucket, random_text
from keelson.plans.registry import register
from keelson.sources.tables import table

#: FNV-1a of eight little-endian bytes in DuckDB.
FNV = "list_reduce([14695981039346656037::HUGEINT] || [(({0} >> (8 * b)) & 255)::HUGEINT FOR b IN range(0, 8)], lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@register("zeta_exact", "SELECT n, round(sum(pow(i, -0.9)), 8) AS zeta FROM range(100, 2001, 100) a(n), range(1, 2001) r(i) WHERE i <= n GROUP BY n")
def zeta_exact(spark, sf_dir):
    from keelson.operators.observe import zeta

    return spark.range(100, 2001, 100).select(F.col("id").alias("n"), F.round(zeta(F.col("id"), 0.9), 8).alias("zeta"))


@register("zipf_ranks", "WITH z AS (SELECT sum(pow(i, -0.9)) AS zn, sum(pow(i, -0.9)) FILTER (WHERE i <= 2) AS z2 FROM range(1, 1000) r(i)), u AS (SELECT event_id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS u FROM events) SELECT event_id, CAST(CASE WHEN u * zn < 1 THEN 1 WHEN u * zn < 1 + pow(0.5, 0.9) THEN 2 ELSE 1 + floor(999 * pow((1 - pow(2.0 / 999, 0.1)) / (1 - z2 / zn) * u - (1 - pow(2.0 / 999, 0.1)) / (1 - z2 / zn) + 1, 10)) END AS BIGINT) AS rank FROM u, z")
def zipf_ranks(spark, sf_dir):
    """Zipf ranks by the inverse approximation, from uniform numbers."""
    u = (F.col("event_id") * 7919 % 10007) / 10007.0
    return table(spark, sf_dir, "events").select("event_id", generators.zipf_rank(u, 1000, 0.9).alias("rank"))


@register("fnv_hash", f"SELECT event_id, CAST({FNV.format('event_id')} AS VARCHAR) AS fnv FROM events")
def fnv_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fnv1a_long(F.col("event_id")).cast("string").alias("fnv"))


@register("fnv_text", "SELECT p_partkey, CAST(list_reduce([14695981039346656037::HUGEINT] || [ord(c)::HUGEINT FOR c IN string_split(p_brand, '')], lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS fnv FROM part")
def fnv_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fnv1a_text(F.col("p_brand")).cast("string").alias("fnv"))


@register("scrambled_keys", f"SELECT event_id, CAST({FNV.format('(event_id % 97 + 1)')} % 5000 AS BIGINT) AS key FROM events")
def scrambled_keys(spark, sf_dir):
    """Ranks scattered over the key space by hash."""
    return table(spark, sf_dir, "events").select("event_id", generators.scrambled(F.col("event_id") % 97 + 1, 5000).alias("key"))


@register("place_record", f"SELECT event_id, CAST({FNV.format('event_id')} % 300 AS BIGINT) AS page_id, CAST({FNV.format('xor(event_id, 244837814094590)')} % 16 AS BIGINT) AS slot_id FROM events")
def place_record(spark, sf_dir):
    """Record -> (page, slot) by two hashes."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", *generators.placed(F.col("event_id"), 300, 16))


@register("place_dense", "SELECT o_orderkey, o_orderkey // 24 AS page_id, o_orderkey % 24 AS slot_id FROM orders")
def place_dense(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey div 24 AS page_id", "o_orderkey % 24 AS slot_id")


@register("hot_set_keys", "SELECT event_id, CASE WHEN event_id * 31 % 100 < 95 THEN (event_id * 7 % 32) * 317 % 15000 ELSE event_id * 7919 % 15000 END AS key FROM events")
def hot_set_keys(spark, sf_dir):
    """A fixed hot set takes 95 of 100 requests, the rest is uniform."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", generators.hot_set(e * 31 % 100, 95, (e * 7 % 32) * 317 % 15000, e * 7919 % 15000).alias("key"))


@register("latest_keys", "SELECT event_id, 14999 - event_id * 13 % 500 AS key FROM events")
def latest_keys(spark, sf_dir):
    """Rank 0 is the newest key."""
    return table(spark, sf_dir, "events").select("event_id", generators.latest(F.lit(15000), F.col("event_id") * 13 % 500).alias("key"))


@register("nurand", "SELECT event_id, ((event_id * 31 % 1024) | (1 + event_id * 17 % 3000)) + 259 AS raw, (((event_id * 31 % 1024) | (1 + event_id * 17 % 3000)) + 259) % 3000 + 1 AS c_id FROM events")
def nurand_query(spark, sf_dir):
    a, b = F.col("event_id") * 31 % 1024, 1 + F.col("event_id") * 17 % 3000
    return table(spark, sf_dir, "events").select("event_id", (a.bitwiseOR(b) + 259).alias("raw"), nurand(1023, 1, 3000, 259, a, b).alias("c_id"))


@register("except_picker", "SELECT event_id, CASE WHEN event_id * 7 % 24 >= user_id % 25 THEN event_id * 7 % 24 + 1 ELSE event_id * 7 % 24 END AS other FROM events")
def except_picker(spark, sf_dir):
    """A uniform warehouse other than the own one."""
    return table(spark, sf_dir, "events").select("event_id", generators.other_than(F.col("user_id") % 25, F.col("event_id") * 7 % 24).alias("other"))


@register("last_name", "SELECT i, list_extract(s, i // 100 % 10 + 1) || list_extract(s, i // 10 % 10 + 1) || list_extract(s, i % 10 + 1) AS name FROM range(0, 1000) r(i), (SELECT ['BAR', 'OUGHT', 'ABLE', 'PRI', 'PRES', 'ESE', 'ANTI', 'CALLY', 'ATION', 'EING'] AS s)")
def last_name_query(spark, sf_dir):
    return spark.range(1000).select(F.col("id").alias("i"), last_name(F.col("id")).alias("name"))


@register("zip_codes", "SELECT c_custkey, lpad(CAST(c_custkey * 37 % 10000 AS VARCHAR), 4, '0') || '11111' AS zip FROM customer")
def zip_codes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", zip_code(F.col("c_custkey") * 37).alias("zip"))


@register("random_strings", "SELECT c_custkey, 10 + c_custkey % 7 AS n, true AS fits FROM customer")
def random_strings(spark, sf_dir):
    """Random texts have the asked length and alphabet."""
    n = 10 + F.col("c_custkey") % 7
    t = random_text(F.col("c_custkey"), n.cast("int"), "abcdefghij")
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("n"), ((F.length(t) == n) & t.rlike("^[a-j]*$")).alias("fits"))


@register("text_operations", "SELECT n_nationkey, n_name || '-' || n_nationkey AS joined, n_name || '!' AS appended, n_name < 'NATION_2' AS before, n_name = 'NATION_7' AS equal FROM nation")
def text_operations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.concat("n_name", F.lit("-"), "n_nationkey").alias("joined"), F.concat("n_name", F.lit("!")).alias("appended"), (F.col("n_name") < "NATION_2").alias("before"), (F.col("n_name") == "NATION_7").alias("equal"))


@register("fold_roundtrip", "SELECT i - 500 AS i, true AS same, true AS text_order FROM range(0, 1000) r(i)")
def fold_roundtrip(spark, sf_dir):
    i = (F.col("id") - 500).cast("int")
    text = folded_text(F.col("id").cast("string"))
    longer = folded_text(F.concat(F.col("id").cast("string"), F.lit("x")))
    return spark.range(1000).select(i.cast("bigint").alias("i"), (unfolded_int(folded_int(i)) == i).alias("same"), (text < longer).alias("text_order"))


@register("bucket_labels", "SELECT i, CASE WHEN i = 0 THEN '0' WHEN i = 1 THEN '1' WHEN i >= 16384 THEN '>=16384' ELSE (1::BIGINT << (length(bin(i)) - 1)::INTEGER) || '-' || ((2::BIGINT << (length(bin(i)) - 1)::INTEGER) - 1) END AS label FROM range(0, 20000, 7) r(i)")
def bucket_labels(spark, sf_dir):
    return spark.range(0, 20000, 7).select(F.col("id").alias("i"), labelled_bucket(F.col("id")).alias("label"))


@register("bit_popcount", "SELECT user_id, bit_count(bit_or(1::BIGINT << (event_id % 60)::INTEGER)) AS slots FROM events GROUP BY 1")
def bit_popcount(spark, sf_dir):
    """Distinct slots as set bits of one word."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, CAST(event_id % 60 AS INT))"))).cast("tinyint").alias("slots"))


@register("row_checksum")
def row_checksum(spark, sf_dir):
    """CRC-32 of each order's fields, as a log entry's checksum."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.crc32(F.encode(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), "UTF-8")).alias("crc"))


@register("config_hash")
def config_hash_query(spark, sf_dir):
    """One hash per configuration, whatever the order of its columns."""
    from keelson.functions.scalar import config_hash

    c = table(spark, sf_dir, "nation")
    return c.select("n_nationkey", config_hash(["n_nationkey", "n_regionkey", "n_name"]).alias("c_hash"))


SPLITMIX = (
    "WITH s AS (SELECT event_id, ((event_id::HUGEINT + 11400714819323198485) % 18446744073709551616)::UHUGEINT AS z FROM events), "
    "a AS (SELECT event_id, (xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM s), "
    "b AS (SELECT event_id, (xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM a), "
    "c AS (SELECT event_id, xor(z, z // 2147483648::UHUGEINT) AS z FROM b) "
)


@register("splitmix", SPLITMIX + "SELECT event_id, CAST(z AS VARCHAR) AS z FROM c")
def splitmix(spark, sf_dir):
    """Hash of every event's number."""
    return table(spark, sf_dir, "events").select("event_id", generators.splitmix64(F.col("event_id")).cast("string").alias("z"))


@register("uniform_numbers", SPLITMIX + "SELECT event_id, round(z::DOUBLE / 18446744073709551615::DOUBLE, 12) AS u FROM c")
def uniform_numbers(spark, sf_dir):
    """SplitMix64 as numbers between 0 and 1."""
    return table(spark, sf_dir, "events").select("event_id", F.round(generators.next01(F.col("event_id")), 12).alias("u"))


def zipf_sql(n: int, zeta: str) -> str:
    """SQL of Zipf ranks from 0 (k): over ``n`` keys, with ``zeta`` the sum over ranks."""
    return (
        f"z AS (SELECT {zeta} AS zn, 1 + pow(2, -0.9) AS z2), u AS (SELECT event_id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS u FROM events), "
        f"k AS (SELECT event_id, CAST(CASE WHEN u * zn < 1 THEN 0 WHEN u * zn < 1 + pow(0.5, 0.9) THEN 1 ELSE least(floor({n} * pow((1 - pow(2.0 / {n}, 0.1)) / (1 - z2 / zn) * u - (1 - pow(2.0 / {n}, 0.1)) / (1 - z2 / zn) + 1, 10)), {n - 1}) END AS BIGINT) AS rank FROM u, z)"
    )


SUM = "(SELECT sum(pow(i, -0.9)) FROM range(1, {0}) r(i))"


def uniform():
    return (F.col("event_id") * 7919 % 10007) / 10007.0


@register("zipf_ranks_from_zero", f"WITH {zipf_sql(1000, SUM.format(1001))} SELECT event_id, rank FROM k")
def zipf_ranks_from_zero(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", generators.zipf_rank0(uniform(), 1000, 0.9).alias("rank"))


@register("zipf_ranks_approximate", f"WITH {zipf_sql(50000, SUM.format(1001) + ' + (pow(50000, 0.1) - pow(1000, 0.1)) / 0.1')} SELECT event_id, rank FROM k")
def zipf_ranks_approximate(spark, sf_dir):
    """A thousand exact terms, then an integral."""
    return table(spark, sf_dir, "events").select("event_id", generators.zipf_rank0(uniform(), 50000, 0.9, exact=1000).alias("rank"))


MIXED = "(({0})::UHUGEINT * {1}::UHUGEINT) % 18446744073709551616::UHUGEINT"


@register("mixed_keys", f"WITH a AS (SELECT event_id, {MIXED.format('event_id', generators.MIX[0])} AS z FROM events), b AS (SELECT event_id, {MIXED.format('xor(z, z // 8589934592::UHUGEINT)', generators.MIX[1])} AS z FROM a) SELECT event_id, CAST(xor(z, z // 8589934592::UHUGEINT) % 5000::UHUGEINT AS BIGINT) AS key FROM b")
def mixed_keys(spark, sf_dir):
    """Ranks scattered over the key space by a multiplicative mix."""
    return table(spark, sf_dir, "events").select("event_id", generators.mixed(F.col("event_id"), 5000).alias("key"))


@register("growing_keys", f"WITH {zipf_sql(1200, SUM.format(1201))} SELECT event_id, rank + 1 AS rank, CAST({FNV.format('(rank + 1)')} % 1200 AS BIGINT) AS key FROM k")
def growing_keys(spark, sf_dir):
    """Scrambled Zipf keys after the key space has grown from 1,000 to 1,200."""
    zipf = generators.GrowingZipf(1000, 0.9).grow_to(1200)
    return table(spark, sf_dir, "events").select("event_id", zipf.rank(uniform()).alias("rank"), zipf.key(uniform()).alias("key"))
