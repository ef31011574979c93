"""Generated relations of the order-processing workload, from row numbers; values are hashes, so reloads agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.scalar import last_name, nurand, random_text, zip_code

DISTRICTS, CUSTOMERS, ITEMS, OLDEST_OPEN = 10, 3000, 100_000, 2101
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _u(seed: str, n: int, *keys: Column) -> Column:
    """Uniform in 0 .. n - 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n))


def customers(spark: SparkSession, warehouses: int) -> DataFrame:
    i = F.col("id")
    rows = spark.range(warehouses * DISTRICTS * CUSTOMERS).select(
        (F.expr(f"id div {DISTRICTS * CUSTOMERS}") + 1).cast("int").alias("c_w_id"),
        (F.expr(f"id div {CUSTOMERS} % {DISTRICTS}") + 1).cast("int").alias("c_d_id"),
        (i % CUSTOMERS + 1).cast("int").alias("c_id"),
    )
    key = [F.col(c) for c in rows.columns]
    by_name = F.when(F.col("c_id") <= 1000, F.col("c_id") - 1).otherwise(nurand(255, 0, 999, 173, _u("a", 256, *key), _u("b", 1000, *key)))
    return rows.select(
        "*", random_text(F.xxhash64(*key), (8 + _u("n", 9, *key)).cast("int"), LETTERS).alias("c_first"), F.lit("OE").alias("c_middle"),
        last_name(by_name).alias("c_last"), zip_code(_u("z", 10000, *key)).alias("c_zip"), F.when(_u("c", 10, *key) == 0, "BC").otherwise("GC").alias("c_credit"),
        F.lit(50000.0).alias("c_credit_lim"), (_u("d", 5001, *key) / 10000.0).alias("c_discount"), F.lit(-10.0).alias("c_balance"), F.lit(10.0).alias("c_ytd_payment"),
        F.lit(1.0).alias("c_payment_cnt"), F.lit(0.0).alias("c_delivery_cnt"),
    )


def orders(spark: SparkSession, warehouses: int) -> DataFrame:
    """One order per customer, customers in hashed order; the last 900 of a district are open."""
    rows = spark.range(warehouses * DISTRICTS * CUSTOMERS).select(
        (F.expr(f"id div {DISTRICTS * CUSTOMERS}") + 1).cast("int").alias("o_w_id"),
        (F.expr(f"id div {CUSTOMERS} % {DISTRICTS}") + 1).cast("int").alias("o_d_id"),
        (F.col("id") % CUSTOMERS + 1).cast("int").alias("o_id"),
    )
    key = [F.col(c) for c in rows.columns]
    # 1013 has no factor in common with 3000: a permutation.
    customer = ((F.col("o_id") * 1013 + F.col("o_d_id") * 7) % CUSTOMERS + 1).cast("int")
    return rows.select("*", customer.alias("o_c_id"), F.when(F.col("o_id") < OLDEST_OPEN, (1 + _u("k", 10, *key)).cast("int")).alias("o_carrier_id"), (5 + _u("l", 11, *key)).cast("int").alias("o_ol_cnt"))


def open_orders(spark: SparkSession, warehouses: int) -> DataFrame:
    return orders(spark, warehouses).where(F.col("o_id") >= OLDEST_OPEN).selectExpr("o_w_id AS no_w_id", "o_d_id AS no_d_id", "o_id AS no_o_id")


def order_lines(spark: SparkSession, warehouses: int) -> DataFrame:
    rows = orders(spark, warehouses).select("o_w_id", "o_d_id", "o_id", "o_carrier_id", F.explode(F.sequence(F.lit(1), F.col("o_ol_cnt"))).alias("ol_number"))
    key = [F.col(c) for c in ("o_w_id", "o_d_id", "o_id", "ol_number")]
    amount = F.when(F.col("o_carrier_id").isNotNull(), 0.0).otherwise((1 + _u("m", 999999, *key)) / 100.0)
    return rows.select(*(c.alias(f"ol_{n}") for c, n in zip(key, ("w_id", "d_id", "o_id", "number"), strict=True)), (1 + _u("i", ITEMS, *key)).cast("int").alias("ol_i_id"), F.lit(5.0).alias("ol_quantity"), amount.alias("ol_amount"))


def items(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    rows = spark.range(1, ITEMS + 1)
    return rows.select(i.cast("int").alias("i_id"), (1 + _u("im", 10000, i)).cast("int").alias("i_im_id"), random_text(i, (14 + _u("w", 11, i)).cast("int"), LETTERS).alias("i_name"), ((100 + _u("p", 9901, i)) / 100.0).alias("i_price"))


def stock(spark: SparkSession, warehouses: int) -> DataFrame:
    i = F.col("id")
    return spark.range(warehouses * ITEMS).select(
        (F.expr(f"id div {ITEMS}") + 1).cast("int").alias("s_w_id"), (i % ITEMS + 1).cast("int").alias("s_i_id"), (10 + _u("q", 91, i)).cast("double").alias("s_quantity"),
        F.lit(0.0).alias("s_ytd"), F.lit(0.0).alias("s_order_cnt"), F.lit(0.0).alias("s_remote_cnt"),
    )


def kv_rows(spark: SparkSession, n: int, payload: int = 100) -> DataFrame:
    """Dense keys with opaque payloads of ``payload`` bytes."""
    blocks = -(-payload // 32)
    data = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256) for k in range(blocks)))
    return spark.range(n).select(F.col("id").alias("k"), F.unhex(F.substring(data, 1, 2 * payload)).alias("v"))


def scaled(spark: SparkSession, scale: int, unscaled_rows: int = 100, rows_per_scale: int = 1_160_000) -> tuple[DataFrame, DataFrame]:
    """A large relation with a foreign key into a small one."""
    big = spark.range(scale * rows_per_scale).select(F.col("id").cast("int").alias("scaled_key"), (F.col("id") % unscaled_rows + 1).cast("int").alias("s_u_key"), (F.col("id") * 0.5).alias("s_num"))
    small = spark.range(1, unscaled_rows + 1).select(F.col("id").cast("int").alias("unscaled_key"), (F.col("id") * 2).cast("int").alias("u_int"))
    return big, small
