"""Building blocks of the workloads: medians of ordered groups, ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.keyed import global_rank, rank_within


def lower_median(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The middle row of every ordered group, the lower of two."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    return ranked.where("__rn = (__n + 1) div 2").drop("__rn", "__n")


def upper_median(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The middle row of every ordered group, the upper of two."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    return ranked.where("__rn = __n div 2 + 1").drop("__rn", "__n")


def stock_after(lines: DataFrame, item: str, start: int) -> DataFrame:
    """Quantity of every item after its order lines (seq, qty) in sequence: taken from stock, or restocked by 91
    when fewer than ten would stay.  The rule is sequential, so an item's lines are folded in one row."""
    per_item = lines.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("seq", "qty"))).alias("l"))
    fold = F.aggregate(
        "l", F.lit(start).cast("bigint"), lambda q, x: F.when(q >= x["qty"] + 10, q - x["qty"]).otherwise(q + 91 - x["qty"])
    )
    return per_item.select(item, fold.alias("quantity"), F.size("l").cast("bigint").alias("order_cnt"))


def place_orders(requests: DataFrame, lines: DataFrame, items: DataFrame, next_order: int = 3001, stock: int = 50) -> dict[str, DataFrame]:
    """A batch of new orders as one transaction each.

    ``requests``: (seq, district, customer, entry); ``lines``: (seq, number, item, supplier, quantity);
    ``items``: (item, price, info).  An order with an item that does not exist is rolled back as a whole and draws no
    number.  Gives ``orders`` (with their lines counted), ``queue`` (open orders), ``lines`` (priced, with the item's
    info for the district) and ``stock`` (after all lines in the order of their requests)."""
    priced = lines.join(items, "item", "left")
    bad = priced.where("price IS NULL").select("seq").distinct()
    kept = requests.join(bad, "seq", "left_anti")
    numbered = rank_within(kept, "district", "seq").withColumn("o_id", (F.col("rank") + (next_order - 1)).cast("bigint")).drop("rank")
    met = priced.join(numbered.select("seq", "district", "o_id"), "seq")
    counts = met.groupBy("seq").agg(F.count("*").alias("ol_cnt"), F.min((F.col("supplier") == F.col("district")).cast("int")).alias("all_local"))
    orders = numbered.join(counts, "seq").select("district", "o_id", "customer", "entry", F.lit(None).cast("int").alias("carrier"), "ol_cnt", "all_local")
    detail = met.select(
        "district", "o_id", "number", "item", "supplier", "quantity", F.round(F.col("quantity") * F.col("price"), 2).alias("amount"),
        F.rpad(F.concat("info", F.lit("-"), F.col("district").cast("string")), 24, "x").alias("dist_info"),
    )
    taken = met.select("item", F.struct("seq", "number").alias("seq"), F.col("quantity").alias("qty"))
    after = stock_after(taken, "item", stock).join(met.groupBy("item").agg(F.sum("quantity").alias("ytd")), "item")
    return {"orders": orders, "queue": orders.select("district", "o_id"), "lines": detail, "stock": after}


def deliver(orders: DataFrame, queue: DataFrame, lines: DataFrame, carrier: int, when) -> dict[str, DataFrame]:
    """Deliver the oldest open order of every district.

    ``orders``: (district, o_id, customer, ...); ``queue``: (district, o_id); ``lines``: (district, o_id, amount, ...).
    The order leaves the queue and gets its carrier, its lines their date, and the customer's balance their sum.
    Gives ``orders``, ``queue``, ``lines`` as they are afterwards, and ``customers``: what to add to whom."""
    oldest = queue.groupBy("district").agg(F.min("o_id").alias("o_id"))
    done = oldest.withColumn("__done", F.lit(True))
    mark = lambda df, column, value: df.join(done, ["district", "o_id"], "left").withColumn(column, F.when(F.col("__done"), F.lit(value))).drop("__done")
    sums = lines.join(oldest, ["district", "o_id"], "left_semi").groupBy("district", "o_id").agg(F.sum("amount").alias("s"))
    paid = orders.join(oldest, ["district", "o_id"], "left_semi").join(sums, ["district", "o_id"], "left")
    customers = paid.groupBy("customer").agg(F.round(F.sum(F.coalesce("s", F.lit(0.0))), 2).alias("balance"), F.count("*").alias("delivery_cnt"))
    return {"orders": mark(orders, "carrier", carrier), "queue": queue.join(oldest, ["district", "o_id"], "left_anti"), "lines": mark(lines, "delivered", when), "customers": customers}


def by_name(index: DataFrame, group: Sequence[str], order: Sequence[str], asked: DataFrame, customers: DataFrame, key: str) -> DataFrame:
    """Customers that ``asked`` (the columns ``group``) names: the name index is joined first, the lower middle one of
    those of a name is taken, and only then is its row fetched."""
    names = index.join(asked.select(*group).distinct(), list(group), "left_semi")
    return lower_median(names, group, order).select(*group, key).join(customers, key)


def rotate(queue: DataFrame, key: str, times: int) -> DataFrame:
    """Keys of a queue after ``times`` pops of the least key, each followed by a push of the greatest plus one."""
    if times < 1:
        return queue.select(key)
    ends = queue.agg(F.max(key).alias("__hi"), F.count("*").alias("__n"))
    kept = global_rank(queue.select(key), key).where(F.col("rank") > times).select(key)
    pushed = ends.where("__n > 0").select(F.explode(F.sequence(F.col("__hi") + F.greatest(F.lit(1), times - F.col("__n") + 1), F.col("__hi") + times)).alias(key))
    return kept.unionByName(pushed)
