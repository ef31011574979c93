"""Order processing and key/value workloads as set-based transformations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.functions.scalar import SYLLABLES, credit_line
from keelson.functions.scalar import last_name as last_name_of
from keelson.operators.keyed import rank_within
from keelson.operators.workloads import by_name, deliver, lower_median, place_orders, rotate, stock_after
from keelson.plans.registry import register
from keelson.sources.tables import table


@register(
    "stock_level",
    "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, count(DISTINCT l_partkey) AS low_stock FROM r JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE rn <= 20 AND p_size < 20 GROUP BY o_custkey",
)
def stock_level(spark, sf_dir):
    """Distinct items below the threshold in each customer's last twenty orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").desc())
    last = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    low = table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey")
    joined = last.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(low, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("low_stock"))


@register(
    "order_status_latest",
    "WITH l AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS amount FROM l JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
def order_status_latest(spark, sf_dir):
    """Latest order of every customer and its lines."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return latest.join(lines, "o_orderkey").groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@register("customer_lower_median", "WITH r AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) SELECT c_nationkey, c_mktsegment, c_custkey, c_name FROM r WHERE rn = (n + 1) // 2")
def customer_lower_median(spark, sf_dir):
    """By name: the middle customer, the lower one of an even number."""
    return lower_median(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], ["c_name", "c_custkey"]).select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")


@register(
    "payment_apply",
    "SELECT c_custkey, round(c_acctbal - coalesce(s, 0), 2) AS balance, round(coalesce(s, 0), 2) AS ytd_payment, coalesce(n, 0) AS payment_cnt FROM customer LEFT JOIN (SELECT user_id, sum(value) AS s, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = c_custkey",
)
def payment_apply(spark, sf_dir):
    paid = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(paid, "c_custkey", "left")
    s = F.coalesce("s", F.lit(0.0))
    return rows.select("c_custkey", F.round(F.col("c_acctbal") - s, 2).alias("balance"), F.round(s, 2).alias("ytd_payment"), F.coalesce("n", F.lit(0)).alias("payment_cnt"))


@register(
    "warehouse_ytd",
    "SELECT c_nationkey AS w_id, round(sum(value), 2) AS ytd FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' GROUP BY 1",
)
def warehouse_ytd(spark, sf_dir):
    paid = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), "value")
    return paid.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("w_id")), "c_custkey").groupBy("w_id").agg(F.round(F.sum("value"), 2).alias("ytd"))


@register(
    "credit_history",
    "WITH e AS (SELECT user_id, event_id, format('| {:4d} {:2d} {:4d} {:2d} {:4d} ${:7d} {:d}', user_id, user_id % 10, user_id % 25, user_id % 10, user_id % 25, CAST(floor(value) AS BIGINT), event_id) AS line FROM events WHERE event_type = 'purchase') SELECT user_id, substr(string_agg(line, '' ORDER BY event_id DESC), 1, 500) AS c_data FROM e GROUP BY user_id",
)
def credit_history(spark, sf_dir):
    """Every payment puts its line before the history; the whole is cut to 500 characters."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    user = F.col("user_id")
    line = F.format_string("| %4d %2d %4d %2d %4d $%7d %d", user, user % 10, user % 25, user % 10, user % 25, F.floor("value"), F.col("event_id"))
    # A line has 33 characters or more, so the latest sixteen fill the text; every task sends on no more of a user.
    w = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    last = e.select("user_id", "event_id", line.alias("line")).withColumn("nth", F.row_number().over(w)).where("nth <= 16")
    lines = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("h"))
    return lines.select("user_id", F.substring(F.array_join(F.transform("h", lambda x: x["line"]), ""), 1, 500).alias("c_data"))


@register("credit_line_format", "SELECT event_id, format('| {:4d} {:2d} {:4d} {:2d} {:4d} ${:7.2f} {:d}', user_id, 1, 2, 3, 4, CAST(event_id AS DOUBLE) / 4, event_id) AS line FROM events")
def credit_line_format(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = [F.lit(k) for k in (1, 2, 3, 4)]
    return e.select("event_id", credit_line(F.col("user_id"), *one, F.col("event_id").cast("double") / 4, F.col("event_id")).alias("line"))


@register(
    "delivery_oldest",
    "WITH d AS (SELECT o_custkey % 10 AS district, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT district, d.o_orderkey, o_custkey, coalesce(round(sum(l_extendedprice), 2), 0) AS amount FROM d JOIN orders o ON o.o_orderkey = d.o_orderkey LEFT JOIN lineitem ON l_orderkey = d.o_orderkey GROUP BY 1, 2, 3",
)
def delivery_oldest(spark, sf_dir):
    """Oldest open order of every district, its customer and the sum that goes on the balance."""
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select((F.col("o_custkey") % 10).alias("district"), "o_orderkey", "o_custkey")
    oldest = open_.groupBy("district").agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("o")).select("district", "o.*")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return oldest.join(lines, "o_orderkey", "left").select("district", "o_orderkey", "o_custkey", F.coalesce(F.round("s", 2), F.lit(0.0)).alias("amount"))


@register("new_order_ids", "SELECT event_id, user_id % 10 AS district, 3001 + row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS o_id FROM events WHERE event_type = 'purchase'")
def new_order_ids(spark, sf_dir):
    """The next order number of a district plus the place in the batch."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", (F.col("user_id") % 10).alias("district"))
    return rank_within(rows, "district", "event_id").select("event_id", "district", (F.col("rank") + 3000).cast("bigint").alias("o_id"))


@register("new_order_amount", "SELECT l_orderkey, CAST(round(sum(CAST(l_quantity AS DECIMAL(6,2)) * CAST(p_retailprice AS DECIMAL(10,2)) * CAST(1.05 + CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(4,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))), 2) AS DOUBLE) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def new_order_amount(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_tax", "l_discount")
    priced = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    # Decimals: the sum of cents does not depend on the order of its terms.
    rate = lambda x: F.expr(f"CAST({x} AS DECIMAL(4,2))")
    amount = F.col("l_quantity").cast("decimal(6,2)") * F.col("p_retailprice").cast("decimal(10,2)")
    amount = amount * rate("1.05 + CAST(l_tax AS DECIMAL(4,2))") * rate("1 - CAST(l_discount AS DECIMAL(4,2))")
    return priced.groupBy("l_orderkey").agg(F.round(F.sum(amount), 2).cast("double").alias("amount"))


@register(
    "stock_fold",
    "WITH RECURSIVE l AS (SELECT user_id AS i_id, CAST(event_id % 10 + 1 AS BIGINT) AS qty, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), f AS (SELECT DISTINCT i_id, CAST(0 AS BIGINT) AS rn, CAST(50 AS BIGINT) AS q FROM l UNION ALL SELECT l.i_id, l.rn, CASE WHEN q >= qty + 10 THEN q - qty ELSE q + 91 - qty END FROM f JOIN l ON l.i_id = f.i_id AND l.rn = f.rn + 1) SELECT i_id, arg_max(q, rn) AS quantity, CAST(max(rn) AS BIGINT) AS order_cnt FROM f GROUP BY i_id",
)
def stock_fold(spark, sf_dir):
    """Stock after a sequence of orders, with restocking when it would run low."""
    lines = table(spark, sf_dir, "events").selectExpr("user_id AS i_id", "event_id AS seq", "event_id % 10 + 1 AS qty")
    return stock_after(lines, "i_id", 50)


@register("neworder_gap_check", "SELECT o_custkey, count(*) AS gaps FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) WHERE step > 1 GROUP BY 1")
def neworder_gap_check(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    step = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("step"))
    return step.where("step > 1").groupBy("o_custkey").agg(F.count("*").alias("gaps"))


@register("monotone_check", "SELECT count(*) AS out_of_order FROM (SELECT ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) WHERE bad")
def monotone_check(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select((F.col("ts") < F.lag("ts").over(w)).alias("bad")).where("bad").agg(F.count("*").alias("out_of_order"))


@register("load_counts", "SELECT 'customer' AS relation, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def load_counts(spark, sf_dir):
    out = None
    for name in ("customer", "part", "orders", "nation"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("load_verify", "SELECT 'part' AS relation, count(*) AS missing FROM range(0, (SELECT max(p_partkey) + 1 FROM part)) r(k) WHERE k NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'orders', count(*) FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders)) r(k) WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def load_verify(spark, sf_dir):
    """Every key of a dense relation resolves."""
    out = None
    for name, key in (("part", "p_partkey"), ("orders", "o_orderkey")):
        keys = table(spark, sf_dir, name).select(F.col(key).alias("id"))
        top = keys.agg(F.max("id")).first()[0] or -1
        one = spark.range(top + 1).join(keys, "id", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("relation"), "missing")
        out = one if out is None else out.unionByName(one)
    return out


@register("fk_dangling", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)")
def fk_dangling(spark, sf_dir):
    """References into a key space twice as wide as the table: about half of them dangle."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_suppkey") * 2).alias("s_suppkey"))
    return lines.join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", "left_anti").select("l_orderkey", "l_suppkey")


@register("fk_join", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def fk_join(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@register("queue_rotate", "WITH q AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O'), e AS (SELECT max(k) AS hi, count(*) AS n FROM q) SELECT k FROM q WHERE r > 700 UNION ALL SELECT hi + i FROM e, range(1, 701) t(i) WHERE i > 700 - n")
def queue_rotate(spark, sf_dir):
    """Seven hundred pops of the least key, each with a push of the greatest plus one."""
    return rotate(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k")), "k", 700)


SYLLABLE = "list_extract([" + ", ".join(f"'{x}'" for x in SYLLABLES) + "], {0} % 10 + 1)"
LAST = " || ".join(SYLLABLE.format(x) for x in ("({0}) // 100", "({0}) // 10", "({0})"))


@register(
    "customer_by_name",
    f"WITH i AS (SELECT c_nationkey AS district, {LAST.format('c_custkey % 40')} AS name, c_name AS first, c_custkey FROM customer), a AS (SELECT DISTINCT user_id % 25 AS district, {LAST.format('event_id % 90')} AS name FROM events), "
    "m AS (SELECT i.*, row_number() OVER w AS rn, count(*) OVER (PARTITION BY district, name) AS n FROM i JOIN a USING (district, name) WINDOW w AS (PARTITION BY district, name ORDER BY first, c_custkey)) SELECT m.c_custkey, district, name, c_acctbal FROM m JOIN customer c ON c.c_custkey = m.c_custkey WHERE rn = (n + 1) // 2",
)
def customer_by_name(spark, sf_dir):
    """Payments by last name: name index, middle customer, then its row."""
    customer = table(spark, sf_dir, "customer")
    index = customer.select(F.col("c_nationkey").alias("district"), last_name_of(F.col("c_custkey") % 40).alias("name"), F.col("c_name").alias("first"), "c_custkey")
    asked = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("district"), last_name_of(F.col("event_id") % 90).alias("name"))
    return by_name(index, ["district", "name"], ["first", "c_custkey"], asked, customer.select("c_custkey", "c_acctbal"), "c_custkey")


ORDERED = (
    "WITH RECURSIVE req AS (SELECT event_id AS seq, user_id % 10 AS district, user_id AS customer, ts AS entry FROM events WHERE event_type = 'purchase'), "
    "lin AS (SELECT event_id AS seq, j AS number, (event_id * 13 + j * 7) % (SELECT count(*) + 1 FROM part) AS item, (event_id + j) % 12 AS supplier, (event_id + j) % 10 + 1 AS quantity FROM events, range(1, 6) r(j) WHERE event_type = 'purchase' AND j <= 2 + event_id % 4), "
    "pri AS (SELECT lin.*, p_retailprice AS price, p_brand AS info FROM lin LEFT JOIN part ON p_partkey = item), "
    "num AS (SELECT req.*, 3000 + row_number() OVER (PARTITION BY district ORDER BY seq) AS o_id FROM req WHERE seq NOT IN (SELECT seq FROM pri WHERE price IS NULL)), "
    "met AS (SELECT pri.*, district, o_id FROM pri JOIN num USING (seq))"
)


def placed_orders(spark, sf_dir):
    """Purchases as new orders of two to five lines; items run one beyond the parts, so some orders are rolled back."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    requests = bought.selectExpr("event_id AS seq", "user_id % 10 AS district", "user_id AS customer", "ts AS entry")
    part = table(spark, sf_dir, "part")
    n = part.agg((F.count("*") + 1).alias("n"))
    lines = bought.select("event_id", F.explode(F.sequence(F.lit(1).cast("bigint"), 2 + F.col("event_id") % 4)).alias("number")).crossJoin(F.broadcast(n))
    lines = lines.selectExpr("event_id AS seq", "number", "(event_id * 13 + number * 7) % n AS item", "(event_id + number) % 12 AS supplier", "(event_id + number) % 10 + 1 AS quantity")
    return place_orders(requests, lines, part.selectExpr("p_partkey AS item", "p_retailprice AS price", "p_brand AS info"))


@register("place_orders", f"{ORDERED} SELECT district, o_id, customer, entry, CAST(NULL AS INTEGER) AS carrier, count(*) AS ol_cnt, CAST(min(CAST(supplier = district AS INTEGER)) AS INTEGER) AS all_local FROM num JOIN (SELECT seq, supplier FROM pri) USING (seq) GROUP BY ALL")
def place_orders_orders(spark, sf_dir):
    return placed_orders(spark, sf_dir)["orders"]


@register("place_orders_queue", f"{ORDERED} SELECT district, o_id FROM num")
def place_orders_queue(spark, sf_dir):
    return placed_orders(spark, sf_dir)["queue"]


@register("place_orders_lines", f"{ORDERED} SELECT district, o_id, number, item, supplier, quantity, round(quantity * price, 2) AS amount, rpad(info || '-' || district, 24, 'x') AS dist_info FROM met")
def place_orders_lines(spark, sf_dir):
    return placed_orders(spark, sf_dir)["lines"]


@register("place_orders_stock", f"{ORDERED}, l AS (SELECT item, quantity, row_number() OVER (PARTITION BY item ORDER BY seq, number) AS rn FROM met), f AS (SELECT DISTINCT item, CAST(0 AS BIGINT) AS rn, CAST(50 AS BIGINT) AS q FROM l UNION ALL SELECT l.item, l.rn, CASE WHEN q >= quantity + 10 THEN q - quantity ELSE q + 91 - quantity END FROM f JOIN l ON l.item = f.item AND l.rn = f.rn + 1) SELECT item, arg_max(q, rn) AS quantity, CAST(max(rn) AS BIGINT) AS order_cnt, (SELECT CAST(sum(quantity) AS BIGINT) FROM met WHERE met.item = f.item) AS ytd FROM f GROUP BY item")
def place_orders_stock(spark, sf_dir):
    return placed_orders(spark, sf_dir)["stock"]


DELIVERED = "WITH o AS (SELECT o_custkey % 10 AS district, o_orderkey AS o_id, o_custkey AS customer, o_orderstatus FROM orders), old AS (SELECT district, min(o_id) AS o_id FROM o WHERE o_orderstatus = 'O' GROUP BY 1)"


def delivered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 AS district", "o_orderkey AS o_id", "o_custkey AS customer", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_id", "l_linenumber AS number", "l_extendedprice AS amount")
    lines = lines.join(orders.select("district", "o_id"), "o_id")
    queue = orders.where("o_orderstatus = 'O'").select("district", "o_id")
    return deliver(orders.drop("o_orderstatus"), queue, lines, carrier=7, when="1998-12-01")


@register("deliver_orders", f"{DELIVERED} SELECT district, o_id, customer, CASE WHEN (district, o_id) IN (SELECT (district, o_id) FROM old) THEN 7 END AS carrier FROM o")
def deliver_orders(spark, sf_dir):
    return delivered(spark, sf_dir)["orders"]


@register("deliver_queue", f"{DELIVERED} SELECT district, o_id FROM o WHERE o_orderstatus = 'O' EXCEPT SELECT district, o_id FROM old")
def deliver_queue(spark, sf_dir):
    return delivered(spark, sf_dir)["queue"]


@register("deliver_lines", f"{DELIVERED} SELECT o.district, l_orderkey AS o_id, l_linenumber AS number, l_extendedprice AS amount, CASE WHEN old.o_id IS NOT NULL THEN '1998-12-01' END AS delivered FROM lineitem JOIN o ON o.o_id = l_orderkey LEFT JOIN old ON old.o_id = l_orderkey")
def deliver_lines(spark, sf_dir):
    return delivered(spark, sf_dir)["lines"]


@register("deliver_customers", f"{DELIVERED} SELECT customer, round(sum(coalesce(s, 0)), 2) AS balance, count(*) AS delivery_cnt FROM o JOIN old USING (district, o_id) LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_id GROUP BY 1")
def deliver_customers(spark, sf_dir):
    return delivered(spark, sf_dir)["customers"]


@register("kv_transactions", "WITH t AS (SELECT event_id // 4 AS tx, (event_id * 40503 // 16) % 100 < 80 AS reads, event_id * 7919 % 15000 AS key, value FROM events) SELECT tx, count(*) AS ops, count(*) FILTER (WHERE reads) AS n_reads, count(o_orderkey) FILTER (WHERE reads) AS hits, count(*) FILTER (WHERE NOT reads) AS n_updates, round(coalesce(sum(value) FILTER (WHERE NOT reads AND o_orderkey IS NOT NULL), 0), 2) AS written FROM t LEFT JOIN orders ON o_orderkey = key GROUP BY tx")
def kv_transactions(spark, sf_dir):
    """Transactions of four operations each, eighty of a hundred of them reads."""
    ops = table(spark, sf_dir, "events").selectExpr("event_id div 4 AS tx", "(event_id * 40503 div 16) % 100 < 80 AS reads", "event_id * 7919 % 15000 AS key", "value")
    met = ops.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("key"), "left")
    read, hit = F.col("reads"), F.col("o_orderkey").isNotNull()
    return met.groupBy("tx").agg(
        F.count("*").alias("ops"), F.count(F.when(read, 1)).alias("n_reads"), F.count(F.when(read & hit, 1)).alias("hits"), F.count(F.when(~read, 1)).alias("n_updates"),
        F.round(F.coalesce(F.sum(F.when(~read & hit, F.col("value"))), F.lit(0.0)), 2).alias("written"),
    )


#: Operations of a hundred: (until which read, until which update, until which insert, rest), by workload.
MIXES = {"a": (50, 100, 100), "b": (95, 100, 100), "c": (100, 100, 100), "d": (95, 95, 100), "e": (0, 0, 5), "f": (50, 50, 50)}


def mix_query(name: str, read: int, update: int, insert: int):
    rest = "scan" if name == "e" else "read_modify_write"
    key = "max_key - 1 - u % 1000" if name == "d" else "u % (max_key + 1)"
    case = f"CASE WHEN p < {read} THEN 'read' WHEN p < {update} THEN 'update' WHEN p < {insert} THEN 'insert' ELSE '{rest}' END"
    sql = (
        "WITH o AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS u, (event_id * 40503 // 16) % 100 AS p, (SELECT max(o_orderkey) FROM orders) AS max_key FROM events), "
        f"k AS (SELECT {case} AS op, {key} AS key FROM o) SELECT op, count(*) AS n, count(o_orderkey) AS hits, round(coalesce(sum(o_totalprice), 0), 2) AS volume FROM k LEFT JOIN orders ON o_orderkey = key AND op <> 'insert' GROUP BY op"
    )

    def query(spark, sf_dir):
        top = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("max_key"))
        ops = table(spark, sf_dir, "events").selectExpr("event_id", "(event_id * 2654435761) % 4294967296 AS u", "(event_id * 40503 div 16) % 100 AS p")
        ops = ops.crossJoin(F.broadcast(top)).selectExpr(f"{case} AS op", f"{key} AS key")
        base = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
        met = ops.join(base, (F.col("o_orderkey") == F.col("key")) & (F.col("op") != "insert"), "left")
        return met.groupBy("op").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("hits"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("volume"))

    query.__doc__ = f"Key/value workload {name.upper()}: the operation stream met with the table."
    register(f"kv_mix_{name}", sql)(query)


for _name, _mix in MIXES.items():
    mix_query(_name, *_mix)


@register("kv_scans", "WITH s AS (SELECT event_id, event_id * 7919 % 15000 AS start, 1 + event_id * 31 % 100 AS n FROM events), o AS (SELECT o_orderkey, o_totalprice FROM orders) SELECT event_id, count(o_orderkey) AS got, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM s LEFT JOIN o ON o_orderkey BETWEEN start AND start + n - 1 GROUP BY event_id")
def kv_scans(spark, sf_dir):
    """Range scans of up to a hundred keys; keys are dense, so a scan is its list of keys."""
    asks = table(spark, sf_dir, "events").selectExpr("event_id", "event_id * 7919 % 15000 AS start", "1 + event_id * 31 % 100 AS n")
    keys = asks.select("event_id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("o_orderkey"))
    met = keys.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "left")
    return met.groupBy("event_id").agg(F.count("o_totalprice").alias("got"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@register("tx_mix", "SELECT CASE WHEN u < 4300 THEN 'payment' WHEN u < 4700 THEN 'order_status' WHEN u < 5100 THEN 'delivery' WHEN u < 5500 THEN 'stock_level' ELSE 'new_order' END AS tx, count(*) AS n FROM (SELECT (event_id * 7919) % 10000 AS u FROM events) GROUP BY 1")
def tx_mix(spark, sf_dir):
    u = table(spark, sf_dir, "events").selectExpr("(event_id * 7919) % 10000 AS u")
    kind = F.when(F.col("u") < 4300, "payment").when(F.col("u") < 4700, "order_status").when(F.col("u") < 5100, "delivery").when(F.col("u") < 5500, "stock_level").otherwise("new_order")
    return u.groupBy(kind.alias("tx")).agg(F.count("*").alias("n"))


@register("sleepy_reader", "SELECT worker, count(*) AS n, sum(CASE WHEN mode = 'OLAP' THEN 1 ELSE 0 END)::BIGINT AS olap FROM (SELECT user_id % 4 AS worker, CASE WHEN event_id % 50 = 0 THEN 'OLAP' ELSE 'OLTP' END AS mode FROM events) GROUP BY worker")
def sleepy_reader(spark, sf_dir):
    """Transactions a worker, and how many of them hold a long snapshot."""
    from keelson.sources.tables import transactions

    return transactions(spark, sf_dir).groupBy("worker").agg(F.count("*").alias("n"), F.count(F.when(F.col("mode") == "OLAP", 1)).alias("olap"))
