"""Loaders and sinks."""

from pyspark.sql import functions as F

from keelson.operators import observe
from keelson.sources import loaders, sinks


def test_loaded_relations_have_their_sizes_and_keys(spark):
    orders, lines = loaders.orders(spark, 2), loaders.order_lines(spark, 2)
    assert orders.count() == 60_000 and loaders.customers(spark, 2).count() == 60_000
    assert loaders.open_orders(spark, 2).count() == 2 * 10 * 900
    assert orders.groupBy("o_w_id", "o_d_id").agg(F.countDistinct("o_c_id").alias("n")).where("n <> 3000").count() == 0
    assert lines.groupBy("ol_w_id", "ol_d_id", "ol_o_id").count().where("count NOT BETWEEN 5 AND 15").count() == 0
    assert loaders.stock(spark, 1).where("s_quantity NOT BETWEEN 10 AND 100").count() == 0
    assert loaders.items(spark).where("length(i_name) NOT BETWEEN 14 AND 24").count() == 0
    assert loaders.customers(spark, 1).where("c_id = 1 AND c_last <> 'BARBARBAR'").count() == 0


def test_reloads_agree(spark):
    a, b = (loaders.customers(spark, 1).agg(F.sum(F.xxhash64("c_first", "c_last", "c_discount").cast("decimal(38,0)"))).first()[0] for _ in range(2))
    assert a == b


def test_payload_and_foreign_keys(spark):
    assert loaders.kv_rows(spark, 100, 50).where("length(v) <> 50").count() == 0
    big, small = loaders.scaled(spark, 1, rows_per_scale=10_000)
    assert big.join(small, big.s_u_key == small.unscaled_key, "left_anti").count() == 0


def test_metrics_append_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 7)], "t int, c_hash string, tx int")
    for _ in range(2):
        sinks.append_metrics(rows, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.columns == ["t", "c_hash", "tx"] and back.count() == 4


def test_fixed_shapes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3)], "page_id int, slot_id int, slot_hits int")
    sinks.write_shape(rows, "slot_stats", str(tmp_path / "s"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "s")).columns) == sinks.SHAPES["slot_stats"]


def test_log_text_is_parsed(spark, tmp_path):
    (tmp_path / "log").write_text("noise\n\x1b[1madmission_epoch_tick req=7 l1_fine_threshold=2 promotions=3 cleared_candidates=4\nProgress 1.000/20.000, throughput=3.25 Mqps, RC_HR=91.5%\n")
    lines = sinks.read_log(spark, str(tmp_path / "log"))
    assert tuple(observe.parse_epoch_ticks(lines).first()) == (7, 2, 3, 4)
    assert tuple(observe.parse_progress(lines).first()) == (1000, 20000, 3.25, 91.5)
