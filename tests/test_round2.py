"""Cases of the second round's findings: queries over small made tables against their SQL."""

import duckdb
import pytest

from keelson.plans import registry


@pytest.fixture
def held(spark, tmp_path):
    """Rows of a query over made tables, by Spark and by its SQL; a table is (columns, rows)."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)

    return run


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


def test_scan_of_no_rows_gives_none(spark, monkeypatch):
    from keelson.operators import keyed

    monkeypatch.setattr(keyed, "RANGE_ROWS", 10)
    rows = [(k // 7, k * 3, k * 0.5) for k in range(300)]
    table = keyed.KeyedTable(spark.createDataFrame(rows, "a int, b int, v double"), ["a", "b"])
    asks = [(i, i * 5 % 47, i * 31 % 1000, i % 4 - 1) for i in range(60)] + [(60, None, 3, 2), (61, 3, 3, None), (62, 42, 890, 100)]
    got = table.scan_n(spark.createDataFrame(asks, "i int, p int, q int, n int"), ["p", "q"], "n", 50).select("i", "a", "b", "v").collect()
    want = [(i, *r) for i, p, q, n in asks if p is not None for r in [r for r in rows if r[:2] >= (p, q)][: max(0, n or 0)]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_batch_whose_keys_are_orders_too(held):
    orders = [(1000003, 1, "F", 10.5), (7, 2, "O", 20.25)]
    events = [(1, None, 3, "view", 4.5), (2, None, 3, "view", 3.25), (3, None, 4, "view", None), (4, None, 4, "view", 9.0), (5, None, None, "view", 1.0)]
    got, want = held("insert_batch", orders=(ORDERS, orders), events=(EVENTS, events))
    assert got == want == [(5, 44.0)]


def test_page_clock_counts_epochs_of_a_thousand(held):
    events = [(i, None, 8 * (i % 5), "view", 1.0) for i in range(0, 4000, 7)] + [(4100 + k, None, 8 * k, "view", 1.0) for k in (1, 2)]
    got, want = held("page_clock", events=(EVENTS, events))
    assert got == want and {r[1] for r in got} == {0, 1}


def test_cycles_are_added_in_one_order(held):
    values = {0: 1.0, 1: 1e16, 2: -1e16, 3: None}
    events = [(i, None, 12, "view", values[i]) for i in (2, 0, 3, 1)] + [(9, None, 13, "view", None)]
    got, want = held("metrics_cpu", events=(EVENTS, events))
    assert got == [(0, 0, 1.0, 0.25, "cfg0", 1), (0, 1, None, None, "cfg1", 2)]
    assert [r[:2] for r in got] == [r[:2] for r in want]  # the SQL adds in an order of its own


def test_near_copies_that_are_no_pairs_are_not_all_compared(spark, monkeypatch):
    import random

    from keelson.llm import simhash_dedup

    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = []
    for _ in range(320):
        words = list(base)
        for at in rng.sample(range(150), 4):
            words[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    seen, real = [], simhash_dedup.verified

    def counting(spark, docs, nodes, pairs, shingle, least):
        seen.append(pairs.count())
        return real(spark, docs, nodes, pairs, shingle, least)

    monkeypatch.setattr(simhash_dedup, "verified", counting)
    kept = simhash_dedup.keep_one(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    sets, root = list(map(cut, texts)), list(range(320))
    for a in range(320):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    assert {r.doc_id for r in kept.collect()} == {root.index(r) for r in set(root)}
    assert seen[-1] < 320 * 319 / 2 / 10
