"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round relinks edges to the least neighbour and keeps the edge count from
growing; the rounds end at a forest of stars, whose centres are the least nodes.
Minima are taken by partial aggregation and joined back by ordinary shuffled joins,
so a centre with very many edges is combined map-side and its join can be split.
Every round is written to the shared folder, which ends its lineage; nothing is
collected but one row count and checksum per round.  Once a round's counted edges are
at most ``SMALL``, a bound on the memory of one task, one task finishes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.shared import release, stage

#: Edges that one task finishes (sixteen bytes each, some hundred as Python objects).
SMALL = 500_000


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    least = edges.groupBy(F.col(key).alias("k")).agg(F.min(other).alias("m"))
    # The exchange lets the join below deal out both sides itself, and split a hot key.
    return least.hint("rebalance")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = _least(both, "hi", "lo").select("k", F.least("k", "m").alias("m"))
    return edges.join(least, edges["lo"] == least["k"]).select("hi", F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges, "hi", "lo")
    turned = edges.join(least, edges["hi"] == least["k"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    kept = least.select(F.col("k").alias("hi"), F.col("m").alias("lo"))
    return turned.unionByName(kept).distinct()


def _finish(batches):
    """(node, component) of all edges (hi, lo) of a task: trees with the least node at the root."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = root[up]
            k = up
        return k

    for b in batches:
        for hi, lo in zip(b.column("hi").to_pylist(), b.column("lo").to_pylist(), strict=True):
            x, y = find(hi), find(lo)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], ["node", "component"])


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); ``component`` is the
    least node reachable.  Loops, repeated and null-ended edges add nothing."""
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now, path = stage(spark, start, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state[0] <= small:
            return now.coalesce(1).mapInArrow(_finish, "node bigint, component bigint")
        if state == seen:
            break
        seen = state
        nxt, new_path = stage(spark, _small_star(_large_star(now)), "edges")
        release(spark, path)
        now, path = nxt, new_path
    centres = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        centres.select("node", F.col("node").alias("component"))
    )
