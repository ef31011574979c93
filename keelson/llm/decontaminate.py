"""Operator 2: benchmark decontamination by SimHash of item-sized windows.

Texts and items are lower-cased words of letters and digits; shingles are
``SHINGLE`` words (an item of fewer words is one shingle).  A window of a document is
as long as the item it is held against.

1. A window can only reach the similarity if it shares shingles with an item, so
   document shingles are semi-matched to the items' shingles first; this loses
   nothing and decides only which windows exist.  By the same bound a window needs
   ``2 s / (1 + s)`` of its shingles among the matches, and sliding it to its first
   match loses none, so windows start at matches.
2. Every such window gets a 64-bit SimHash, as every item does.
3. A window meets the items of its length that have one of its rarest shingles, as many
   as a similar item must share at least one of (prefix filtering; lossless), and of
   these the ones within ``radius`` by multi-index blocks: each fingerprint is cut into
   ``BLOCKS`` blocks of eight bits, and two fingerprints within the radius are within
   ``radius // BLOCKS`` bits in some block.  A similarity of 0.8 stands for about ten of
   64 bits, hence the wide default radius; blocks alone would not prune at that radius.
4. Candidates are verified by exact weighted Jaccard similarity over the shingle
   strings, repeats counted.

Everything is DataFrame and SQL functions.  Equal texts are handled once: keys are
SHA-256 digests of the text, so copies cost a partial aggregation and no hot task.  The
item side is broadcast only while its counted rows stay under ``BROADCAST_ROWS``.

Defined results: null and empty texts, and items without words, match nothing; a
document shorter than an item is one clipped window; a very long text is one row,
handled whole (time linear in it, and an unbroken run is one word); repeated documents or
items are each reported once per (doc_id, item_id); null ids are reported as null; empty
tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.shared import counted, let, one_by_key, release_all, sized_broadcast, stage, staging, text_key

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that two similar fingerprints may differ in, and blocks that a fingerprint is cut into.
RADIUS, BLOCKS = 23, 8
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(ws: Column, k: int, key) -> Column:
    """``key`` of every run of ``k`` words of a bound array that has at least ``k``."""
    return F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: key(*(F.get(ws, i + j) for j in range(k))))


def joined(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def by_size(ws: Column, size: Column, key, shingle: int) -> Column:
    """Shingles of ``size`` = 1 .. ``shingle`` words."""
    out = F.when(size == 1, shingled(ws, 1, key))
    for k in range(2, shingle + 1):
        out = out.when(size == k, shingled(ws, k, key))
    return out


def _hashed(k: int):
    """Size and hashed ``k``-word shingles of a bound array, or null if it has too few words."""
    return lambda ws: F.when(F.size(ws) >= k, F.struct(F.size(ws).alias("size"), shingled(ws, k, F.xxhash64).alias("hs")))


def simhash(hashes: str, n: str) -> Column:
    """SimHash of an array column of ``n`` hashes: two 32-bit counters a lane, a bit set by over half."""
    return F.expr(f"""
        element_at(transform(
          array(aggregate({hashes}, array_repeat(0L, 32),
            (a, h) -> zip_with(a, sequence(0, 31), (x, k) -> x + (shiftrightunsigned(h, k) & 4294967297L)))),
          c -> aggregate(sequence(0, 31), 0L, (f, k) -> f
            | if(2 * (get(c, k) & 4294967295L) > {n}, shiftleft(1L, k), 0L)
            | if(2 * shiftrightunsigned(get(c, k), 32) > {n}, shiftleft(1L, k + 32), 0L))), 1)""")


def blocks(fp: str) -> Column:
    """(block number, its bits) for the ``BLOCKS`` blocks of a fingerprint column."""
    wide = 64 // BLOCKS
    return F.array(*(F.expr(f"named_struct('j', {j}, 'bits', shiftrightunsigned({fp}, {j * wide}) & {(1 << wide) - 1}L)") for j in range(BLOCKS)))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles."""
    common = f"""
        if(size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})),
           aggregate(array_distinct({a}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))))"""
    return F.expr(f"element_at(transform(array({common}), i -> i / (size({a}) + size({b}) - i)), 1)")


def item_table(spark: SparkSession, benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One staged row per distinct item text: its length m, shingle size k, shingles and fingerprint."""
    ws = benchmark.select(words(F.col("text")).alias("ws")).where(F.size("ws") > 0).distinct()
    sized = ws.select(F.array_join("ws", " ").alias("item"), "ws", F.size("ws").alias("m"), F.least(F.size("ws"), F.lit(shingle)).alias("k"))
    sized, _ = stage(spark, sized, "items")
    both = sized.select(
        "item", "m", "k",
        by_size(F.col("ws"), F.col("k"), joined, shingle).alias("item_shingles"),
        by_size(F.col("ws"), F.col("k"), F.xxhash64, shingle).alias("hashes"),
    )
    both, _ = stage(spark, both, "items")
    return both.withColumn("item_fp", simhash("hashes", "size(hashes)"))


def windows(spark: SparkSession, docs: DataFrame, items: DataFrame, shingle: int, least: float) -> DataFrame:
    """(text_key, m, k, start, shingles, hashes): the windows that enough matched shingles allow to be similar."""
    keyed = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("text_key"), "text")
    lengths = items.select(F.explode("hashes").alias("h"), "m", "k").distinct()
    n_lengths, sizes = lengths.agg(F.count("*"), F.collect_set("k")).first()
    lengths = sized_broadcast(lengths, n_lengths, BROADCAST_ROWS)
    found = None
    for k in sorted(sizes):
        hashes = let(words(F.col("text")), _hashed(k))
        rows = keyed.select("text_key", hashes.alias("s")).where("s IS NOT NULL")
        rows = rows.select("text_key", F.col("s.size").alias("size"), F.posexplode("s.hs").alias("pos", "h"))
        hit = rows.join(lengths.where(F.col("k") == k), "h").select("text_key", "size", "k", "m", "pos")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = keyed.limit(0).selectExpr("text_key", "0 AS size", "0 AS k", "0 AS m", "0 AS pos")
    # size - k + 1 shingles in the text, n in a window; need of them must match.
    hits = found.groupBy("text_key", "size", "k", "m").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    hits, _ = stage(spark, hits, "hits")
    n_item = F.col("m") - F.col("k") + 1
    total = F.col("size") - F.col("k") + 1
    hits = hits.select("text_key", "m", "k", "at", total.alias("total"), F.least(n_item, total).alias("n"), n_item.alias("n_item"))
    hits = hits.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("n_item")) * least / (1 + least) - 1e-9)).cast("int"))
    starts = F.expr("""
        array_distinct(transform(
          filter(sequence(0, size(at) - need), j -> get(at, j + need - 1) < greatest(get(at, j), 0) + n
                 or get(at, j + need - 1) >= total - n and get(at, j) >= total - n),
          j -> least(get(at, j), total - n)))""")
    starts = F.when(F.size("at") >= F.col("need"), starts)
    chosen = hits.select("text_key", "m", "k", "n", F.explode(starts).alias("start"))
    chosen, _ = stage(spark, chosen, "windows")
    # Dealt out anew between join and aggregate: neither then holds all copies of a text in one task.
    few = counted(spark, chosen.select("text_key").distinct(), "keys", BROADCAST_ROWS)
    texts = one_by_key(keyed.join(few, "text_key", "left_semi").hint("rebalance"), "text_key", "text")
    texts, _ = stage(spark, texts.select("text_key", words(F.col("text")).alias("ws")), "texts")
    cut = chosen.join(texts, "text_key").select("text_key", "m", "k", "start", F.slice("ws", F.col("start") + 1, F.col("n") + F.col("k") - 1).alias("w"))
    cut, _ = stage(spark, cut, "windows")
    return cut.select(
        "text_key", "m", "k", "start",
        by_size(F.col("w"), F.col("k"), joined, shingle).alias("shingles"),
        by_size(F.col("w"), F.col("k"), F.xxhash64, shingle).alias("hashes"),
    )


def contaminated_texts(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """(text_key, item, start_word, n_words, distance, similarity): the best window of every
    distinct text and item that reach the similarity; ``text_key`` stands for the text."""
    items, _ = stage(spark, item_table(spark, benchmark, shingle), "items")
    n_items = items.count()
    made, _ = stage(spark, windows(spark, docs, items, shingle, least), "windows")
    marked = made.withColumn("fp", simhash("hashes", "size(hashes)")).withColumn("window", F.struct("text_key", "m", "start"))
    marked, _ = stage(spark, marked, "windows")
    # Candidates: items that have one of the rarest shingles of a window.
    held = items.select("m", "item", F.explode(F.array_distinct("hashes")).alias("h"))
    often = held.groupBy("m", "h").agg(F.count("*").alias("often"))
    n_often, n_held = often.agg(F.count("*"), F.coalesce(F.sum("often"), F.lit(0))).first()
    often = sized_broadcast(often, n_often, BROADCAST_ROWS)
    tagged = marked.select("window", "m", F.size("hashes").alias("n"), (F.col("m") - F.col("k") + 1).alias("n_item"), F.explode("hashes").alias("h"))
    tagged = tagged.join(often, ["m", "h"], "left").groupBy("window", "m", "n", "n_item")
    rare = tagged.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h"))).alias("s"))
    need = F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("n_item")) * least / (1 + least) - 1e-9)).cast("int")
    asked = rare.select("window", "m", F.explode(F.array_distinct(F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("n") - need + 1)))).alias("s"))
    asked = asked.where("s.often > 0").select("window", "m", "s.h")
    pairs = asked.join(sized_broadcast(held, n_held, BROADCAST_ROWS), ["m", "h"]).select("window", "item").distinct()
    # Multi-index blocks: a pair goes on from the first block in which it is near.
    left = marked.join(pairs, "window").withColumn("b", F.explode(blocks("fp")))
    left = left.select("text_key", "m", "start", "shingles", "fp", "item", "b.j", "b.bits")
    right = items.withColumn("b", F.explode(blocks("item_fp"))).select("item", "item_shingles", "item_fp", "b.j", F.col("b.bits").alias("item_bits"))
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))) <= radius // BLOCKS
    met = left.join(sized_broadcast(right, n_items * BLOCKS, BROADCAST_ROWS), ["item", "j"]).where(near)
    differs = F.col("fp").bitwiseXOR(F.col("item_fp"))
    distance = F.bit_count(differs)
    first, wide = F.lit(True), 64 // BLOCKS
    for j in range(1, BLOCKS):
        block = F.lit(((1 << wide) - 1) << (wide * (j - 1))).cast("long")
        first &= (F.col("j") < j) | (F.bit_count(differs.bitwiseAND(block)) > radius // BLOCKS)
    met = met.where((distance <= radius) & first).withColumn("distance", distance)
    scored = met.withColumn("similarity", similarity("shingles", "item_shingles")).where(F.col("similarity") >= least - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "distance", "m"))
    return scored.groupBy("text_key", "item").agg(best.alias("b")).select(
        "text_key", "item", (-F.col("b.back")).alias("start_word"), F.col("b.m").alias("n_words"), "b.distance", "b.similarity"
    )


def leak_report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity) of every leaked item."""
    with staging() as held:
        ids = benchmark.select("item_id", F.array_join(words(F.col("text")), " ").alias("item")).distinct()
        named = contaminated_texts(spark, docs.select("text"), benchmark).join(ids, "item").drop("item").hint("rebalance")
        named, path = stage(spark, named, "leaks")
        release_all(spark, held, path)
    named = sized_broadcast(named, named.count(), BROADCAST_ROWS)
    owners = docs.select("doc_id", text_key(F.col("text")).alias("text_key"))
    return owners.join(named, "text_key").drop("text_key").distinct()
