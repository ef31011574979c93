"""Operator 1: SimHash near-duplicates by meet-in-the-middle ball hashing.

1. One pass gives every document a 64-bit fingerprint of its word shingles.
2. Equal fingerprints collapse to one row (partial aggregation), so a hot group of
   exact copies is a single row from here on.
3. Every fingerprint emits all variants within half the radius.  Two fingerprints
   within the radius meet at a variant half-way, so grouping by variant finds every
   link; a variant has at most as many members as its ball, whatever the data.  With
   half radius 1 the members are packed as one 64-bit mask of flipped bits, so the
   group is a fixed-size aggregate.
4. A bucket links its members to the least of them.  Members of one ball are within
   twice its radius of each other, so these stars keep every component; the links are
   made distinct and their distance is checked.
5. Connected components of the links, then the least ``doc_id`` of each.

Defined results: null text counts as empty; a text without words has fingerprint
zero, linked like any other; a null ``doc_id`` keeps its row and joins its
component but never names it (a component of null ids only is named null); repeated
rows come back repeated; a very long text is hashed whole, in time linear in it; an empty table gives an empty table; other input columns
are kept by ``with_components`` and result columns win over equal names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.components import connected_components
from keelson.llm.shared import SPACE, counted, let, one_by_key, stage, text_key

SEED = 42
#: Bits of a fingerprint of distinct words.
VIEW_BITS = 48
#: Rows up to which a counted table of keys is broadcast.
BROADCAST_ROWS = 500_000
#: One in so many shingles of a text is the number that two similar texts must share within their prefixes.
SHARE = 20


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: bit set if set in over half of the shingles' XXH64."""
    import numpy as np
    import xxhash

    data = (text or "").encode().lower()  # bytes: A-Z only
    words = data.split()  # bytes: exactly \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        hashed = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashed = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
    h = np.array(hashed, np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        bits = np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint of it."""
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (text, out)), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.drop("__text").schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [n for n in batch.schema.names if n != "__text"]
            made = pa.array((simhash(t.as_py(), shingle) for t in batch.column("__text")), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), made], [*kept, out])

    return source.mapInArrow(run, schema)


def ball(radius: int) -> list[int]:
    """Signed XOR masks of at most ``radius`` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Star links (a, b) that connect fingerprints at ``radius`` or fewer differing bits exactly
    as all pairs would.  ``distinct`` has one row per fingerprint ``fp``; ``radius`` is even."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius is even: each side emits variants within half of it")
    masks = F.array(*(F.lit(m).cast("long") for m in ball(radius // 2)))
    # Each row becomes a whole ball, so rows that fit one task before do not after: deal them out first, by a
    # key of its own, since an exchange on fp itself would be taken for the one that made them distinct.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.repartition(parts, F.xxhash64("fp"))
    variants = distinct.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "m")
    if radius <= 2:
        packed = variants.groupBy("v").agg(F.bit_or("m").alias("bits"), F.max(F.col("m") == 0).alias("self"))
        met = packed.where(F.bit_count("bits") + F.col("self").cast("int") > 1)
        hit = lambda m: F.when(m == 0, F.col("self")).otherwise(F.col("bits").bitwiseAND(m) != 0)
        member_masks = F.filter(masks, hit)
    else:
        met = variants.groupBy("v").agg(F.collect_set("m").alias("ms")).where(F.size("ms") > 1)
        member_masks = F.col("ms")
    members = F.transform(member_masks, lambda m: F.col("v").bitwiseXOR(m))
    star = met.select(members.alias("ms")).select(F.explode("ms").alias("a"), F.array_min("ms").alias("b"))
    return star.where("a <> b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def with_components(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with ``fp`` and ``component_id``, the least ``id_col`` reachable by links."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("fp", "component_id")]
    rows, _ = stage(spark, fingerprints(docs.select(*own), shingle, text), "fingerprints")
    least = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    parts = connected_components(spark, links(rows.select("fp").distinct(), radius))
    placed = least.join(parts, least["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    placed, _ = stage(spark, placed, "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).hint("rebalance")
    by_fp = placed.join(named, "root").select(F.col("fp").alias("k"), "component_id").hint("rebalance")
    return rows.join(by_fp, rows["fp"] == by_fp["k"]).drop("k")


def near_duplicate_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = with_components(spark, docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: fingerprints propose, shingles decide.


def word_views(hashes, views: int) -> list[int]:
    """``views`` fingerprints of ``VIEW_BITS`` bits over the hashes of a text's distinct words: an edited word moves few of
    their bits."""
    import numpy as np

    if not len(hashes):
        return [0] * views
    out = []
    for v in range(views):
        x = (hashes ^ np.uint64(v * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(29))).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).view(">u8")[0]) >> (64 - VIEW_BITS))
    return out


def hashed_words(text: str | None):
    """(hash of every word, hashes of the distinct words) of a text; A-Z count as a-z."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.fromiter(known.values(), np.uint64, len(known))


def shingle_hashes(words, k: int):
    """Distinct hashed ``k``-word shingles of hashed words, as ``shingle_set`` cuts them."""
    import numpy as np

    n, size = max(1, len(words) - k + 1), min(k, len(words))
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def common_shingles(spark: SparkSession, docs: DataFrame, shingle: int):
    """(sorted hashes, counts) of shingles that are common in a sample of texts.  They only set the order
    of shingles in a prefix, which is exact in any order: common ones come last there."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(hashed_words(t.as_py())[0], shingle).view(np.int64))], ["sh"])

    some = docs.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(16)) == 0).select("text").mapInArrow(run, "sh bigint")
    often = some.groupBy("sh").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "sh").limit(100000)
    found = often.toArrow()
    sh, n = found["sh"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(sh)
    return sh[order], n[order]


def must_share(n: Column) -> Column:
    """Shingles that a text of ``n`` shingles must share within its prefix with a similar text of no fewer."""
    return F.greatest(F.lit(1), F.floor(n / SHARE))


def distinct_texts(spark: SparkSession, docs: DataFrame, shingle: int, least: float, views: int) -> tuple[DataFrame, DataFrame]:
    """(rows, texts).  ``rows``: (doc_id, row, text_key) of every document, ``row`` a digest of its other columns.
    ``texts``: one row per distinct text: ``node`` (a number of its own), ``text_key``, ``first`` (none, id, row,
    text_key of its first row), ``views``, ``n`` (its shingles) and ``prefix``, the first of its shingles in one order.

    Texts with a Jaccard similarity of at least ``least`` share ``least`` * n of the n shingles of either, so in any
    one order of all shingles the first t that they share are within the first n - ``least`` * n + t of both: no such
    pair is left out.  t is ``must_share(n)``."""
    import numpy as np

    order = spark.sparkContext.broadcast(common_shingles(spark, docs, shingle))

    def run(batches):
        import pyarrow as pa

        common, often = order.value
        for b in batches:
            made, sizes, parts = [], [], []
            for t in b.column("text"):
                words, known = hashed_words(t.as_py())
                made.append(word_views(known, views))
                h = shingle_hashes(words, shingle)
                count = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    count = np.where(common[at] == h, often[at], 0)
                top = len(h) - int(np.ceil(least * len(h) - 1e-6)) + max(1, len(h) // SHARE)
                parts.append(h[np.lexsort((h, count))][:top].view(np.int64))
                sizes.append(len(h))
            ends = np.cumsum([0, *map(len, parts)])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))
            columns = [*(b.column(n) for n in ("doc_id", "row", "text_key")), pa.array(made, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), prefix]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "text_key", "views", "n", "prefix"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", row_key(docs).alias("row"), text_key(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    schema = f"doc_id {id_type}, row binary, text_key binary, views array<bigint>, n int, prefix array<bigint>"
    marked, _ = stage(spark, marked.mapInArrow(run, schema), "marked")
    # In two steps: the last gets at most 64 rows of a text, not one from every task that holds a copy.
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row", "text_key")
    held = [F.first(c).alias(c) for c in ("views", "n", "prefix")]
    salted = marked.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("text_key", "salt").agg(F.min(first).alias("first"), *held)
    texts = salted.groupBy("text_key").agg(F.min("first").alias("first"), *held)
    texts, _ = stage(spark, texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    return marked.select("doc_id", "row", "text_key"), texts


def row_key(docs: DataFrame) -> Column:
    """A digest of the columns but ``doc_id`` and ``text``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.unhex(F.sha2(F.to_json(F.struct(F.lit(0).alias("0"), *others)), 256))


def candidates(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are within two bits in some view.

    Within a bucket of variants (at most ``VIEW_BITS`` + 1 fingerprints) members are linked to the least and to
    their neighbour; texts with one fingerprint are linked to the least of them."""
    marked = texts.select("node", F.posexplode("views").alias("view", "fp"))
    held = marked.groupBy("view", "fp").agg(F.min("node").alias("rep"))
    held, _ = stage(spark, held, "views")
    equal = marked.join(held.hint("rebalance"), ["view", "fp"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    # One flag per variant: a bit to turn, or the bit above them for the fingerprint itself; the view sits above all.
    flags = F.array(*(F.lit(1 << b).cast("long") for b in range(VIEW_BITS + 1)))
    low = F.lit((1 << VIEW_BITS) - 1).cast("long")
    turned = lambda v, flag: v.bitwiseXOR(flag.bitwiseAND(low))
    dealt = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "view", "fp")
    coded = dealt.select(F.col("fp").bitwiseOR(F.expr(f"shiftleft(CAST(view AS BIGINT), {VIEW_BITS})")).alias("c"), F.explode(flags).alias("flag"))
    packed = coded.select(turned(F.col("c"), F.col("flag")).alias("v"), "flag").groupBy("v").agg(F.bit_or("flag").alias("bits"))
    met = packed.where(F.bit_count("bits") > 1)
    on = F.filter(flags, lambda flag: F.col("bits").bitwiseAND(flag) != 0)
    members = met.select(
        F.expr(f"CAST(shiftright(v, {VIEW_BITS}) AS INT)").alias("view"),
        F.array_sort(F.transform(on, lambda flag: turned(F.col("v"), flag).bitwiseAND(low))).alias("ms"),
    )
    stars = F.transform(F.slice("ms", 2, F.size("ms")), lambda x: F.struct(x.alias("x"), F.element_at("ms", 1).alias("y")))
    steps = F.zip_with(F.slice("ms", 2, F.size("ms")), F.slice("ms", 1, F.size("ms") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    linked = members.select("view", F.explode(F.array_distinct(F.concat(stars, steps))).alias("e")).select("view", "e.x", "e.y").distinct()
    first = held.select("view", F.col("fp").alias("x"), F.col("rep").alias("a"))
    second = held.select("view", F.col("fp").alias("y"), F.col("rep").alias("b"))
    near = linked.join(first, ["view", "x"]).join(second, ["view", "y"]).select("a", "b")
    pairs = near.unionByName(equal).where("a <> b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def shared_prefixes(spark: SparkSession, texts: DataFrame, least: float) -> DataFrame:
    """(sh, node, n, at, rank) for the shingles of every text's prefix that another text's prefix has too, ``at`` their
    places in it; a text that shares fewer than any partner's t has no partner and is left out.  ``rank`` is the number of shingles of the prefix that no
    other text has, negated: the text in the middle of a group of edited copies has the highest."""
    import numpy as np

    def meet(batches):
        import pyarrow as pa

        got = list(batches)
        if not got:
            return
        sh, node, n, place = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(4))
        order = np.lexsort((node, sh))
        sh, node, n, place = sh[order], node[order], n[order], place[order]
        same = np.concatenate(([False], sh[1:] == sh[:-1], [False]))
        on = same[1:] | same[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (sh, node, n, place)], ["sh", "node", "n", "at"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.posexplode("prefix").alias("at", "sh"), "node", "n").select("sh", "node", "n", "at").repartition(parts, "sh")
    rows, _ = stage(spark, rows.mapInArrow(meet, "sh bigint, node bigint, n int, at int"), "prefixes")
    own = rows.groupBy("node").agg(F.count("*").alias("met"), F.first("n").alias("of"))
    rank = (F.col("met") - (F.col("of") - F.ceil(F.lit(least) * F.col("of") - 1e-6) + must_share(F.col("of")))).cast("int")
    able = own.where(F.col("met") >= F.lit(least / SHARE) * F.col("of") - 1)
    ranked, _ = stage(spark, rows.join(able.select("node", rank.alias("rank")).hint("rebalance"), "node"), "ranked")
    return ranked


def verified(spark: SparkSession, docs: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle sets are similar enough."""
    pairs, _ = stage(spark, pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = counted(spark, texts.select("node", "text_key").join(asked, "node"), "wanted", BROADCAST_ROWS)
    # Dealt out anew between join and aggregate: neither then holds all copies of a text in one task.
    keyed = docs.select(text_key(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    cut = one_by_key(keyed.join(wanted, "text_key").hint("rebalance"), "node", "text")
    cut, _ = stage(spark, cut.select("node", shingle_set(F.col("text"), shingle).alias("s")), "shingles")
    met = pairs.join(cut.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(cut.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    found, _ = stage(spark, met.where(same >= least * (F.size("sa") + F.size("sb") - same) - 1e-9).select("a", "b"), "similar")
    return found


def similar_components(spark: SparkSession, docs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(node, component) of the texts that have a similar text, exactly as a comparison of all pairs gives them.

    What the fingerprints propose is compared first, then the texts that share a shingle of their prefixes with
    the middle text of those that have it, then every pair that is still in two components and can be similar by its
    first shared shingle: what either text has from there on must hold all that they share, ``least`` / (1 + ``least``)
    of both sizes.  For the smaller text this is a shorter part of its prefix than for the larger one."""
    links_ = verified(spark, docs, texts, candidates(spark, texts), shingle, least)
    shared = shared_prefixes(spark, texts, least)

    def placed():
        parts, _ = stage(spark, connected_components(spark, links_), "parts")
        at = shared.withColumnRenamed("node", "own").join(parts.hint("rebalance"), F.col("own") == F.col("node"), "left")
        at = at.select("sh", F.col("own").alias("node"), "n", "at", "rank", F.coalesce("component", "own").alias("c"))
        split = at.groupBy("sh").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("rank", "n", "node", "c")).alias("mid"))
        return at, split.where("lo <> hi").hint("rebalance")

    close = lambda x, y: (F.least(x, y) >= least * F.greatest(x, y) - 1e-9)

    def enough(met: DataFrame) -> DataFrame:
        """Pairs (x, y) of ``n`` and ``m`` shingles that share as many as similar texts must."""
        tallied = met.where(close(F.col("n"), F.col("m"))).groupBy("x", "y", "n", "m").agg(F.count("*").alias("met"))
        return tallied.where(F.col("met") >= must_share(F.least("n", "m"))).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    at, split = placed()
    stars = at.join(split.select("sh", "mid"), "sh").where(F.col("c") != F.col("mid.c"))
    stars = enough(stars.select(F.col("node").alias("x"), F.col("mid.node").alias("y"), "n", F.col("mid.n").alias("m")))
    more = verified(spark, docs, texts, stars, shingle, least)
    if not more.isEmpty():
        links_ = links_.unionByName(more)
        at, split = placed()
    open_, _ = stage(spark, at.join(split.select("sh"), "sh", "left_semi").select("sh", "node", "n", (F.col("n") - F.col("at")).alias("left"), "c"), "open")
    shared_least = lambda both: F.ceil(F.lit(least / (1 + least)) * both - 1e-6)
    larger = open_.withColumnRenamed("node", "x").where(F.col("left") >= F.ceil(F.lit(least) * F.col("n") - 1e-6))
    smaller = open_.where(F.col("left") >= shared_least(2 * F.col("n")))
    smaller = smaller.select("sh", F.col("node").alias("y"), F.col("n").alias("m"), F.col("left").alias("rest"), F.col("c").alias("d"))
    rest = larger.hint("rebalance").join(smaller.hint("rebalance"), "sh").where((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") > F.col("y"))))
    rest = rest.where((F.col("c") != F.col("d")) & (F.least("left", "rest") >= shared_least(F.col("n") + F.col("m"))))
    rest = verified(spark, docs, texts, rest.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), shingle, least)
    return connected_components(spark, links_.unionByName(rest))


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, least: float = 0.8, views: int = 3) -> DataFrame:
    """One row of every group of near copies: of the rows with the group's least ``doc_id`` (null counts as
    largest) the one with the least digest; equal rows collapse to one.

    A pair is a link if the sets of its ``shingle``-word shingles have a Jaccard similarity of at least ``least``;
    groups are the components of all links.  Fingerprints of distinct words propose pairs by ball hashing in
    several views, which joins most groups early; prefixes of the shingle sets bring the pairs that are left.
    Exact copies are one text.  Only the rows that go are joined back to the documents."""
    rows, texts = distinct_texts(spark, docs, shingle, least, views)
    parts = similar_components(spark, docs, texts, shingle, least)
    placed = texts.select("node", "text_key", "first").join(parts.withColumnRenamed("node", "met"), F.col("node") == F.col("met"), "left")
    placed, _ = stage(spark, placed.select("text_key", "first", F.coalesce("component", "node").alias("root")), "roots")
    winners = placed.groupBy("root").agg(F.min("first").alias("w"))
    same = F.col("first") == F.col("w")
    winners = placed.join(winners.hint("rebalance"), "root").where(same).select("w.id", "w.row", "w.text_key")
    winners, _ = stage(spark, winners, "winners")
    won = (rows["text_key"] == winners["text_key"]) & (rows["row"] == winners["row"]) & rows["doc_id"].eqNullSafe(winners["id"])
    key = ["text_key", "row", "doc_id"]
    gone = counted(spark, rows.join(winners, won, "left_anti").select(*key).distinct(), "gone", BROADCAST_ROWS)
    kept = rows.join(winners, won, "left_semi").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    twice = counted(spark, kept.select(*key), "twice", BROADCAST_ROWS)
    whole = docs.withColumn("__key", text_key(F.coalesce("text", F.lit("")))).withColumn("__row", row_key(docs))

    def among(some: DataFrame, how: str) -> DataFrame:
        hit = (whole["__key"] == some["text_key"]) & (whole["__row"] == some["row"]) & whole["doc_id"].eqNullSafe(some["doc_id"])
        return whole.join(some, hit, how)

    left = among(gone, "left_anti")
    once = left if twice.isEmpty() else among(gone.unionByName(twice), "left_anti")
    out = once.drop("__key", "__row")
    if not twice.isEmpty():
        # Equal rows: only they are compared as a whole.
        out = out.unionByName(among(twice, "left_semi").drop("__key", "__row").dropDuplicates())
    return out


def shingle_set(text: Column, k: int) -> Column:
    """Distinct hashed ``k``-word shingles of a non-null text (A-Z lower-cased; fewer words: the whole sequence)."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, SPACE), lambda w: w != "")

    def cut(ws: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(k))))
        return F.array_distinct(F.when(F.size(ws) >= k, runs).otherwise(F.array(F.xxhash64(F.array_join(ws, " ")))))

    return let(words, cut)
