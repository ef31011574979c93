"""Ordered keyed tables: lookups, range scans, floor and ceiling probes, and set-based mutations.

A ``KeyedTable`` is a DataFrame with declared key columns; its order is the tuple
order of these.  Reads are plain filters on raw key columns, so they reach the scan;
mutations return a new table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count proves it small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class KeyedTable:
    def __init__(self, df: DataFrame, keys: Sequence[str]):
        self.df, self.keys = df, list(keys)
        missing = set(self.keys) - set(df.columns)
        if missing:
            raise ValueError(f"key columns not in the table: {sorted(missing)}")

    @property
    def payload(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    def _with(self, df: DataFrame) -> KeyedTable:
        return KeyedTable(df.select(*self.df.columns), self.keys)

    def _compare(self, key: Sequence, strict_less: bool = False, descending: bool = False) -> Column:
        """Tuple comparison of the key columns with literals: >= (or > with ``strict_less``), mirrored if descending."""
        out = F.lit(not strict_less)
        for name, value in reversed(list(zip(self.keys, key, strict=False))):
            beyond = F.col(name) < value if descending else F.col(name) > value
            out = beyond | ((F.col(name) == value) & out)
        return out

    # Reads

    def lookup(self, *key, fields: Sequence[str] | None = None) -> DataFrame:
        """The row with this key, if any; only ``fields`` if given."""
        rows = self.df
        for name, value in zip(self.keys, key, strict=True):
            rows = rows.where(F.col(name) == value)
        return rows.select(*fields) if fields else rows

    def lookup_many(self, probes: DataFrame) -> DataFrame:
        """Rows whose key is among ``probes`` (columns named as the keys)."""
        return self.df.join(small_side(probes.select(*self.keys).distinct()), self.keys, "left_semi")

    def scan_asc(self, *start, limit: int | None = None, until: Column | None = None) -> DataFrame:
        rows = self.df.where(self._compare(start)) if start else self.df
        rows = rows.where(until) if until is not None else rows
        rows = rows.orderBy(*self.keys)
        return rows.limit(limit) if limit is not None else rows

    def scan_desc(self, *start, limit: int | None = None, until: Column | None = None) -> DataFrame:
        rows = self.df.where(self._compare(start, descending=True)) if start else self.df
        rows = rows.where(until) if until is not None else rows
        rows = rows.orderBy(*(F.col(k).desc() for k in self.keys))
        return rows.limit(limit) if limit is not None else rows

    def prefix(self, *leading, residual: Column | None = None) -> DataFrame:
        """Rows that equal ``leading`` on the first key columns."""
        rows = self.df
        for name, value in zip(self.keys, leading, strict=False):
            rows = rows.where(F.col(name) == value)
        return rows.where(residual) if residual is not None else rows

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def ranges_empty(self, ranges: DataFrame, lo: str | Sequence[str] = "lo", hi: str | Sequence[str] = "hi") -> DataFrame:
        """``ranges`` (columns ``lo`` to ``hi``, inclusive) with ``is_empty``: a ceiling probe of lo that lies beyond hi."""
        lo, hi = _names(lo), _names(hi)
        found = ceiling(self, ranges, lo)
        met = F.struct(*(F.col(k).alias(k) for k in self.keys[: len(hi)]))
        beyond = met > F.struct(*(F.col(h).cast(self.df.schema[k].dataType).alias(k) for k, h in zip(self.keys, hi, strict=False)))
        return found.select(*lo, *hi, (F.col(self.keys[0]).isNull() | beyond).alias("is_empty"))

    def neighbours(self) -> DataFrame:
        """Every key with ``next_key`` and ``prev_key``: values, or structs if the key has several columns."""
        return shifted(self.df.select(*self.keys), self.keys)

    def scan_n(self, probes: DataFrame, probe: str | Sequence[str], n: str, most: int) -> DataFrame:
        """For every probe row, the ``n`` rows (at most ``most``) from the first key >= ``probe``; none for ``n`` below one.

        Rows and distinct probes are placed in one order, so that a row's rank and the rank that a probe begins at come from
        the same pass over the ranges of keys."""
        asked, kinds = _names(probe), [self.df.schema[k].dataType for k in self.keys]
        names = [f"__k{j}" for j in range(len(self.keys))]
        both = _placed(self, probes, asked, self.payload, ask_first=True)
        ranged = _ranges(both, names)
        entries = F.count(F.when(~F.col("__ask"), 1))
        sizes = ranged.groupBy("__g").agg(entries.alias("__n"))
        before = sizes.select("__g", F.coalesce(F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
        upto = Window.partitionBy("__g").orderBy(*names, "__o").rowsBetween(Window.unboundedPreceding, 0)
        ranked = ranged.withColumn("__in", entries.over(upto)).join(F.broadcast(before), "__g").withColumn("__rank", F.col("__in") + F.col("__before"))
        begins = ranked.where("__ask").select(*names[: len(asked)], (F.col("__rank") + 1).alias("__from"))
        at = probes.join(begins, _met(asked, kinds, names), "inner").select(*probes.columns, "__from")
        steps = F.sequence(F.col("__from"), F.col("__from") + F.least(F.col(n), F.lit(most)) - 1)
        steps = at.where(F.col(n) > 0).withColumn("__rank", F.explode(steps)).drop("__from")
        rows = ranked.where("NOT __ask").select("__rank", *(F.col(f"__e.{c}").alias(c) for c in self.df.columns))
        return steps.join(rows, "__rank").drop("__rank")

    # Mutations

    def duplicates(self, rows: DataFrame) -> DataFrame:
        """Rows that an insert would refuse: their key exists."""
        return rows.join(self.df.select(*self.keys), self.keys, "left_semi")

    def insert(self, rows: DataFrame) -> KeyedTable:
        """Rows of new keys are added; of several rows of one key in the batch the least one is (nulls
        count as greatest), the others are refused."""
        fresh = rows.join(self.df.select(*self.keys), self.keys, "left_anti")
        if self.payload:
            least = F.struct(*(c for p in self.payload for c in (F.col(p).isNull().alias(f"__{p}"), F.col(p))))
            one = fresh.groupBy(*self.keys).agg(F.min(least).alias("__row"))
            fresh = one.select(*self.keys, *(F.col(f"__row.{c}").alias(c) for c in self.payload))
        else:
            fresh = fresh.distinct()
        return self._with(self.df.unionByName(fresh.select(*self.df.columns)))

    def append(self, rows: DataFrame, order: Sequence[str]) -> KeyedTable:
        """Rows get the keys after the greatest one, in ``order``; the key is one integer column."""
        if len(self.keys) > 1:
            raise ValueError("append draws keys of one column")
        key = self.keys[0]
        top = self.df.agg(F.coalesce(F.max(key), F.lit(-1)).alias("__top"))
        ranked = global_rank(rows, *order)
        fresh = ranked.crossJoin(F.broadcast(top)).withColumn(key, F.col("__top") + F.col("rank")).drop("__top", "rank")
        return self._with(self.df.unionByName(fresh.select(*self.df.columns)))

    def update(self, deltas: DataFrame) -> KeyedTable:
        """``deltas`` has the key and some payload columns; a null leaves the old value, unknown keys are ignored."""
        changed = [c for c in deltas.columns if c not in self.keys]
        new = deltas.select(*self.keys, *(F.col(c).alias(f"__{c}") for c in changed))
        joined = self.df.join(new, self.keys, "left")
        return self._with(joined.withColumns({c: F.coalesce(f"__{c}", c) for c in changed}))

    def upsert(self, rows: DataFrame) -> KeyedTable:
        kept = self.df.join(rows.select(*self.keys), self.keys, "left_anti")
        return self._with(kept.unionByName(rows.select(*self.df.columns)))

    def remove(self, keys: DataFrame) -> KeyedTable:
        return self._with(self.df.join(keys.select(*self.keys), self.keys, "left_anti"))

    def range_remove(self, lo, hi) -> KeyedTable:
        """Rows with lo <= key <= hi go; bounds are values or tuples, of the first key columns or of all."""
        lo, hi = (b if isinstance(b, tuple | list) else (b,) for b in (lo, hi))
        return self._with(self.df.where(~(self._compare(lo) & self._compare(hi, descending=True))))

    def range_remove_pages(self, lo, hi, per_page: int) -> KeyedTable:
        """Only pages that lie in the range as a whole go, from the page of the first key in it on: if
        that page is partial, none goes."""
        key = self.keys[0]
        paged = self.df.withColumn("__page", F.expr(f"{key} div {per_page}"))
        bounds = paged.groupBy("__page").agg(F.min(key).alias("__min"), F.max(key).alias("__max"))
        inside = bounds.withColumn("__in", (F.col("__min") >= lo) & (F.col("__max") <= hi))
        first = bounds.where(F.col("__max") >= lo).agg(F.min("__page").alias("__first"))
        whole = inside.crossJoin(F.broadcast(first)).where("__in")
        start = inside.crossJoin(F.broadcast(first)).where("__page = __first AND __in").select(F.lit(True).alias("__go"))
        doomed = whole.crossJoin(F.broadcast(start.limit(1))).select("__page")
        return self._with(paged.join(doomed, "__page", "left_anti"))

    def page_stats(self, per_page: int, fanout: int) -> DataFrame:
        """Pages, inner pages, height and free slots of a packed tree over the table."""
        n = self.df.agg(F.count("*").alias("n"))
        leaves = F.ceil(F.col("n") / per_page).cast("bigint")
        level, inner, height = leaves, F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        for _ in range(8):
            more = level > 1
            level = F.when(more, F.ceil(level / fanout).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
            inner = inner + F.when(more, level).otherwise(F.lit(0).cast("bigint"))
            height = height + more.cast("bigint")
        return n.select("n", leaves.alias("leaf_pages"), inner.alias("inner_pages"), height.alias("height"), (leaves * per_page - F.col("n")).alias("free_slots"))


# Order across the whole table without a single task: ranges of keys, and one row a range.

#: Rows of a range, about, and the most ranges; the cuts between them are all that the driver gets.
RANGE_ROWS, MOST_RANGES = 200_000, 4096
#: Not read any more: ranges are found by halving; kept as a name that callers may set.
COARSE = 64


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _cuts(df: DataFrame, keys: Sequence[str]) -> list:
    """Sorted key tuples that cut ``df`` into ranges of about equal numbers of rows, from a sample of bounded size.
    Which keys they are decides how work is dealt out, never what the result is."""
    n = df.count()
    groups = min(MOST_RANGES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS))
    if n < 2 or groups < 2:
        return []
    some = df.select(*keys).sample(min(1.0, 16 * groups / n), seed=7).distinct().orderBy(*keys).collect()
    step = max(1, len(some) // groups)
    return some[step::step]


def _ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``__g``: the range of the key tuple that a row is in, rising with the key.  A range is found among
    the cuts by halving, in compiled steps: a row is compared with at most thirteen of them."""
    cuts = _cuts(df, keys)
    if not cuts:
        return df.withColumn("__g", F.lit(0))
    kinds = [df.schema[k].dataType for k in keys]
    names = [f"k{j}" for j in range(len(keys))]
    every = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(cut, kinds, names, strict=True))) for cut in cuts))
    key = F.struct(*(F.col(k).alias(c) for k, c in zip(keys, names, strict=True)))
    df, step = df.withColumn("__g", F.lit(0)), 1 << (len(cuts).bit_length() - 1)
    while step:
        ahead = F.col("__g") + step
        df = df.withColumn("__g", F.when((ahead <= len(cuts)) & (F.get(every, ahead - 1) <= key), ahead).otherwise(F.col("__g")))
        step >>= 1
    return df


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``__g``, rising with the key columns: groups by which sorting can be dealt out."""
    return _ranges(df, keys)


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank`` from 1 in the given order: ranks inside ranges of the order's columns,
    plus the number of rows in earlier ranges (one row a range)."""
    ranged = _ranges(df, order)
    sizes = ranged.groupBy("__g").agg(F.count("*").alias("__n"))
    before = sizes.select("__g", F.coalesce(F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("__g").orderBy(*order)))
    return inside.join(F.broadcast(before), "__g").withColumn("rank", F.col("rank") + F.col("__before")).drop("__g", "__before")


def rank_within(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``rank`` from 1 inside every ``group``; a group with a third of all rows is ranked in ranges too."""
    ranged = _ranges(df, [group, *order])
    sizes = ranged.groupBy(group, "__g").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(group).alias("__k"), F.col("__g").alias("__h"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = ranged.withColumn("rank", F.row_number().over(Window.partitionBy(group, "__g").orderBy(*order)))
    met = inside.join(before, F.col(group).eqNullSafe(F.col("__k")) & (F.col("__g") == F.col("__h")))
    return met.withColumn("rank", F.col("rank") + F.col("__before")).drop("__g", "__h", "__k", "__before")


def _placed(table: KeyedTable, probes: DataFrame, asked: Sequence[str], keep: Sequence[str], ask_first: bool) -> DataFrame:
    """The table's rows (key columns as ``__k0`` and so on, keys and ``keep`` columns as ``__e``) and the distinct whole
    probe tuples (``__ask``); ``__o`` puts a probe before or after the rows of an equal key."""
    kinds = [table.df.schema[k].dataType for k in table.keys]
    names = [f"__k{j}" for j in range(len(kinds))]
    given = [F.col(a).cast(t).alias(n) for a, t, n in zip(asked, kinds, names, strict=False)]
    open_ = [F.lit(None).cast(t).alias(n) for t, n in zip(kinds[len(asked) :], names[len(asked) :], strict=True)]
    entry = F.struct(*(F.col(k).alias(k) for k in table.keys), *(F.col(c).alias(c) for c in keep))
    keyed = (F.col(k).alias(n) for k, n in zip(table.keys, names, strict=True))
    rows = table.df.select(*keyed, entry.alias("__e"), F.lit(int(ask_first)).alias("__o"), F.lit(False).alias("__ask"))
    whole = " AND ".join(f"{n} IS NOT NULL" for n in names[: len(asked)])
    asks = probes.select(*given, *open_).where(whole).distinct()
    asks = asks.select("*", F.lit(None).cast(rows.schema["__e"].dataType).alias("__e"), F.lit(int(not ask_first)).alias("__o"), F.lit(True).alias("__ask"))
    return rows.unionByName(asks)


def _met(asked: Sequence[str], kinds: Sequence, names: Sequence[str]) -> Column:
    """Probe columns equal placed key columns."""
    on = F.lit(True)
    for a, t, n in zip(asked, kinds, names, strict=False):
        on &= F.col(a).cast(t) == F.col(n)
    return on


def _probe(table: KeyedTable, probes: DataFrame, probe: str | Sequence[str], keep: Sequence[str], up: bool) -> DataFrame:
    """Distinct probe tuples are placed among the keys, so that a frequent probe is one row, and joined back.  A probe
    of fewer columns than the key stands before all keys that begin with it; one with a null column meets nothing."""
    asked, keys = _names(probe), table.keys
    kinds = [table.df.schema[k].dataType for k in keys]
    names = [f"__k{j}" for j in range(len(keys))]
    ranged = _ranges(_placed(table, probes, asked, keep, ask_first=up), names)
    order = [*names, "__o"]
    w = Window.partitionBy("__g").orderBy(*(F.col(c).desc() if up else F.col(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("__near", F.last("__e", ignorenulls=True).over(w)).where("__ask")
    # What an earlier range hands on: its greatest (least) entry; one row a range.
    edge = ranged.where("NOT __ask").groupBy("__g").agg((F.min_by if up else F.max_by)("__e", F.struct(*names)).alias("__edge"))
    cells = inside.select("__g").distinct().join(edge, "__g", "full")
    by = F.col("__g").desc() if up else F.col("__g")
    passed = cells.select("__g", F.last("__edge", ignorenulls=True).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)).alias("__passed"))
    placed = inside.join(F.broadcast(passed), "__g", "left").select(*names[: len(asked)], F.coalesce("__near", "__passed").alias("__m"))
    joined = probes.join(placed, _met(asked, kinds, names), "left")
    return joined.select(*probes.columns, *(F.col(f"__m.{c}").alias(c) for c in (*keys, *keep)))


def floor(table: KeyedTable, probes: DataFrame, probe: str | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every probe with the greatest key <= it (null if none) and ``keep`` columns: an as-of join."""
    return _probe(table, probes, probe, keep, up=False)


def ceiling(table: KeyedTable, probes: DataFrame, probe: str | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every probe with the least key >= it (null if none) and ``keep`` columns."""
    return _probe(table, probes, probe, keep, up=True)


def shifted(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """``df`` with ``next_key`` and ``prev_key``; ranges hand their edges to each other."""
    keys = _names(keys)
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    ranged = _ranges(df, keys).withColumn("__key", key)
    edges = ranged.groupBy("__g").agg(F.min("__key").alias("__lo"), F.max("__key").alias("__hi"))
    w = Window.orderBy("__g")
    edges = edges.select("__g", F.lead("__lo").over(w).alias("__next"), F.lag("__hi").over(w).alias("__prev"))
    inside = Window.partitionBy("__g").orderBy("__key")
    out = ranged.withColumns({"next_key": F.lead("__key").over(inside), "prev_key": F.lag("__key").over(inside)}).join(F.broadcast(edges), "__g")
    return out.withColumns({"next_key": F.coalesce("next_key", "__next"), "prev_key": F.coalesce("prev_key", "__prev")}).drop("__g", "__key", "__next", "__prev")


def beside(df: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """``df`` with ``prev_value`` and ``next_value``: ``order`` of the rows before and after within the key.

    A key's rows are sorted in ranges of ``order``, each a group of its own, and one row a range
    hands its edges on; so a key with a third of all rows is no single task."""
    ranged = _ranges(df, [order])
    edges = ranged.groupBy(*keys, "__g").agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    w = Window.partitionBy(*keys).orderBy("__g")
    edges = edges.select(*keys, "__g", F.lead("__lo").over(w).alias("__next"), F.lag("__hi").over(w).alias("__prev"))
    inside = Window.partitionBy(*keys, "__g").orderBy(order, tie)
    out = ranged.withColumns({"prev_value": F.lag(order).over(inside), "next_value": F.lead(order).over(inside)}).join(edges, [*keys, "__g"])
    return out.withColumns({"prev_value": F.coalesce("prev_value", "__prev"), "next_value": F.coalesce("next_value", "__next")}).drop("__g", "__next", "__prev")


def moved(keys: DataFrame, values: DataFrame, hot: DataFrame, key: str, tid: str) -> tuple[DataFrame, DataFrame]:
    """Key and value tables of a non-clustered relation after ``hot`` keys went to new tuple ids at the end."""
    top = values.agg(F.max(tid).alias("__top"))
    fresh = global_rank(keys.join(hot.select(key), key, "left_semi"), key)
    fresh = fresh.crossJoin(F.broadcast(top)).select(key, tid, (F.col("__top") + F.col("rank")).alias("__new"))
    new_keys = keys.join(fresh.select(key, "__new"), key, "left").withColumn(tid, F.coalesce("__new", tid)).drop("__new")
    new_values = values.join(fresh.select(tid, "__new"), tid, "left").withColumn(tid, F.coalesce("__new", tid)).drop("__new")
    return new_keys, new_values
