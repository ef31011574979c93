"""Versioned tables: an append-only log of row versions, read through snapshots.

Log columns: key columns, ``op`` ('I', 'U' or 'D'), payload columns (null in a 'U'
means unchanged), ``start_ts``, ``commit_ts`` (null: aborted or still open), ``worker``,
``command_id``.  A snapshot is a filter and one grouped maximum per key with map-side
combine; nothing is sorted globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.keyed import beside, cut_by, global_rank, rank_within

LEVELS = ("ru", "rc", "si")


class VersionLog:
    def __init__(self, log: DataFrame, keys: Sequence[str], payload: Sequence[str]):
        self.log, self.keys, self.payload = log, list(keys), list(payload)

    def visible(self, ts: int | None = None, level: str = "si", worker: int | None = None) -> DataFrame:
        """Versions that a reader sees: everything (ru), what is committed (rc), or what was
        committed before ``ts`` (si); a reader's own worker is always visible."""
        if level not in LEVELS:
            raise ValueError(f"isolation level {level!r} is not one of {LEVELS}; serializable reads are not offered")
        if level == "ru":
            return self.log
        seen = F.col("commit_ts").isNotNull()
        if level == "si":
            if ts is None:
                raise ValueError("a snapshot needs its timestamp")
            seen = seen & (F.col("commit_ts") < ts)
        return self.log.where(seen | (F.col("worker") == worker) if worker is not None else seen)

    def snapshot(self, ts: int | None = None, level: str = "si", worker: int | None = None) -> DataFrame:
        """Current row of every live key.  Column by column, the last version that sets it counts."""
        order = F.struct(F.coalesce("commit_ts", F.lit(2**62)).alias("ts"), F.col("command_id").alias("c"))
        rows = self.visible(ts, level, worker).withColumn("__o", order)
        latest = [F.max_by("op", "__o").alias("__op")]
        latest += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__o"))).alias(c) for c in self.payload]
        latest += [F.max("__o").alias("__last")]
        return rows.groupBy(*self.keys).agg(*latest).where("__op <> 'D'").select(*self.keys, *self.payload)

    def merged_scan(self, ts: int) -> DataFrame:
        """Live rows and tombstones under one snapshot, each marked by its side."""
        order = F.struct("commit_ts", "command_id")
        last = self.visible(ts).groupBy(*self.keys).agg(F.max_by("op", order).alias("op"), F.max("commit_ts").alias("commit_ts"))
        return last.select(*self.keys, "commit_ts", F.when(F.col("op") == "D", "graveyard").otherwise("live").alias("side"))

    def conflicts(self) -> DataFrame:
        """Writes that lose: one of the same key that was let through commits after they start.

        A key's writes go by commit time and a loser is undone, so it blocks nobody.  A write that starts after the
        commit just before its own is let through whatever came before it; the writes between two such ones are a run
        of their own, and only inside a run is the rule passed over write by write."""
        done = beside(self.log.where("commit_ts IS NOT NULL"), self.keys, "commit_ts", "command_id")
        sure = F.col("prev_value").isNull() | (F.col("start_ts") >= F.col("prev_value"))
        at = F.struct("commit_ts", "command_id")
        # The latest sure write so far begins the run; ranges of commit times hand theirs on.
        ranged = cut_by(done, "commit_ts").withColumn("__sure", F.when(sure, at))
        inside = Window.partitionBy(*self.keys, "__g").orderBy("commit_ts", "command_id").rowsBetween(Window.unboundedPreceding, 0)
        edges = ranged.groupBy(*self.keys, "__g").agg(F.max("__sure").alias("__last"))
        earlier = Window.partitionBy(*self.keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(*self.keys, "__g", F.max("__last").over(earlier).alias("__passed"))
        runs = ranged.withColumn("__run", F.max("__sure").over(inside)).join(edges, [*self.keys, "__g"])
        runs = runs.withColumn("__run", F.coalesce("__run", "__passed"))
        writes = runs.groupBy(*self.keys, "__run").agg(F.array_sort(F.collect_list(F.struct("commit_ts", "command_id", "start_ts"))).alias("w")).where(F.size("w") > 1)
        kind = "struct<last:bigint,lost:array<struct<command_id:bigint,start_ts:bigint,commit_ts:bigint,blocked_by_ts:bigint>>>"
        start = F.struct(F.lit(None).cast("bigint").alias("last"), F.expr("array()").alias("lost")).cast(kind)

        def step(state: Column, x: Column) -> Column:
            big = lambda c: c.cast("bigint")
            row = F.struct(big(x["command_id"]).alias("command_id"), big(x["start_ts"]).alias("start_ts"), big(x["commit_ts"]).alias("commit_ts"), state["last"].alias("blocked_by_ts"))
            loses = state["last"] > x["start_ts"]
            return F.struct(
                F.when(loses, state["last"]).otherwise(big(x["commit_ts"])).alias("last"), F.when(loses, F.concat(state["lost"], F.array(row))).otherwise(state["lost"]).alias("lost")
            ).cast(kind)

        return writes.select(*self.keys, F.explode(F.aggregate("w", start, step)["lost"]).alias("l")).select(*self.keys, "l.*")

    def chain_length(self, ts: int) -> DataFrame:
        """Versions a reader at ``ts`` walks: the invisible newer ones and the one it gets."""
        newer = F.count(F.when(F.col("commit_ts") >= ts, 1))
        return self.log.where("commit_ts IS NOT NULL").groupBy(*self.keys).agg((newer + 1).alias("chain_length"))

    def purge(self, low_water: int) -> DataFrame:
        """The log without versions superseded before ``low_water`` (no reader can need them)."""
        follows = beside(self.log.where("commit_ts IS NOT NULL"), self.keys, "commit_ts", "command_id")
        return follows.where(F.col("next_value").isNull() | (F.col("next_value") >= low_water)).drop("prev_value", "next_value")

    def classify_tombstones(self, oltp_low: int, olap_low: int) -> DataFrame:
        """Latest-version deletes: drop (no reader), graveyard (only OLAP readers), keep."""
        order = F.struct("commit_ts", "command_id")
        last = self.log.where("commit_ts IS NOT NULL").groupBy(*self.keys).agg(F.max_by("op", order).alias("op"), F.max("commit_ts").alias("commit_ts"))
        fate = F.when(F.col("commit_ts") < F.least(F.lit(oltp_low), F.lit(olap_low)), "drop").when(F.col("commit_ts") < oltp_low, "graveyard").otherwise("keep")
        return last.where("op = 'D'").select(*self.keys, "commit_ts", fate.alias("fate"))

    def fat_tuples(self, workers: int, low_water: int) -> DataFrame:
        """Keys whose versions go into one fat tuple, those with more updates than workers: their updates, the deltas
        that it keeps inline (what some reader from ``low_water`` on can tell apart) and the value before all of them."""
        done = self.log.where("commit_ts IS NOT NULL")
        order = F.struct("commit_ts", "command_id")
        old = F.col("commit_ts") < low_water
        merged = [F.max_by(c, F.when(old & F.col(c).isNotNull(), order)).alias(c) for c in self.payload]
        found = done.groupBy(*self.keys).agg(F.count("*").alias("updates"), F.count(F.when(~old, 1)).alias("deltas"), *merged)
        return found.where(F.col("updates") > workers)

    def compact(self, snapshots: Sequence[int]) -> DataFrame:
        """For every key the newest version before each active snapshot, and newer ones: what some reader can tell apart."""
        done = self.log.where("commit_ts IS NOT NULL")
        # Versions with no snapshot between them and the next are one to every reader.
        between = F.lit(0)
        for s in snapshots:
            between = between + (F.col("commit_ts") < s).cast("int")
        slot = done.withColumn("slot", between)
        order = F.struct("commit_ts", "command_id")
        old = slot.where("slot > 0").groupBy(*self.keys, "slot").agg(F.max_by(F.struct("command_id", "commit_ts"), order).alias("v"))
        old = old.select(*self.keys, "v.command_id", "v.commit_ts")
        return old.unionByName(slot.where("slot = 0").select(*self.keys, "command_id", "commit_ts"))


def watermarks(tx: DataFrame, now: Column) -> DataFrame:
    """Oldest start of any active transaction, oldest OLTP one, newest OLAP one; active: started, not ended at ``now``."""
    active = (F.col("start_ts") <= now) & (F.col("commit_ts").isNull() | (F.col("commit_ts") > now))
    return tx.where(active).agg(
        F.min("start_ts").alias("oldest_any"),
        F.min(F.when(F.col("mode") == "OLTP", F.col("start_ts"))).alias("oldest_oltp"),
        F.max(F.when(F.col("mode") == "OLAP", F.col("start_ts"))).alias("newest_olap"),
    )


def durable(tx: DataFrame, flushed: DataFrame) -> DataFrame:
    """Group commit: a transaction is durable once the least flushed position of all workers has passed it, or at once
    if it read nothing unflushed of another worker.  ``flushed`` has one row per worker."""
    least = flushed.agg(F.min("flushed_ts").alias("min_flushed"), F.min("hardened_ts").alias("min_hardened"))
    ready = ~F.col("remote_dependency") | ((F.col("commit_ts") <= F.col("min_flushed")) & (F.col("start_ts") <= F.col("min_hardened")))
    return tx.where("commit_ts IS NOT NULL").crossJoin(F.broadcast(least)).withColumn("durable", ready)


def draw_timestamps(requests: DataFrame, first: int = 1) -> DataFrame:
    """``requests`` (command_id, begin_seq, end_seq, aborted) with ``start_ts`` and ``commit_ts`` from one clock.

    Every begin and every commit draws the next number in the order of their sequence numbers (a begin before an end,
    then by command); an abort draws none and leaves ``commit_ts`` null."""
    begin = requests.select("command_id", F.col("begin_seq").alias("seq"), F.lit(0).alias("kind"))
    end = requests.where("NOT aborted").select("command_id", F.col("end_seq").alias("seq"), F.lit(1).alias("kind"))
    drawn = global_rank(begin.unionByName(end), "seq", "kind", "command_id").withColumn("ts", F.col("rank") + (first - 1))
    per = drawn.groupBy("command_id").agg(F.max(F.when(F.col("kind") == 0, F.col("ts"))).alias("start_ts"), F.max(F.when(F.col("kind") == 1, F.col("ts"))).alias("commit_ts"))
    return requests.join(per, "command_id")


#: The kinds of log entries, in the order in which a transaction writes them.
WAL_KINDS = ("TX_START", "DT_SPECIFIC", "TX_COMMIT", "TX_ABORT")


def wal_entries(tx: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(worker, lsn, kind, command_id, op, payload, size, crc): every worker's log.

    A transaction writes its start, its change, and its commit or abort, in the order of commands; ``lsn`` counts from 1
    in each worker.  ``crc`` is the CRC-32 of all other fields, and ``checked`` compares it."""
    change = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload))
    end = F.when(F.col("commit_ts").isNotNull(), 2).otherwise(3)
    entries = tx.select("worker", "command_id", "op", change.alias("payload"), F.explode(F.array(F.lit(0), F.lit(1), end)).alias("step"))
    own = F.col("step") == 1
    entries = entries.select(
        "worker", "command_id", "step", F.element_at(F.array(*map(F.lit, WAL_KINDS)), F.col("step") + 1).alias("kind"),
        F.when(own, F.col("op")).alias("op"), F.when(own, F.col("payload")).alias("payload"),
    )
    numbered = rank_within(entries, "worker", "command_id", "step").withColumnRenamed("rank", "lsn").drop("step")
    numbered = numbered.withColumn("size", 32 + F.coalesce(F.octet_length("payload"), F.lit(0)))
    return numbered.withColumn("crc", entry_crc())


def entry_crc() -> Column:
    fields = ("worker", "lsn", "kind", "command_id", "op", "payload", "size")
    return F.crc32(F.encode(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields)), "UTF-8"))


def checked(entries: DataFrame) -> DataFrame:
    """Log entries with ``intact``: whether their fields still give their checksum."""
    return entries.withColumn("intact", F.col("crc") == entry_crc())
