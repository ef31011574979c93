"""What the operators of this subpackage share: the staging folder, per-worker caches, row keys."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    ``spark.checkpoint.dir``.  Only a single-process local session, where every
    folder is shared, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="keelson-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: For each thread, the open scopes: paths that were staged inside and are not released yet.
_SCOPES = threading.local()


@contextmanager
def staging():
    """A scope that gathers what is staged inside it, on this thread, so that a caller can release its own tables and
    no one else's: ``with staging() as held: ...; release_all(spark, held, keep)``."""
    open_ = _SCOPES.__dict__.setdefault("open", [])
    held: list[str] = []
    open_.append(held)
    try:
        yield held
    finally:
        open_[:] = [s for s in open_ if s is not held]


def stage(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and
    an executor lost later costs no recomputation."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for held in _SCOPES.__dict__.get("open", []):
        held.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for held in _SCOPES.__dict__.get("open", []):
        if path in held:
            held.remove(path)


def release_all(spark: SparkSession, held: list[str], *keep: str) -> None:
    """Delete the tables of a scope but ``keep``; for callers whose results are written."""
    for path in [p for p in held if p not in keep]:
        release(spark, path)
        if path in held:
            held.remove(path)


def worker_cache(name: str, make: Callable):
    """A value kept for the life of a Python worker.  Pickled-by-value functions
    have no module of their own there, so an always imported module holds it."""
    import pyspark

    kept = pyspark.__dict__.setdefault("_keelson_worker_cache", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def runs(batch, text: str, limit: int):
    """Slices of an Arrow batch whose texts have about ``limit`` bytes together; a longer text is one of its own.  A batch
    has up to 10,000 rows or 64 MB, of which a worker then holds as Python values only one slice."""
    import pyarrow.compute as pc

    start = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if k > start and size + n > limit:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside one expression: a lambda over a one-element array
    keeps Spark from evaluating it again wherever ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """What stands for a text: 32 bytes, so that no two texts are taken for one."""
    return F.unhex(F.sha2(text, 256))


def one_by_key(rows: DataFrame, key: str, value: str, salts: int = 64) -> DataFrame:
    """(key, value), one row a key; all values of a key are equal.  Two steps: the last one gets at most ``salts`` rows of
    a key, where one step alone would send it one from every task that holds a copy."""
    salted = rows.select(key, value, F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"))
    return salted.groupBy(key, "__salt").agg(F.first(value).alias(value)).groupBy(key).agg(F.first(value).alias(value))


def dealt_parts(spark: SparkSession, docs: DataFrame, block_bytes: int) -> tuple[int, int]:
    """(blocks, tasks) for texts dealt into blocks of about ``block_bytes`` bytes: a count of the input's bytes, so a
    task's share does not grow with the input; at least a block and a task for every shuffle partition."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(least, -(-size // block_bytes))
    return blocks, max(least, blocks // 2)


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``doc_id`` as a long in the same order, and the table (number, name) of other types' ids."""
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), None
    names = docs.select(F.col("doc_id").alias("name")).where("name IS NOT NULL").distinct().orderBy("name")
    names, _ = stage(spark, names.select(F.monotonically_increasing_id().alias("number"), "name"), "names")
    joined = docs.withColumnRenamed("doc_id", "name").join(names, "name", "left")
    return joined.select(F.col("number").alias("doc_id"), "text"), names


def named_again(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``rows`` with the ids that ``numbered`` took from them."""
    if names is not None:
        for c in columns:
            held = names.select(F.col("number").alias("__number"), F.col("name").alias("__name"))
            rows = rows.join(held, rows[c] == held["__number"], "left").withColumn(c, F.col("__name")).drop("__number", "__name")
    return rows


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` only when its counted ``rows`` are within ``limit``; otherwise
    the plan stays a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


#: ASCII white space of every contract, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"


def counted(spark: SparkSession, df: DataFrame, name: str, limit: int) -> DataFrame:
    """``df`` staged and counted, and to be broadcast only if it has at most ``limit`` rows."""
    kept, _ = stage(spark, df, name)
    return sized_broadcast(kept, kept.count(), limit)
