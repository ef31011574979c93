"""Operator 10: exact passage removal by blockwise suffix ranking.

Every byte covered by a ``length``-byte string that also starts in a document with a
smaller ``doc_id`` goes.  A full suffix array has one entry per byte, far more than
the data itself, so suffixes are ranked one bucket at a time and only where they can
repeat, with ties settled by precomputed ranks of a cover sample (``suffix_blocks``).
The sample is content-defined instead of an arithmetic difference cover: both put a
sampled position at one distance into any two equal windows, but this one takes one
position in eighteen where a difference cover modulo 32 takes one in five.

1. Documents are dealt into small blocks by a hash of their row.  That exchange is used
   by all later steps.
2. Each block asks every bucket of anchor hashes for its keys (six bytes a key); the
   bucket answers two bits a key: whether another block has it, and whether it is hot.
3. Each block offers the runs of repeating anchors, with their bytes, to the buckets.
   Equal runs of a block collapse to those of its least document.
4. Each bucket ranks its anchors' contexts, names each suffix and finds those that
   start in a smaller document; blocks get the spans back and cut their documents.

A task holds a few blocks or buckets.  Their number follows from the input's bytes, so
neither grows with the input; a passage that many documents share costs its bucket one run a block, and an
anchor in very many different passages is dealt out by window.

Defined results: null text counts as empty; a row with a null ``doc_id`` is neither
smaller nor larger than another, so it keeps all its bytes and removes none; rows
that share an id do not remove from each other; ids of any type that sorts are taken, and
"smaller" is their order; repeated rows get equal results; a very long text is one row of
its block, passed over in chunks; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import suffix_blocks
from keelson.llm.shared import dealt_parts, named_again, numbered
from keelson.llm.suffix_blocks import Block, answer, merged, offers, request, settle, unpack

LENGTH = 50
#: Bytes of text of a block, about.
BLOCK_BYTES = 4 << 20

RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept string"


def _documents(table) -> tuple[list, list[bytes]]:
    import pyarrow as pa

    return table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()


def remove_passages(spark: SparkSession, docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every row of ``docs``;
    ``spans`` are byte offsets, and ``kept`` is the rest with broken characters replaced."""
    suffix_blocks.piece_bytes(length)
    dealt, names = numbered(spark, docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    blocks, buckets = dealt_parts(spark, dealt, BLOCK_BYTES)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(buckets, "block")

    def ask(table):
        import pyarrow as pa

        got = request(Block(*_documents(table)), length, buckets)
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in got], pa.int32()), "block": pa.array([block] * len(got), pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())})

    def reply(table):
        import pyarrow as pa

        got = answer(table.column("blob").to_pylist())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "blob": pa.array(got, pa.binary())})

    def offer(left, right):
        import pyarrow as pa

        rows = []
        if left.num_rows:
            block = left.column("block")[0].as_py()
            answers = dict(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
            got, local = offers(Block(*_documents(left)), answers, length, buckets)
            rows = [(b, block, False, x) for b, x in got]
            if local is not None:
                rows.append((block % buckets, block, True, local))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = {"bucket": pa.int32(), "block": pa.int32(), "settled": pa.bool_(), "blob": pa.binary()}
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})

    def decide(table):
        import pyarrow as pa

        block, done, blob = (table.column(n).to_pylist() for n in ("block", "settled", "blob"))
        rows = [(k, x) for k, d, x in zip(block, done, blob, strict=True) if d]
        todo = [(k, x) for k, d, x in zip(block, done, blob, strict=True) if not d]
        if todo:
            rows += [(k, x) for (k, _), x in zip(todo, settle([x for _, x in todo], length), strict=True) if x is not None]
        return pa.table({"block": pa.array([k for k, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    def cut(left, right):
        import hashlib

        import numpy as np
        import pyarrow as pa

        ids, texts = _documents(left)
        order = Block(ids, texts).order
        spans = [unpack(b, np.int32, np.int64, np.int64) for b in right.column("blob").to_pylist()]
        doc, begin, end = (np.concatenate([s[k] for s in spans]) if spans else np.zeros(0, np.int64) for k in range(3))
        by = np.argsort(doc, kind="stable")
        doc, begin, end = doc[by], begin[by], end[by]
        bounds = np.searchsorted(doc, np.arange(len(order) + 1))
        found = {order[k]: merged(begin[a:b], end[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a}
        rows = []
        for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
            a, b = found.get(k, ((), ()))
            at, rest = 0, []
            for x, y in zip(a, b, strict=True):
                rest.append(t[at:x])
                at = y
            left_over = b"".join([*rest, t[at:]])
            pairs = [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)] if with_text else None
            kept = left_over.decode("utf-8", "replace") if with_text else None
            rows.append((i, len(t), len(t) - len(left_over), len(a), hashlib.sha256(left_over).hexdigest(), pairs, kept))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        pair = pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))
        kinds = [pa.int64()] * 4 + [pa.string(), pair, pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    by_block = dealt.groupBy("block")
    asked = by_block.applyInArrow(ask, "bucket int, block int, blob binary").repartition(buckets, "bucket")
    replies = asked.groupBy("bucket").applyInArrow(reply, "block int, bucket int, blob binary").repartition(buckets, "block")
    offered = by_block.cogroup(replies.groupBy("block")).applyInArrow(offer, "bucket int, block int, settled boolean, blob binary")
    decided = offered.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(decide, "block int, blob binary").repartition(buckets, "block")
    return named_again(by_block.cogroup(decided.groupBy("block")).applyInArrow(cut, RESULT), names, "doc_id")


def passage_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = remove_passages(spark, docs.select("doc_id", "text"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
