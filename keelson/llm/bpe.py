"""Operator 9: byte-level BPE encoding and decoding through a distinct-word table.

Texts are split into words, each distinct word is encoded once into a table
(word -> ids), and ids go back to every occurrence by position; decoding joins each
id with its piece and concatenates the bytes.  The tables live in the Python worker
(bounded by ``TABLE_WORDS``, emptied when full), so nothing is shuffled: a global
table joined back through Spark would move one row per word occurrence, which no
disk budget of 1.5 x input holds (figures in the README).  The per-worker table
has no hot keys, and a lost executor costs only its own tasks again.

Defined results: a null text counts as empty (no ids, decodes to ""); a null list of
ids decodes to ""; rows with a null or repeated ``doc_id`` are encoded one by one;
an empty table gives an empty table; other input columns are kept, and ``ids``,
``n_tokens`` or ``decoded`` win over input columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.bpe_core import BLOCK_CHARS, Vocabulary, WordTable, blocks, read_pieces
from keelson.llm.shared import runs, worker_cache

TOKENIZER = "byte_bpe_50k.json"
#: Ids decoded at a time: bounds a worker's memory.
BLOCK_IDS = 250_000


def _with(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    names = {f.name for f in fields}
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names))
    return df, T.StructType([*df.schema.fields, *fields])


def encode(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens`` (long)."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())]
    source = docs.withColumn("__text", F.col(f"`{text}`"))
    source, schema = _with(source if keep_text else source.drop(text), fields)
    schema = T.StructType([f for f in schema.fields if f.name != "__text"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = worker_cache(f"words:{tokenizer}", lambda: WordTable(Vocabulary(tokenizer)))
        for batch in batches:
            texts = [x or "" for x in batch.column("__text").to_pylist()]
            parts = [table.encode(run) for run in blocks(texts)]
            ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
            sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            kept = [n for n in batch.schema.names if n != "__text"]
            arrays = [batch.column(n) for n in kept]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "ids", "n_tokens"])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``encoded`` with ``decoded``: the text of the pieces, invalid UTF-8 replaced as the library does."""
    source, schema = _with(encoded, [T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        piece = worker_cache(f"pieces:{tokenizer}", lambda: read_pieces(tokenizer)[1]).__getitem__
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten()  # without what a null list covers, whose length counts as nothing
            ends = [0, *accumulate(n or 0 for n in pc.list_value_length(lists).to_pylist())]
            texts, row = [], 0
            while row < len(lists):
                stop = max(row + 1, bisect_right(ends, ends[row] + BLOCK_IDS) - 1)
                some, base = flat.slice(ends[row], ends[stop] - ends[row]).to_pylist(), ends[row]
                texts += [b"".join(map(piece, some[ends[k] - base : ends[k + 1] - base])).decode("utf-8", "replace") for k in range(row, stop)]
                row = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` (of the decimal ids, comma-joined) and
    ``decoded_sha256`` (of the decoded text): encoding and decoding in one pass, so ids need not
    leave the worker; ``with_ids`` adds them."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids
    source, schema = _with(docs.withColumn("__text", F.col(f"`{text}`")).drop(text), fields)
    schema = T.StructType([f for f in schema.fields if f.name != "__text"])

    def run(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        table = worker_cache(f"words:{tokenizer}", lambda: WordTable(Vocabulary(tokenizer)))
        piece = table.vocabulary.pieces.__getitem__
        number = worker_cache(f"numbers:{tokenizer}", lambda: [str(k) for k in range(len(table.vocabulary.pieces))]).__getitem__
        for batch in batches:
            for part in runs(batch, "__text", BLOCK_CHARS):  # each leaves as a batch of its own, so ids of a few megabytes are held
                ids, sizes = table.encode([x or "" for x in part.column("__text").to_pylist()])
                rows, flat, at = [], ids.tolist(), 0
                for n in sizes.tolist():
                    own = flat[at : at + n]
                    at += n
                    decoded = b"".join(map(piece, own)).decode("utf-8", "replace").encode()
                    rows.append((n, sha256(",".join(map(number, own)).encode()).hexdigest(), sha256(decoded).hexdigest()))
                del flat
                kept = [n for n in part.schema.names if n != "__text"]
                columns = list(zip(*rows, strict=True))
                made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *made], [*kept, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def round_trip_report(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return digests(docs.select("doc_id", "text"), tokenizer=tokenizer)
