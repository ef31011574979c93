"""Operator 3: exact token counts by prefix dynamic programming.

For a word, ``PrefixTable`` holds the number of tokens of *every* byte prefix.  The
encoding of a prefix ends in exactly one token, and that token is the one whose
bytes end the prefix and which may follow the last token of the shorter prefix it
leaves; two tokens may follow each other if encoding their joint bytes gives just
them.  So one left-to-right pass with a look back over the pieces that end here
gives every count.  Words are independent, so the counts of a text are the running
sum of its words plus the prefix entry inside the last one.  Count, truncation and
budget questions are then reads of these sums; nothing is encoded again.

Everything runs map-side (no shuffle); the table is a bounded per-worker cache.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null or repeated
``doc_id``s are counted row by row; a very long text is counted whole, a giant word in time
linear in it (the table is bounded in words, so a few giant ones fit); an empty table gives an empty table; input
columns other than the text are kept, and result columns win over equal names.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.bpe_core import TABLE_WORDS, Vocabulary
from keelson.llm.shared import worker_cache

TOKENIZER = "byte_bpe_50k.json"


#: Words that begin with the same bytes share the entries of these.
HEAD = 6


class PrefixTable:
    """Token counts of every byte prefix of a word, and of every prefix of a text."""

    def __init__(self, vocabulary: Vocabulary, limit: int = TABLE_WORDS):
        self.vocabulary, self.limit = vocabulary, limit
        self.prefix: dict[str, bytes | tuple] = {}
        self.heads: dict[bytes, tuple] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.summed: tuple[str, list[int]] = ("", [0])

    def may_follow(self, a: int, b: int) -> bool:
        got = self.follows.get((a, b))
        if got is None:
            if len(self.follows) > 4 * self.limit:
                self.follows.clear()
            p = self.vocabulary.pieces
            got = self.follows[a, b] = self.vocabulary.merge(p[a] + p[b]) == [a, b]
        return got

    def is_alone(self, a: int) -> bool:
        got = self.alone.get(a)
        if got is None:
            got = self.alone[a] = self.vocabulary.merge(self.vocabulary.pieces[a]) == [a]
        return got

    def counts(self, data: bytes) -> tuple:
        """counts[i]: tokens of ``data[:i]``, for i = 0 .. len(data)."""
        head = data[:HEAD]
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) > self.limit:
                self.heads.clear()
            last, count = [-1], [0]
            self._continue(head, last, count)
            known = self.heads[head] = (tuple(last), tuple(count))
        if len(data) <= HEAD:
            return known[1]
        last, count = list(known[0]), list(known[1])
        self._continue(data, last, count)
        return tuple(count)

    def _continue(self, data: bytes, last: list[int], count: list[int]) -> None:
        """Extend last tokens and counts of the prefixes of ``data`` to all of it."""
        token_of, longest, follows = self.vocabulary.id_of.get, self.vocabulary.longest, self.follows.get
        for end in range(len(last), len(data) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = token_of(data[start:end])
                if token is None:
                    continue
                if start:
                    ok = follows((last[start], token))
                    if ok is None:
                        ok = self.may_follow(last[start], token)
                else:
                    ok = self.is_alone(token)
                if ok:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise AssertionError("a byte-level vocabulary always has an ending token")

    def word(self, w: str) -> int:
        """Tokens of a word; fills the table."""
        c = self.prefix.get(w)
        if c is None:
            if len(self.prefix) > self.limit:
                self.prefix.clear()
            c = (0, 1) if w in self.vocabulary.special else self.counts(w.encode())
            c = self.prefix[w] = bytes(c) if c[-1] < 256 else c  # a byte an entry, for all but giant words
        return c[-1]

    def sums(self, words: list[str]) -> list[int]:
        """Tokens up to each word's end."""
        get, word = self.prefix.get, self.word
        return list(accumulate(c[-1] if (c := get(w)) is not None else word(w) for w in words))

    def at(self, words: list[str], sums: list[int], starts: list[int], p: int) -> int:
        """Tokens of the first ``p`` characters of the text with these words."""
        if p <= 0 or not words:
            return 0
        j = bisect_right(starts, p - 1) - 1
        w, inside = words[j], p - starts[j]
        before = sums[j - 1] if j else 0
        blank = lambda x: x[-1].isspace()  # noqa: E731  (a word ends with white space only if it is nothing else)
        blank_before = j > 0 and blank(words[j - 1])
        if inside >= len(w) and not (blank_before and blank(w)):
            return sums[j]
        head = w[: min(inside, 4)]
        if w in self.vocabulary.special or (w[0] == "'" and inside < 4) or (blank_before and head.isspace()):
            # A cut here can move a word boundary: split the last words' rest again.
            k = j - 1 if blank_before else j
            rest = "".join(words[k:j]) + w[:inside]
            return (sums[k - 1] if k else 0) + sum(self.word(x) for x in self.vocabulary.split(rest))
        self.word(w)
        return before + self.prefix[w][self.offset(w, inside)]

    def offset(self, w: str, inside: int) -> int:
        """Bytes of the first ``inside`` characters; a long word's are summed up once for all its cuts."""
        if len(w) < 64:
            return len(w[:inside].encode())
        if self.summed[0] != w:
            self.summed = (w, list(accumulate((len(c.encode()) for c in w), initial=0)))
        return self.summed[1][inside]

    def fit(self, words: list[str], sums: list[int], limit: int) -> int:
        """Characters of the longest prefix that encodes to at most ``limit`` tokens."""
        starts = list(accumulate(map(len, words), initial=0))
        total = starts.pop() if words else 0
        if not words or sums[-1] <= limit:
            return total
        j = bisect_right(sums, limit)
        # Beyond the word after the first that overflows, every prefix holds too many whole words.
        top = starts[j + 2] if j + 2 < len(words) else total
        low = starts[max(0, j - 1)]
        for p in range(top, low, -1):
            if self.at(words, sums, starts, p) <= limit:
                return p
        return low


RESULT = (
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
    T.StructField("fit_chars", T.LongType()),
)


def token_counts(docs: DataFrame, limit: int = 512, text: str = "text", tokenizer: str = TOKENIZER, prefixes: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens``, ``over_limit`` and
    ``fit_chars`` (the longest prefix within ``limit`` tokens).  ``prefixes`` adds
    ``prefix_chars`` and ``prefix_tokens``: the counts at every word end."""
    fields = list(RESULT)
    if prefixes:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("prefix_chars", "prefix_tokens")]
    own = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in {f.name for f in fields}]
    source = docs.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([*source.drop("__text").schema.fields, *fields])

    def run(batches):
        import pyarrow as pa

        table = worker_cache(f"prefix:{tokenizer}", lambda: PrefixTable(Vocabulary(tokenizer)))
        split = table.vocabulary.split
        for batch in batches:
            rows = {f.name: [] for f in fields}
            for value in batch.column("__text"):
                t = value.as_py()
                words = split(t)
                sums = table.sums(words)
                n = sums[-1] if sums else 0
                rows["n_bytes"].append(len(t.encode()))
                rows["n_tokens"].append(n)
                rows["over_limit"].append(n > limit)
                rows["fit_chars"].append(table.fit(words, sums, limit))
                if prefixes:
                    rows["prefix_chars"].append(list(accumulate(map(len, words))))
                    rows["prefix_tokens"].append(sums)
            kept = [n for n in batch.schema.names if n != "__text"]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            made = [pa.array(rows[f.name], k) for f, k in zip(fields, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], [*kept, *rows])

    return source.mapInArrow(run, schema)
