"""Byte-level BPE vocabularies read from a public tokenizer file, and the split of a text into words.

A *word* here is a pre-token: the unit inside which merges happen.  Special strings
are cut out first, as the tokenizer library does by default, and are words of one id.
"""

from __future__ import annotations

import json
import os
from functools import cached_property
from itertools import chain

import numpy as np
import regex

#: Fixed value: the published pre-tokenizer pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points on whose classes this pattern engine and the library agree in every
#: version; a text with any other is split by the library itself.
UNSURE = r"[^\x00-ԯ -⁣]"

#: Characters, and new words, that are split and encoded at a time: they bound a worker's memory.
BLOCK_CHARS, ADD_WORDS = 500_000, 5_000

#: Entries after which a worker's word table is emptied. It is a cache: results do not depend on it.
TABLE_WORDS = 300_000


def resolve(name: str) -> str:
    """A tokenizer file: an absolute path, or the name of a public one on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte: printable Latin-1 stands for itself, other bytes for U+0100 onwards."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


def read_pieces(name: str) -> tuple[dict, list[bytes]]:
    """The parsed file of a byte-level BPE vocabulary, and the bytes of every id."""
    with open(resolve(name), encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for piece, i in vocab.items():
        if piece not in special:
            pieces[i] = bytes(alphabet[c] for c in piece)
    for text, i in special.items():
        pieces[i] = text.encode()
    return spec, pieces


class Vocabulary:
    """Pieces, merge ranks and special strings of one byte-level BPE file."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(resolve(name))
        self.library.no_truncation()
        self.library.no_padding()
        spec, self.pieces = read_pieces(name)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or model["dropout"]:
            raise ValueError(f"{name} is not a plain byte-level BPE file")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{name} has added tokens that match more than their own text")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name, self.special = name, special
        self._words = regex.compile(PATTERN)
        self._unsure = regex.compile(UNSURE)
        cut = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
        self._special = regex.compile(f"({cut})") if cut else None

    # What only some callers need is made when first asked for: encoding by the word table takes none of it.

    @cached_property
    def id_of(self) -> dict[bytes, int]:
        special = set(self.special.values())
        return {p: i for i, p in enumerate(self.pieces) if p and i not in special}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.id_of))

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        """The id of every pair that merges, in order of rank."""
        alphabet = byte_alphabet()
        as_id = lambda piece: self.id_of[bytes(alphabet[c] for c in piece)]
        with open(resolve(self.name), encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        pairs = ((as_id(a), as_id(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges))
        return {(a, b): self.id_of[self.pieces[a] + self.pieces[b]] for a, b in pairs}

    @cached_property
    def merge_rank(self) -> dict[tuple[int, int], int]:
        return {pair: k for k, pair in enumerate(self.merged)}

    def split(self, text: str) -> list[str]:
        """The words of a text, in order; they concatenate to it."""
        if not text:
            return []
        if self._special is not None and any(s in text for s in self.special):
            parts = self._special.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if self._unsure.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []
        return self._words.findall(text)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word by merging the pair of least rank again and again."""
        ids = [self.id_of[bytes((b,))] for b in data]
        rank = self.merge_rank
        while len(ids) > 1:
            best = min(zip(ids, ids[1:], strict=False), key=lambda p: rank.get(p, 1 << 60))
            if best not in rank:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == best:
                    out.append(self.merged[best])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids


def blocks(texts: list, limit: int = BLOCK_CHARS):
    """Consecutive runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


class WordTable:
    """Distinct words with their ids, each encoded once while it stays in the table."""

    def __init__(self, vocabulary: Vocabulary, limit: int = TABLE_WORDS):
        self.vocabulary, self.limit = vocabulary, limit
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.start, self.size = (np.zeros(0, np.int32) for _ in range(3))

    def add(self, words) -> None:
        new = list(set(words).difference(self.row))
        if not new:
            return
        sizes, parts = [], []
        for k in range(0, len(new), ADD_WORDS):  # the library's own results are some hundred bytes a word
            got = [e.ids for e in self.vocabulary.library.encode_batch_fast(new[k : k + ADD_WORDS], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int32, len(got)))
            parts.append(np.fromiter(chain.from_iterable(got), np.int32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(parts)
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size, dtype=np.int64) - size))
        self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.row) > self.limit:
            self.clear()
        split = [self.vocabulary.split(t) for t in texts]
        words = [w for ws in split for w in ws]
        self.add(words)
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        # Position join: each word's ids land where the word stands.
        at = np.repeat(self.start[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.concatenate(([0], ends))
        bounds = np.cumsum([0, *map(len, split)])
        return self.ids[at], np.diff(upto[bounds])
