"""Local, vectorised steps of operator 10; see ``suffix_dedup`` for how Spark joins them.

The cover sample of a text is its *anchors*: of every window of ``length`` bytes, the
leftmost 16-byte piece of least hash.  Equal windows hold their anchor at the same
offset, so two suffixes that tie for long share a sampled position at one known
distance, and ranks of the sample settle the tie.  Consecutive windows with one
anchor form a *run*; a run carries the bytes that its windows cover.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

#: Positions handled at a time: bounds the temporary arrays, whatever a text's length.
CHUNK = 1 << 18

#: Runs of one anchor key, over all blocks, beyond which its windows are dealt out one by one.
HOT_RUNS = 50_000


def piece_bytes(length: int) -> int:
    """Bytes of an anchor piece: short enough that anchors are rare, with at most 64 offsets in a window."""
    if length < 24:
        raise ValueError("passages of fewer than 24 bytes have no rare anchors")
    return max(16, length - 62)


def _words(data: bytes, n: int) -> np.ndarray:
    """Big-endian 8-byte words at positions 0 .. n - 1."""
    padded = data + b"\0" * 16
    out = np.empty(n, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(padded, ">u8", count=len(range(k, n, 8)), offset=k)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, seed) of every run; ``ends`` cuts ``data`` into documents, and no
    window crosses a cut.  Positions count in ``data``; a seed is 58 bits of the anchor's hash."""
    piece = piece_bytes(length)
    wide, six = length - piece + 1, np.uint64(6)
    parts = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n = len(part) - piece + 1
        w, h = _words(part, len(part)), np.zeros(n, np.uint64)
        for k in sorted({*range(0, piece - 7, 8), piece - 8}):
            h = _mix(h ^ w[k : k + n])
        # Sliding minimum by doubling; the low six bits hold the offset in the window, so ties go left.
        key, step = (h >> six) << six, 1
        while 2 * step <= wide:
            key = np.minimum(key[:-step], key[step:] + np.uint64(step))
            step *= 2
        if wide > step:
            key = np.minimum(key[: len(key) - (wide - step)], key[wide - step :] + np.uint64(wide - step))
        anchor = np.arange(at, at + len(key)) + (key & np.uint64(63)).astype(np.int64)
        whole = np.ones(len(key), bool)
        for end in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(key) + length, "right")]:
            whole[max(0, end - length + 1 - at) : max(0, end - at)] = False
        new = np.ones(len(key), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        first, size = first[whole[first]], size[whole[first]]
        parts.append((first + at, size, anchor[first], (key >> six)[first]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def keyed(seed: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32 further bits of the seed in the low half."""
    b = np.uint64(buckets)
    return ((seed % b) << np.uint64(32)) | ((seed // b) & np.uint64(0xFFFFFFFF))


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays one after the other, each behind its length, compressed."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(r).to_bytes(8, "little") + r for r in raw))


def unpack(blob: bytes, *kinds) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        body = raw[at + 8 : at + 8 + n]
        out.append(body if kind is bytes else np.frombuffer(body, kind))
        at += 8 + n
    return out


class Block:
    """The documents of one block in a fixed order: sorted by id, then bytes; null ids take no part."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.order = sorted((k for k in range(len(ids)) if ids[k] is not None), key=lambda k: (ids[k], texts[k]))
        self.ids = np.array([ids[k] for k in self.order], np.int64)
        self.data = b"".join(texts[k] for k in self.order)
        self.ends = np.cumsum([len(texts[k]) for k in self.order], dtype=np.int64)
        self.starts = self.ends - np.array([len(texts[k]) for k in self.order], np.int64)

    def seeds(self, length: int, buckets: int):
        """Runs with the document of each, and their keys."""
        start, size, anchor, seed = runs(self.data, self.ends, length)
        doc = np.searchsorted(self.starts, start, "right") - 1
        return start, size, anchor, doc, keyed(seed, buckets)


def request(block: Block, length: int, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, its sorted distinct 32-bit keys with the number of runs of each, at most 65535) of a block."""
    *_, key = block.seeds(length, buckets)
    keys, count = np.unique(key, return_counts=True)
    few = np.minimum(count, 65535).astype(np.uint16)
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    return [(int(bucket[a]), pack(keys[a:b].astype(np.uint32), few[a:b])) for a, b in segments(bucket)]


def segments(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of every run of equal non-negative values; none of no values."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=False))


def answer(blobs: list[bytes]) -> list[bytes]:
    """For each block's keys of one bucket, two bits each: another block has it too; it is hot."""
    lists = [unpack(b, np.uint32, np.uint16) for b in blobs]
    every = np.concatenate([x[0] for x in lists])
    keys, row, blocks = np.unique(every, return_inverse=True, return_counts=True)
    total = np.bincount(row, weights=np.concatenate([x[1] for x in lists]), minlength=len(keys))
    again, hot = (blocks > 1)[row], (total > HOT_RUNS)[row]
    cuts = np.cumsum([0, *(len(x[0]) for x in lists)])
    return [np.packbits(np.concatenate((again[a:b], hot[a:b]))).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def offers(block: Block, answers: dict[int, bytes], length: int, buckets: int) -> tuple[list[tuple[int, bytes]], bytes | None]:
    """(bucket, runs of it that may repeat), and the spans that repeat within the block already.

    Of equal runs of a block only those of its least document travel on: whatever the
    others' fate elsewhere, that document makes them removable.  Runs of a hot key are
    cut into their windows first, each of which has the bucket of its own hash: so an anchor
    that very many different passages share is no single bucket, and equal windows still meet."""
    start, size, anchor, doc, key = block.seeds(length, buckets)
    keys, row = np.unique(key, return_inverse=True)
    if not len(keys):
        return [], None
    order = np.lexsort((doc, row))
    heads = np.flatnonzero(np.diff(row[order], prepend=-1))
    lo, hi = doc[order][heads], doc[order][np.append(heads[1:], len(order)) - 1]
    again = lo < hi
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    hot = np.zeros(len(keys), bool)
    for a, b in segments(bucket):
        bits = np.unpackbits(np.frombuffer(answers[int(bucket[a])], np.uint8), count=2 * (b - a)).astype(bool)
        again[a:b] |= bits[: b - a]
        hot[a:b] = bits[b - a :]
    chosen = np.flatnonzero(again[row])
    start, size, anchor, doc = (v[chosen] for v in (start, size, anchor, doc))
    home, warm = bucket[row[chosen]], hot[row[chosen]]
    if warm.any():
        n = np.where(warm, size, 1)
        each = np.repeat(np.arange(len(start)), n)
        step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        start, size, anchor, doc, home, warm = start[each] + step, np.where(warm, 1, size)[each], anchor[each], doc[each], home[each], warm[each]
        for k in np.flatnonzero(warm).tolist():
            home[k] = xxhash.xxh64_intdigest(block.data[start[k] : start[k] + length]) % buckets
    chosen = np.arange(len(start))
    data, ids = block.data, block.ids
    stop = start + size + length - 1
    texts = [data[a:b] for a, b in zip(start[chosen].tolist(), stop[chosen].tolist(), strict=True)]
    owner = ids[doc[chosen]].tolist()
    least: dict[bytes, int] = {}
    for text, i in zip(texts, owner, strict=True):
        if i < least.get(text, i + 1):
            least[text] = i
    first = np.fromiter((least[t] == i for t, i in zip(texts, owner, strict=True)), bool, len(texts))
    gone = chosen[~first]
    local = pack((doc[gone]).astype(np.int32), (start - block.starts[doc])[gone], (stop - block.starts[doc])[gone]) if len(gone) else None
    kept = chosen[first]
    texts = [t for t, f in zip(texts, first.tolist(), strict=True) if f]
    order = np.argsort(home[kept], kind="stable")
    kept, texts = kept[order], [texts[k] for k in order.tolist()]
    out = []
    where = home[kept]
    for a, b in segments(where):
        k = kept[a:b]
        d = doc[k]
        out.append((int(where[a]), pack(
            ids[d], d.astype(np.int32), start[k] - block.starts[d], (anchor[k] - start[k]).astype(np.uint8), size[k].astype(np.uint8), b"".join(texts[a:b])
        )))
    return out, local


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row in sorted order, bytes that each sorted row shares with the one before)."""
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.lexsort(wide.T[::-1])
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    shared = np.zeros(len(rows), np.int64)
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return place, shared


def settle(blobs: list[bytes], length: int) -> list[bytes | None]:
    """For each block's runs of one bucket, the spans whose bytes start in a smaller document too.

    The anchors' right and reversed left contexts are ranked once.  Then the suffixes of
    one offset before the anchor at a time are a bucket: each is named by two ranks cut
    to the depth of its window, and equal names are equal windows."""
    parts = [unpack(b, np.int64, np.int32, np.int64, np.uint8, np.uint8, bytes) for b in blobs]
    ids, doc, start, lead, size = (np.concatenate([p[k] for p in parts]) for k in range(5))
    lead, size = lead.astype(np.int64), size.astype(np.int64)
    data = np.frombuffer(b"".join(p[5] for p in parts), np.uint8)
    n, wide = len(ids), length - piece_bytes(length) + 1
    lengths = size + length - 1
    base = np.cumsum(lengths) - lengths
    at = base + lead
    padded = np.concatenate((np.zeros(wide, np.uint8), data, np.zeros(length, np.uint8)))
    right = padded[wide + at[:, None] + np.arange(length)]
    right[np.arange(length) >= (lengths - lead)[:, None]] = 0
    left = padded[wide + at[:, None] - 1 - np.arange(wide - 1)]
    left[np.arange(wide - 1) >= lead[:, None]] = 0
    (place_r, shared_r), (place_l, shared_l) = _ranked(right), _ranked(left)
    removed = np.zeros((n, wide), bool)  # by window of the run
    for offset in range(wide):
        on = np.flatnonzero((offset <= lead) & (lead - offset < size))
        if len(on) < 2:
            continue
        name_r = np.cumsum(shared_r < length - offset)[place_r[on]]
        name_l = np.cumsum(shared_l < offset)[place_l[on]] if offset else 0
        name = name_r * (n + 1) + name_l
        order = np.lexsort((ids[on], name))
        name, owner = name[order], ids[on][order]
        heads = np.flatnonzero(np.diff(name, prepend=-1))
        first = np.repeat(owner[heads], np.diff(np.append(heads, len(name))))
        hit = on[order[owner > first]]
        removed[hit, lead[hit] - offset] = True
    edge = np.diff(np.pad(removed, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, opens = np.nonzero(edge == 1)
    closes = np.nonzero(edge == -1)[1]
    begin, end = start[row] + opens, start[row] + closes - 1 + length
    cuts = np.searchsorted(row, np.cumsum([0, *(len(p[0]) for p in parts)]))
    return [pack(doc[row[a:b]], begin[a:b], end[a:b]) if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], end[np.append(heads[1:], len(begin)) - 1]
