"""Word segmentation and hashing of whole Arrow text batches with numpy.

All functions work on the UTF-8 bytes of a batch at once; the number of numpy calls does not
depend on the number of words. Intermediate arrays cover ``STEP`` bytes of text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

STEP = 1 << 20
#: Bytes of whole texts a task works on at a time where what is derived from them is many times their size.
SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for ASCII letters, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, STEP + 4096)
        up, down = np.full(n, _BASE), np.full(n, _INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (64-bit)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    if texts.null_count:
        lengths = np.diff(offsets)
        if lengths[np.asarray(texts.is_null())].any():
            texts = texts.fill_null("")
            return text_bytes(texts)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte spans, and for every text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1 offsets into the words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators; a word never crosses texts."""
    n = len(buf)
    inside = ~separator[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        before |= edge[:-1]
        after |= edge[1:]
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of every byte span; spans ascend. ``table`` maps bytes before hashing."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + STEP, "right")))
        lo, hi = int(start[at]), int(end[stop - 1])
        up, down = powers(hi - lo + 1)
        part = buf[lo:hi] if table is None else table[buf[lo:hi]]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=sums[1:])
        s, e = start[at:stop] - lo, end[at:stop] - lo
        out[at:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(out)


def pair_hashes(h: np.ndarray, doc: np.ndarray, gap: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (word i, word i + gap) within each text, and the texts they are in."""
    if len(h) <= gap:
        return h[:0], doc[:0]
    same = doc[:-gap] == doc[gap:]
    a, b = h[:-gap][same], h[gap:][same]
    return mix(a * np.uint64(3) + b * np.uint64(0x2545F4914F6CDD1D) + np.uint64(salt)), doc[:-gap][same]


def inner_grams(buf: np.ndarray, w: Words, n: int, salt: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every n-byte gram inside a word."""
    ids, hashes = [], []
    at = 0
    while at < len(w.start):
        stop = max(at + 1, int(np.searchsorted(w.end, w.start[at] + STEP, "right")))
        lo, hi = int(w.start[at]), int(w.end[stop - 1])
        up, down = powers(hi - lo + 1)
        part = buf[lo:hi] if table is None else table[buf[lo:hi]]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=sums[1:])
        many = np.maximum(w.end[at:stop] - w.start[at:stop] - n + 1, 0)
        gone = np.cumsum(many) - many
        s = np.repeat(w.start[at:stop] - lo - gone, many) + np.arange(int(many.sum()))
        ids.append(np.repeat(np.arange(at, stop), many))
        hashes.append(mix((sums[s + n] - sums[s]) * down[s] + np.uint64(salt)))
        at = stop
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(ids), np.concatenate(hashes)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, 0 for a text without any."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def word_chunks(w: Words, limit: int = STEP):
    """Consecutive ranges of words that span about ``limit`` bytes, so that what is derived from
    a very long text never stands in memory at once."""
    at = 0
    while at < len(w.start):
        stop = max(at + 1, int(np.searchsorted(w.end, w.start[at] + limit, "right")))
        yield at, stop
        at = stop


def part(w: Words, at: int, stop: int) -> Words:
    """The words of a range; ``first`` then gives the texts' offsets into the range."""
    return Words(w.start[at:stop], w.end[at:stop], np.clip(w.first - at, 0, max(0, min(stop, len(w.start)) - at)))


def slices(texts: pa.Array, limit: int = STEP):
    """Consecutive slices of the array of about ``limit`` bytes, each of whole texts."""
    n = len(texts)
    if n == 0:
        yield texts
        return
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = text_bytes(texts)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield texts.slice(at, stop - at)
        at = stop
