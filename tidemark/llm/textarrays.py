"""Texts of Arrow batches as numpy arrays: words, hashes of words and of word windows.

Texts are handled as UTF-8 bytes, a few megabytes at a time, so that memory stays bounded however long
a batch is. A text is never cut; one longer than a chunk is a chunk of its own.

Hashes are chains of multiply-and-shift steps, not polynomials: words with structure (Thue-Morse words,
say) collide no more often than random ones. What must not collide by chance among many billions is
told apart by two hashes of different seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once.
CHUNK = 2 << 20
#: What `[^\x20\x09-\x0D]+` leaves out.
SPACES = b" \t\n\x0b\x0c\r"
#: Seeds of two independent families of hashes.
SEED, SECOND = 20240229, 977
#: Spans up to this many bytes are hashed together, eight bytes at a time.
TOGETHER = 64

_rng = np.random.Generator(np.random.PCG64(SEED))
#: A random number for each byte.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (x | np.uint64(1) for x in _rng.integers(1 << 62, 1 << 63, 3, dtype=np.uint64))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: ASCII other than 0-9, A-Z and a-z.
IS_SIGN = np.arange(256) < 128
IS_SIGN[48:58] = IS_SIGN[65:91] = IS_SIGN[97:123] = False


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit sums over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs, one step of a chain."""
    h = b * _A
    h += a
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first, last) of consecutive texts with about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1))
        yield first, last
        first = last


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about ``size`` bytes of text."""
    data, offsets = buffers(batch.column(column))
    for first, last in pieces(offsets, size):
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


class Words:
    """Words of some texts: ``start``, ``end`` (bytes), ``first`` (n + 1 offsets of each text's words). Bytes ``between`` are no part of a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE):
        self.data, self.offsets = data, offsets
        inner = ~between[data]
        begins, ends = inner.copy(), inner.copy()
        if len(data):
            begins[1:] &= ~inner[:-1]
            ends[:-1] &= ~inner[1:]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            begins[edges] = inner[edges]
            ends[edges - 1] = inner[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, folded: bool = False, seed: int = SEED) -> np.ndarray:
        """A hash of each word; ``folded``: with A-Z as a-z."""
        return span_hashes(LOWER[self.data] if folded else self.data, self.start, self.end, seed)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands."""
    length = end - start
    out = mixed(length.astype(np.uint64) * _C + np.uint64(seed))
    if not len(data) or not len(start):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    row = np.flatnonzero((length > 0) & (length <= TOGETHER))
    at, left = start[row], length[row]
    while len(row):
        out[row] = joined(eight[at] & _MASK[np.minimum(left, 8)], out[row])
        more = left > 8
        row, at, left = row[more], at[more] + 8, left[more] - 8
    raw = memoryview(padded)
    for i in np.flatnonzero(length > TOGETHER).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], seed)
    return mixed(out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` hashes (len(words) - length + 1 of them), by doubling."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, span = words, 1
    while 2 * span <= length:
        h = joined(h[:-span], h[span:])
        span *= 2
    if span < length:
        h = joined(h[:n], h[length - span : length - span + n])
    return mixed(h + np.uint64(length))


def inside(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the n window starts have all their words in one text."""
    ok = np.zeros(max(n, 0), bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= length:
            ok[a : b - length + 1] = True
    return ok


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans [start, start + length)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:n]) > 0


MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Smallest (or, by np.maximum, largest) value of each run of ``width`` values."""
    n, span = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[:n], x[width - span : width - span + n])


def anchors(hashes: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Which windows have the smallest hash of a run of ``width`` windows that starts where ``ok``."""
    smallest = np.where(ok[: len(hashes) - width + 1], sliding(hashes, width), np.uint64(0))
    around = np.zeros(width - 1, np.uint64)
    return (hashes == sliding(np.concatenate([around, smallest, around]), width, np.maximum)) & (hashes > 0)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal values and their lengths."""
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_keys)))
