"""Order of suffixes by a difference cover, to a bounded depth.

Places 1 and 2 modulo 3 are the sample. Its strings of a first width are sorted and named; the recursion
sorts triples of these names at a distance that keeps them in the sample, whose names then span the
depth. The remaining suffixes are sorted by a byte and the name behind it and merged with the sample: two
suffixes are compared by the bytes before the next place that is in the sample for both, and its names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np

from tidemark.llm.textarrays import joined


def widths(depth: int) -> tuple[int, int]:
    """(width of the strings of the first sort, distance of the three in a triple) that span ``depth`` bytes."""
    step = 3 * (depth // 9)
    return depth - 2 * step, step


class Text:
    """Bytes that are read as numbers of eight at any place; zeros follow the end."""

    def __init__(self, data: np.ndarray, depth: int):
        self.bytes = np.zeros(len(data) + 2 * depth + 16, np.uint8)
        self.bytes[: len(data)] = data
        self.eight, self.any_order = (np.ndarray((len(self.bytes) - 7,), np.dtype(t), self.bytes, strides=(1,)) for t in (">u8", "<u8"))

    def columns(self, at: np.ndarray, width: int) -> list[np.ndarray]:
        """The strings of ``width`` bytes at some places, as columns of numbers that sort like them."""
        found = [self.eight[at + k].astype(np.uint64) for k in range(0, width, 8)]
        if width % 8:
            found[-1] >>= np.uint64(8 * (8 - width % 8))
        return found


def named(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows, from 1, equal ones alike. Equal rows are gathered by a hash, so that only distinct ones are sorted."""
    columns = [np.asarray(c, np.uint64) for c in columns]
    hashes = reduce(joined, columns)
    order = np.argsort(hashes)
    same, hashes = np.ones(max(len(order) - 1, 0), bool), hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    for c in columns:
        c = c[order]
        same &= c[1:] == c[:-1]
    if (same == new[1:]).any():  # two different rows of one hash: all rows are sorted
        new[:] = True
    one = order[new]
    distinct = [c[one] for c in columns]
    by = np.lexsort(distinct[::-1])
    differ = np.zeros(len(by), bool)
    differ[:1] = True
    for c in distinct:
        c = c[by]
        differ[1:] |= c[1:] != c[:-1]
    name = np.empty(len(by), np.int64)
    name[by] = np.cumsum(differ)
    ranks = np.empty(len(order), np.int64)
    ranks[order] = name[np.cumsum(new) - 1]
    return ranks


def suffix_order(text: Text, places: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes at ``places`` (ascending) by their first ``depth`` bytes."""
    if not len(places):
        return np.zeros(0, np.int64)
    width, step = widths(depth)
    needed = np.zeros(len(text.bytes), bool)
    for k in range(3):
        needed[places + k] = True
    needed[::3] = False
    sample = np.flatnonzero(needed)
    for k in (1, 2):
        needed[sample + k * step] = True
    first = np.flatnonzero(needed)
    name = np.zeros(len(text.bytes), np.int32)
    name[first] = named(text.columns(first, width))
    triples = named([name[sample], name[sample + step], name[sample + 2 * step]])
    name[:] = 0
    name[sample] = triples
    most = np.int64(int(triples.max()) + 1 if len(triples) else 1)
    byte = lambda at: text.bytes[at].astype(np.int64)
    one = lambda at: byte(at) * most + name[at + 1]
    two = lambda at: (byte(at) * 256 + byte(at + 1)) * most + name[at + 2]
    part = places % 3
    rest, ones, twos = (np.flatnonzero(part == k) for k in range(3))
    sampled = np.flatnonzero(part != 0)
    rest_key = one(places[rest])
    before = np.searchsorted(np.sort(one(places[ones])), rest_key) + np.searchsorted(np.sort(two(places[twos])), two(places[rest]))
    by = np.argsort(rest_key)
    before.sort()  # as the rest is ordered, up to ties: how many of the sample stand before each
    order = np.empty(len(places), np.int64)
    order[before + np.arange(len(rest))] = rest[by]
    up_to = np.cumsum(np.bincount(before, minlength=len(sampled) + 1))[: len(sampled)]
    order[np.arange(len(sampled)) + up_to] = sampled[np.argsort(name[places[sampled]])]
    return order


def later_repeats(text: Text, places: np.ndarray, depth: int, rank: np.ndarray) -> np.ndarray:
    """Which places have the first ``depth`` bytes of a place of smaller ``rank``: neighbours in order are compared."""
    order = suffix_order(text, places, depth)
    new = np.zeros(len(order), bool)
    new[:1] = True
    at = places[order]
    for k in [*range(0, depth - 7, 8), depth - 8]:
        c = text.any_order[at + k]
        new[1:] |= c[1:] != c[:-1]
    out = np.zeros(len(places), bool)
    if len(order):
        least = np.minimum.reduceat(rank[order], np.flatnonzero(new))
        out[order] = rank[order] > least[np.cumsum(new) - 1]
    return out
