"""Removal of repeated word windows, found by level-wise doubling.

Windows of a first length (``FIRST`` words) are looked up in the whole corpus; only where they repeat are
windows of up to twice the length looked up, and so on until the wanted length is reached or no candidate
survives: 5, 9, 18 and 35 words. A candidate is a place of the wanted length. At each level one window of
each candidate suffices, the one with the smallest hash, which all copies of the candidate agree on (ties
all count): if it does not repeat, the candidate does not. At the last level every candidate is looked up.

A word is removed if a window of ``window`` words that covers it also starts anywhere else in the input,
the same document included. Windows are told apart by 128 bits of two independent hashes of their words.

Null and empty texts have no words and stay empty; texts shorter than a window stay whole. Rows that are
equal in all respects count as places of their own, so both lose what they share. Columns other than
doc_id and text are not read. Without rows the result is empty.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import ASKED, Items, Texts, answers, asked, blocks, flagged, passing
from tidemark.llm.textarrays import MOST, SECOND, Words, anchors, covered, inside, pieces, sliding, window_hashes

WINDOW = 35
#: Lengths are halved down to this many words or fewer.
FIRST = 5

REMOVED = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string"


def lengths(window: int, first: int = FIRST) -> list[int]:
    """The levels: each at most twice as long as the one before."""
    found = [window]
    while found[0] > first:
        found.insert(0, -(-found[0] // 2))
    return found


class Search:
    """Candidates of one block, level by level; in pieces of a few megabytes."""

    def __init__(self, texts: Texts, sizes: list[int]):
        self.texts, self.sizes = texts, sizes
        self.words, self.hashes, self.alive = [], [], []
        for a, b in pieces(texts.offsets):
            words = Words(texts.data[texts.offsets[a] : texts.offsets[b]], texts.offsets[a : b + 1] - texts.offsets[a])
            hashes = words.hashes()
            self.words.append(words)
            self.hashes.append(hashes)
            self.alive.append(inside(words.first, sizes[-1], len(hashes) - sizes[-1] + 1))

    def at_level(self, level: int) -> list[np.ndarray]:
        """Windows of this level that are looked up: their starts, in each piece."""
        width = self.sizes[-1] - self.sizes[level] + 1
        if width == 1:
            return [np.flatnonzero(alive) for alive in self.alive]
        self.windows = [window_hashes(h, self.sizes[level]) for h in self.hashes]
        return [np.flatnonzero(anchors(w, alive, width)) if alive.any() else np.zeros(0, np.int64) for w, alive in zip(self.windows, self.alive)]

    def items(self, level: int, at: list[np.ndarray]) -> Items:
        last = level == len(self.sizes) - 1
        found = [w[a] for w, a in zip([window_hashes(h, self.sizes[level]) for h in self.hashes] if last else self.windows, at)]
        second = [window_hashes(words.hashes(seed=SECOND), self.sizes[level])[a] for words, a in zip(self.words, at)] if last else None
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return Items(flat(found), flat(second) if last else None)

    def narrow(self, level: int, at: list[np.ndarray], repeats: np.ndarray) -> None:
        """Only candidates whose smallest window repeats stay."""
        width, done = self.sizes[-1] - self.sizes[level] + 1, 0
        for k, own in enumerate(at):
            flag = repeats[done : done + len(own)]
            done += len(own)
            again = np.full(len(self.windows[k]) if width > 1 else len(self.alive[k]), False)
            again[own[flag]] = True
            if width == 1:
                self.alive[k] = again
            elif len(self.alive[k]):
                self.alive[k] &= sliding(np.where(again, self.windows[k], MOST), width) == sliding(self.windows[k], width)

    def upto(self, level: int, found: pa.Table | None) -> tuple[list[np.ndarray], Items]:
        """What is looked up at ``level``, by the answers of all levels before."""
        for before in range(level):
            at = self.at_level(before)
            self.narrow(before, at, flagged(self.items(before, at), found, before))
        at = self.at_level(level)
        return at, self.items(level, at)


def _asker(level: int, sizes: list[int], buckets: int):
    def ask(texts: Texts, found: pa.Table | None) -> pa.Table:
        return asked(texts.block, Search(texts, sizes).upto(level, found)[1], buckets)

    return ask


def _removed(sizes: list[int]):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(texts: Texts, found: pa.Table) -> pa.Table:
        search, last = Search(texts, sizes), len(sizes) - 1
        at, items = search.upto(last, found)
        search.narrow(last, at, flagged(items, found, last))
        n_words, spans, kept = [], [], []
        for words, alive in zip(search.words, search.alive):
            gone = covered(np.flatnonzero(alive), sizes[-1], len(words.start))
            for a, b, i, j in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), words.first[:-1].tolist(), words.first[1:].tolist()):
                own, out = words.data[a:b].tobytes().split(), gone[i:j]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                n_words.append(j - i)
                spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                kept.append(b" ".join(compress(own, (~out).tolist()) if len(edges) else own).decode())
        return pa.table({"doc_id": pa.array(texts.doc_ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "removed": pa.array(spans, spans_type), "kept": pa.array(kept, pa.string())})

    return remove


def substring_dedup(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """n_words, the removed word spans and the kept words of each row of ``docs``."""
    (table, buckets, _), sizes = blocks(docs), lengths(window, first)
    found = None
    for level in range(len(sizes)):
        questions = passing(table, found, _asker(level, sizes, buckets), ASKED)
        known = answers(questions, level, buckets, wide=level == len(sizes) - 1)
        found = known if found is None else found.unionAll(known)
    return passing(table, found, _removed(sizes), REMOVED)


def n_removed(removed: str = "removed"):
    """Words in the removed spans."""
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
