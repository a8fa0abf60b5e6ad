"""Removal of byte strings that also start earlier, by suffix order of a difference cover.

Suffixes are compared to a depth of ``length`` bytes, which is all that decides a removal.

1. Of documents with equal texts only the earliest is searched; all of the others repeats, if they have
   ``length`` bytes.
2. Of the windows of ``short`` bytes in a string the one with the smallest hash is the same in all its copies.
   The blocks (blocks.py) ask which of these occur twice; places whose window does not leave.
3. The remaining places are dealt by that window: neighbouring places with the same one are a *stretch*, which is
   sent with the bytes of its strings to the window's bucket. So all copies of a string meet in one bucket; of
   equal stretches a block sends its earliest.
4. Each bucket orders the suffixes of its stretches by a difference cover (difference_cover.py: sampled
   strings are sorted, triples of their names sorted again, the remaining suffixes merged) and compares
   neighbours: of each run of equal strings all but the earliest repeat.

Null and empty texts have no bytes; texts shorter than ``length`` stay whole. Earlier is: smaller doc_id
(null first), for rows that share one smaller digest of the text, then smaller start. Rows that are equal in
doc_id and text are one document, each with the same result. Columns other than doc_id and text are not
read. Without rows the result is empty.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import ASKED, Items, Texts, answers, asked, blocks, bucket_of, exchanged, flagged, parcel, passing
from tidemark.llm.difference_cover import Text, later_repeats
from tidemark.llm.shared import written
from tidemark.llm.textarrays import BYTE, covered, inside, joined, mixed, pieces, sliding, window_hashes

LENGTH = 100
#: Bytes of the windows that step 2 looks up, and bytes of text whose stretches make a bucket of step 4.
SHORT, SUFFIX_BYTES = 40, 16 << 20

INFO = "block int, place int, doc_id long, digest binary"
#: One row a question of any level, or of a text that is the earliest of its equals (level -1).
FOUND = "block int, level int, bucket int, flags binary"
REMOVED = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
#: Order of a stretch: whether the document has an id, the id, the text's digest, the start.
ORDER = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("digest", "<u8"), ("start", "<u4")])


def _info(length: int):
    def describe(texts: Texts, found: pa.Table | None) -> pa.Table:
        """Texts that can lose bytes; of equal rows the first."""
        rows = [(texts.block, k, texts.doc_ids[k], texts.digests[k]) for k in range(len(texts)) if texts.offsets[k + 1] - texts.offsets[k] >= length and not _equal(texts, k)]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "place", "doc_id", "digest"])

    return describe


def _equal(texts: Texts, k: int) -> bool:
    """Whether a row is equal to the one before it."""
    return k > 0 and texts.doc_ids[k] == texts.doc_ids[k - 1] and texts.digests[k] == texts.digests[k - 1]


class Search:
    """Places of the texts of a block that are the earliest of their equals, in pieces of a few megabytes."""

    def __init__(self, texts: Texts, found: pa.Table, length: int, short: int):
        self.texts, self.length, self.short, self.around = texts, length, short, length - short + 1
        self.places = sorted(b for b, level in zip(found["bucket"].to_pylist(), found["level"].to_pylist()) if level == -1)
        raw = [texts.data[texts.offsets[k] : texts.offsets[k + 1]] for k in self.places]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        self.data = [np.concatenate(raw[a:b]) for a, b in pieces(offsets)]
        self.doc = [np.arange(a, b) for a, b in pieces(offsets)]
        self.offsets = [offsets[a : b + 1] - offsets[a] for a, b in pieces(offsets)]
        self.windows = [window_hashes(BYTE[d], short) for d in self.data]
        self.ok = [inside(o, length, len(d) - length + 1) for o, d in zip(self.offsets, self.data)]
        self.anchor = [self.anchors(w) for w in self.windows]
        own = [a[ok] for a, ok in zip(self.anchor, self.ok)]  # ascends, so equal ones are neighbours
        self.at = [a[np.flatnonzero(np.diff(a, prepend=-1))] for a in own]

    def anchors(self, windows: np.ndarray) -> np.ndarray:
        """For each string the place of the window by which it is known: of smallest high bits, the leftmost."""
        key = (windows & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(windows), dtype=np.uint64)
        return (sliding(key, self.around) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def whole(self, windows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of the strings at some places, by windows that cover them."""
        steps = [*range(0, self.length - self.short, self.short), self.length - self.short]
        return reduce(joined, (windows[at + k] for k in steps))

    def items(self) -> Items:
        found = [w[a] for w, a in zip(self.windows, self.at)]
        return Items(np.concatenate(found) if found else np.zeros(0, np.uint64))

    def stretches(self, found: pa.Table, buckets: int) -> None:
        """Sets arrays over all stretches: piece, lo and hi (first and last place), bucket; and ``first``: of equal ones the earliest."""
        flags, done, parts = flagged(self.items(), found, 0), 0, []
        for k, (windows, ok, at) in enumerate(zip(self.windows, self.ok, self.at)):
            again = np.zeros(len(windows), bool)
            again[at[flags[done : done + len(at)]]] = True
            done += len(at)
            if not again.any():
                continue
            alive = np.flatnonzero(ok & again[self.anchor[k]])
            if not len(alive):
                continue
            anchor = self.anchor[k][alive]
            new = np.ones(len(alive), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (alive[1:] != alive[:-1] + 1)
            start = np.flatnonzero(new)
            lo, hi = alive[start], alive[np.append(start[1:], len(alive)) - 1]
            parts.append((np.full(len(lo), k), lo, hi, windows[anchor[start]], self.whole(windows, lo), self.whole(windows, hi)))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 3)
        self.piece, self.lo, self.hi, hashes, a, b = (np.concatenate(c) for c in zip(*parts)) if parts else empty
        self.bucket = bucket_of(mixed(hashes), buckets)  # the smallest hashes spread over all buckets again
        # equal stretches: as many places, the same first and last string and window
        order = np.lexsort((np.arange(len(a)), self.hi - self.lo, b, a, hashes))
        new = np.ones(len(order), bool)
        for c in (hashes, a, b, self.hi - self.lo):
            new[1:] &= c[order][1:] == c[order][:-1]
        new[1:] = ~new[1:]
        self.first = np.zeros(len(order), bool)
        self.first[order[new]] = True

    def begin(self) -> np.ndarray:
        """First bytes of the stretches in all pieces together."""
        before = np.cumsum([0, *(len(d) for d in self.data)])
        return self.lo + before[self.piece]

    def orders(self) -> np.ndarray:
        """The ``ORDER`` of each stretch."""
        ids = [self.texts.doc_ids[k] for k in self.places]
        known, values = np.array([i is not None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64)
        digests = np.array([int.from_bytes(self.texts.digests[k][:8], "big") for k in self.places], np.uint64)
        starts = np.cumsum([0, *(int(o[-1] - o[0]) for o in self.offsets)])
        first = np.concatenate([o[:-1] + s for o, s in zip(self.offsets, starts)]) if self.offsets else np.zeros(0, np.int64)
        begin = self.begin()
        doc = np.searchsorted(first, begin, "right") - 1
        order = np.zeros(len(begin), ORDER)
        order["known"], order["doc_id"], order["digest"], order["start"] = known[doc], values[doc], digests[doc], begin - first[doc]
        return order

    def sent(self) -> np.ndarray:
        """Numbers of the stretches that are sent, by bucket and then in order."""
        one = np.flatnonzero(self.first)
        return one[np.argsort(self.bucket[one], kind="stable")]


def _ask(length: int, short: int, buckets: int):
    def ask(texts: Texts, found: pa.Table) -> pa.Table:
        return asked(texts.block, Search(texts, found, length, short).items(), buckets)

    return ask


def _send(length: int, short: int, buckets: int):
    def send(texts: Texts, found: pa.Table) -> pa.Table:
        """The stretches of a block by bucket: their numbers of places (a), orders (b) and bytes (c); an answer is wanted for each place."""
        search = Search(texts, found, length, short)
        search.stretches(found, buckets)
        order, begin, size = search.orders(), search.begin(), search.hi - search.lo + 1
        raw, sent = np.concatenate(search.data) if search.data else np.zeros(0, np.uint8), search.sent()
        wanted, parts = np.zeros(buckets, np.int64), [[b""] * buckets for _ in range(3)]
        for own in np.split(sent, np.flatnonzero(np.diff(search.bucket[sent])) + 1) if len(sent) else []:
            span, k = size[own] + length - 1, int(search.bucket[own[0]])
            at = np.arange(span.sum()) + np.repeat(begin[own] - (np.cumsum(span) - span), span)
            wanted[k] = size[own].sum()
            for column, data in zip(parts, (size[own].astype(np.uint8), order[own], raw[at])):
                column[k] = data.tobytes()
        return parcel(texts.block, wanted, parts)

    return send


def _compare(length: int):
    def compare(sizes: list[bytes], orders: list[bytes], texts: list[bytes]) -> np.ndarray:
        """For each place of the stretches of a bucket whether its string is also at an earlier place."""
        size = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64)
        order = np.frombuffer(b"".join(orders), ORDER)
        text = Text(np.frombuffer(b"".join(texts), np.uint8), length)
        begin = np.cumsum(size + length - 1) - (size + length - 1)
        rank = np.empty(len(size), np.int64)
        rank[np.lexsort((order["start"], order["digest"], order["doc_id"], order["known"]))] = np.arange(len(size))
        total = np.concatenate([[0], np.cumsum(size)])
        offset = np.arange(total[-1]) - np.repeat(total[:-1], size)
        return later_repeats(text, np.repeat(begin, size) + offset, length, np.repeat(rank, size) * 256 + offset)

    return compare


def _removed(length: int, short: int, buckets: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(texts: Texts, found: pa.Table) -> pa.Table:
        search = Search(texts, found, length, short)
        search.stretches(found, buckets)
        starts = [[] for _ in search.data]
        known = np.flatnonzero(~search.first)
        for k, lo, hi in zip(search.piece[known].tolist(), search.lo[known].tolist(), search.hi[known].tolist()):
            starts[k].append(np.arange(lo, hi + 1))
        sent = search.sent()
        if len(sent):
            size = search.hi[sent] - search.lo[sent] + 1
            total = np.concatenate([[0], np.cumsum(size)])
            (flags,) = (f for level, f in zip(found["level"].to_pylist(), found["flags"].to_pylist()) if level == 1)
            later = np.unpackbits(np.frombuffer(flags, np.uint8), count=total[-1]).astype(bool)
            place = np.arange(total[-1]) + np.repeat(search.lo[sent] - total[:-1], size)
            piece = np.repeat(search.piece[sent], size)
            for k in np.unique(piece[later]).tolist():
                starts[k].append(place[later & (piece == k)])
        gone = {}
        for data, offsets, doc, at in zip(search.data, search.offsets, search.doc, starts):
            cut = covered(np.concatenate(at) if at else np.zeros(0, np.int64), length, len(data))
            for d, a, b in zip(doc.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                gone[search.places[d]] = cut[a:b]
        spans, kept = [], []
        for k in range(len(texts)):
            own = texts.data[texts.offsets[k] : texts.offsets[k + 1]]
            out = gone.get(k)
            if out is None:
                out = gone[k] = gone[k - 1] if _equal(texts, k) else np.full(len(own), len(own) >= length)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]]))).reshape(-1, 2)
            spans.append([{"start": i, "end": j} for i, j in edges.tolist()])
            kept.append(own[~out].tobytes())
        return pa.table([pa.array(texts.doc_ids, pa.int64()), pa.array(np.diff(texts.offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return remove


def suffix_dedup(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """n_bytes, the removed byte spans and the kept bytes of each row of ``docs``."""
    table, buckets, size = blocks(docs)
    many = max(3 * buckets, -(-size // SUFFIX_BYTES))
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "block", "place")
    firsts = passing(table, None, _info(length), INFO).groupBy("digest").agg(F.min(rank).alias("first"))
    found = written(firsts.select("first.block", F.lit(-1).alias("level"), F.col("first.place").alias("bucket"), F.lit(None).cast("binary").alias("flags")), "firsts")
    found = found.unionAll(answers(passing(table, found, _ask(length, short, buckets), ASKED), 0, buckets))
    sent = passing(table, found, _send(length, short, many), ASKED)
    found = found.unionAll(written(exchanged(sent, many, _compare(length), 1, groups=buckets), "repeats"))
    return passing(table, found, _removed(length, short, many), REMOVED)
