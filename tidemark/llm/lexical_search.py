"""Ranked lexical search over blocks of documents, pruned by the blocks' largest impacts.

Terms are the maximal runs of 0-9, A-Z, a-z and non-ASCII characters, A-Z lower-cased. A term's impact in
a document depends on how often it stands there and on the document's length; a document's score is the
sum, over the distinct terms of a query, of the term's weight times its impact. All of it is in whole numbers.

*Index.* Consecutive documents of the table make a block (at most ``BLOCK_DOCS``, about ``BLOCK_BYTES`` of
text; a longer text is a block of its own). A block has a forward index (of each document its terms and how
often) and a summary: its terms, how many of its documents hold each, and each one's largest impact. The
texts are read twice and never shuffled: once to count documents and terms, once to write the blocks.

*Search.* The summaries give the document count, hence the weight, of each term that is asked for. Then
each task bounds every query in every block of a batch by the blocks' largest impacts, and for each query
takes the blocks by falling bound and scores their documents until the bound is below the task's
``k``-th best document so far (or equal to it, with only larger ids in the block). Forward indexes that no
query gets to are never unpacked. The best of all tasks are merged, by parts of each query first.

Queries are broadcast, as arrays of term numbers: they are dealt into parts of at most about
``PART_BYTES`` of text (measured; one query is not divided), each a search of its own over the same index.

Terms are told apart by a 64-bit hash: among 10^10 distinct terms of the documents and 10^4 of the queries
one wrong match is expected in about 200,000 runs.

Null and empty texts, and those without a term, are in no block and found by no query. Every row of ``docs`` is
a document, also if ids or whole rows repeat; a null doc_id comes after all others among equal scores.
Rows of queries that share an item_id (null included) are one query; one without terms finds nothing, as
does an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.llm.textarrays import IS_SIGN, Words, chunks, runs

BLOCK_DOCS, BLOCK_BYTES = 64, 256 << 10
#: Text of the queries that are searched together; results of a query.
PART_BYTES, K = 1 << 20, 10
#: First merges are over so many parts of a query's results.
PARTS = 64

#: ``least``: smallest doc_id, null if none has one. ``terms`` ascend; ``holders`` and ``most`` are of these.
INDEX = "block long, docs int, words long, least long, terms binary, holders binary, most binary, forward binary"
_INDEX = pa.schema([("block", pa.int64()), ("docs", pa.int32()), ("words", pa.int64()), ("least", pa.int64()), *((n, pa.binary()) for n in ("terms", "holders", "most", "forward"))])


class Index(NamedTuple):
    table: DataFrame
    n_docs: int
    n_words: int


class Forward(NamedTuple):
    """Documents of a block: ids (and which are null), lengths, and by document the places of its terms in the vocabulary, with their counts."""

    ids: np.ndarray
    null: np.ndarray
    length: np.ndarray
    first: np.ndarray
    term: np.ndarray
    count: np.ndarray

    def pack(self) -> bytes:
        parts = [a.astype(t).tobytes() for a, t in zip(self, ("<i8", "?", "<i8", "<i8", "<u4", "<u4"))]
        return zstandard.compress(np.array([len(self.ids), len(self.term)], "<i8").tobytes() + b"".join(parts), 3)

    @staticmethod
    def unpack(packed: bytes) -> Forward:
        raw = zstandard.decompress(packed)
        d, p = np.frombuffer(raw, "<i8", 2).tolist()
        parts, at = [], 16
        for t, n in (("<i8", d), ("?", d), ("<i8", d), ("<i8", d + 1), ("<u4", p), ("<u4", p)):
            parts.append(np.frombuffer(raw, t, n, at))
            at += parts[-1].nbytes
        return Forward(*parts)

    def impacts(self, n_docs: int, n_words: int) -> np.ndarray:
        m = 10 + 90 * self.length * n_docs // n_words
        count = self.count.astype(np.int64)
        return 1_000_000_000 * count // (1000 * count + 8 * np.repeat(m, np.diff(self.first)))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, IS_SIGN)


def forward(ids: np.ndarray, null: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, Forward]:
    """The vocabulary and the forward index of documents, from the hashes of their words one after the other."""
    terms, term = np.unique(hashes, return_inverse=True)
    length = np.diff(first)
    pairs, count = np.unique(np.repeat(np.arange(len(ids)), length) * len(terms) + term, return_counts=True)
    doc, term = np.divmod(pairs, max(1, len(terms)))
    return terms, Forward(ids, null, length, np.searchsorted(doc, np.arange(len(ids) + 1)), term, count)


def indexed(docs: DataFrame) -> Index:
    """Write the index of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_words = 0
        for batch in batches:
            for _, data, offsets in chunks(batch):
                length = np.diff(words_of(data, offsets).first)
                n_docs, n_words = n_docs + int((length > 0).sum()), n_words + int(length.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_words], pa.int64())], names=["docs", "words"])

    n_docs, n_words = texts.mapInArrow(count, "docs long, words long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, offsets in chunks(batch, size=BLOCK_BYTES):
                words = words_of(data, offsets)
                hashes, column = words.hashes(folded=True), rows.column("doc_id")
                null, ids = np.asarray(column.is_null()), column.fill_null(0).to_numpy()
                some = np.flatnonzero(np.diff(words.first))
                for at in range(0, len(some), BLOCK_DOCS):
                    own = some[at : at + BLOCK_DOCS]
                    a, b = words.first[own[0]], words.first[own[-1] + 1]
                    starts = np.append(words.first[own], b) - a
                    terms, index = forward(ids[own], null[own], hashes[a:b], starts)
                    impact, most = index.impacts(n_docs, n_words), np.zeros(len(terms), np.int64)
                    np.maximum.at(most, index.term, impact)
                    known = ids[own][~null[own]]
                    row = [block, len(own), int(b - a), int(known.min()) if len(known) else None, terms.astype("<u8").tobytes(), np.bincount(index.term).astype("<u4").tobytes(), most.astype("<u4").tobytes(), index.pack()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX)], schema=_INDEX)
                    block += 1

    return Index(written(texts.mapInArrow(build, INDEX), "lexical"), n_docs, n_words)


class Queries(NamedTuple):
    """Distinct terms in ascending order with their weights; of query i the terms numbered ``term[first[i] : first[i + 1]]``."""

    terms: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    term: np.ndarray


class Found(NamedTuple):
    """A document for a query; the least is the best."""

    score: int  # negative
    null: bool
    doc_id: int


class Block:
    """One row of the index, as one part of the queries sees it."""

    def __init__(self, queries: Queries, terms: bytes, most: bytes, least: int | None, packed: bytes):
        own = np.frombuffer(terms, "<u8")
        at = np.minimum(np.searchsorted(own, queries.terms), len(own) - 1)
        self.asked = np.flatnonzero(own[at] == queries.terms)
        self.own, self.size, self.packed = at[self.asked], len(own), packed
        self.least = (least is None, least or 0)
        value = np.zeros(len(queries.terms), np.int64)
        value[self.asked] = queries.weight[self.asked] * np.frombuffer(most, "<u4")[self.own]
        #: Of each query the most that a document of the block can score.
        self.bounds = np.add.reduceat(value[queries.term], queries.first[:-1])
        self.index = None

    def load(self, queries: Queries, n_docs: int, n_words: int) -> None:
        """Unpack the forward index and keep what the queries ask for, by term."""
        self.index = index = Forward.unpack(self.packed)
        number = np.full(self.size, -1)
        number[self.own] = self.asked
        asked = number[index.term]
        kept = np.flatnonzero(asked >= 0)
        kept = kept[np.argsort(asked[kept], kind="stable")]
        term = asked[kept]
        self.doc = np.repeat(np.arange(len(index.ids), dtype=np.int16), np.diff(index.first))[kept]
        self.value = queries.weight[term] * index.impacts(n_docs, n_words)[kept]
        self.start = np.searchsorted(term, np.arange(len(queries.terms) + 1)).astype(np.int32)
        self.index = index._replace(term=None, count=None, first=None)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Score of each document for these terms."""
        a, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        total = np.zeros(len(self.index.ids), np.int64)
        np.add.at(total, self.doc[at], self.value[at])
        return total


class Search:
    """The best documents of each query in all blocks that were given so far."""

    def __init__(self, queries: Queries, n_docs: int, n_words: int, k: int):
        self.queries, self.size, self.k = queries, (n_docs, n_words), k
        self.found: list[list[Found]] = [[] for _ in queries.first[:-1]]
        self.scored = 0

    def add(self, blocks: list[Block]) -> None:
        bounds = np.array([b.bounds for b in blocks])
        for i, found in enumerate(self.found):
            terms = self.queries.term[self.queries.first[i] : self.queries.first[i + 1]]
            for at in np.argsort(-bounds[:, i], kind="stable").tolist():
                bound, block = int(bounds[at, i]), blocks[at]
                last = found[-1] if len(found) == self.k else Found(-1, True, 0)  # a score of one, or of the k-th
                if bound < -last.score:
                    break
                if bound == -last.score and len(found) == self.k and block.least > last[1:]:
                    continue
                if block.index is None:
                    block.load(self.queries, *self.size)
                self.scored += 1
                total, index = block.scores(terms), block.index
                good = np.flatnonzero((total > -last.score) | (total == -last.score) & ((len(found) < self.k) | index.null | (index.ids <= last.doc_id)))
                if len(good):
                    found += [Found(-int(total[j]), bool(index.null[j]), int(index.ids[j])) for j in good.tolist()]
                    found.sort()
                    del found[self.k :]


def parts_of(queries: DataFrame, part_bytes: int) -> int:
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-size // part_bytes) or 1


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch):
            words = words_of(data, offsets)
            item = rows.column("item_id").take(pa.array(np.repeat(np.arange(len(rows)), np.diff(words.first))))
            yield pa.RecordBatch.from_arrays([item, pa.array(words.hashes(folded=True).view(np.int64))], names=["item_id", "term"])


def weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def search(index: Index, queries: DataFrame, k: int = K, part_bytes: int = PART_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query (item_id, text)."""
    rows = queries.select("item_id", "text")
    parts, out = parts_of(rows, part_bytes), None
    for part in range(parts):
        found = _part(index, rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part), k)
        out = found if out is None else out.unionByName(found)
    return out


def _part(index: Index, rows: DataFrame, k: int) -> DataFrame:
    spark, (n_docs, n_words) = rows.sparkSession, index[1:]
    schema = rows.select("item_id").schema
    asked = rows.mapInArrow(_terms, schema.add("term", "long")).distinct().toArrow()
    item = asked["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    names, number = item.dictionary, item.indices.to_numpy(zero_copy_only=False)
    terms, term = np.unique(asked["term"].to_numpy().view(np.uint64), return_inverse=True)
    by = np.argsort(number, kind="stable")
    shared = spark.sparkContext.broadcast(terms)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, count in zip(batch.column("terms"), batch.column("holders")):
                own = np.frombuffer(own.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(own, shared.value), len(own) - 1)
                here = np.flatnonzero(own[at] == shared.value)
                total[here] += np.frombuffer(count.as_buffer(), "<u4")[at[here]]
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(total[here])], names=["term", "holders"])

    n = dict(index.table.select("terms", "holders").mapInArrow(holders, "term int, holders long").groupBy("term").agg(F.sum("holders")).toLocalIterator())
    own = Queries(terms, np.array([weight(n_docs, n.get(i, 0)) for i in range(len(terms))], np.int64), np.append(runs(number[by])[0], len(by)), term[by])
    known = spark.sparkContext.broadcast(own)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(known.value.terms):
            return
        state = Search(known.value, n_docs, n_words, k)
        for batch in batches:
            columns = [[v.as_buffer() for v in batch.column(c)] for c in ("terms", "most", "forward")]
            state.add([Block(known.value, t, m, least, f) for t, m, f, least in zip(*columns, batch.column("least").to_pylist())])
        rows = [(i, None if f.null else f.doc_id, -f.score) for i, found in enumerate(state.found) for f in found]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    found = index.table.select("least", "terms", "most", "forward").mapInArrow(best, "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    deal = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    few = found.withColumn("deal", deal).withColumn("rank", F.row_number().over(Window.partitionBy("item", "deal").orderBy(*order))).where(F.col("rank") <= k)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    items = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int32()), "item_id": names}), "item int, item_id " + schema["item_id"].dataType.simpleString())
    return top.join(F.broadcast(items), "item").select("item_id", "rank", "doc_id", "score")
