"""Documents dealt into blocks, and packed questions of the blocks about hashed items.

The texts are shuffled once, to blocks of about ``BLOCK_BYTES``, and kept compressed in a table bucketed
by block. Every later pass is a job over the blocks with what was found out about each so far, which
moves no text again.

To learn which hashed items (shingles, windows) other documents have too, a block sends the distinct
hashes of its items, in ascending order, as one row cut by *buckets* (ranges of the hash). The rows of a *group* of blocks meet in
a task, which sends each bucket one row for all of them; a bucket compares what all groups sent and answers each with one flag a
hash, in the same order; the group's task hands each block its flags, again as one row. The block makes its items anew
from its texts and reads the flags. So an item that is everywhere costs each block one entry; no task
gathers all its places. There are as many groups as buckets, one for the root of the text in units of ``ROW_BYTES``:
the rows between groups and buckets are in proportion to the text, and what a group or a bucket holds grows with its root.

A bucket tells hashes apart by the 32 low bits within its range of the high ones where a false alarm
does no harm (a later, stricter question follows), and by 64 or 128 bits where it decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import cleared, forget, n_partitions, new_path, written
from tidemark.llm.textarrays import chunks, mixed

#: Most and least bytes of text of a block (where partitions would go without), text for a row between a group and a bucket, and least buckets.
BLOCK_BYTES, LEAST_BYTES, ROW_BYTES, LEAST_BUCKETS = 8 << 20, 1 << 20, 256 << 10, 32

#: What a block sends: up to three columns of bytes, each cut by buckets; ``lengths`` are, for all buckets, the numbers of answers that are wanted and the bytes of each column.
ASKED = "block int, lengths binary, a binary, b binary, c binary"
#: ``flags`` are the answers to one block in the order of what it sent.
ANSWER = "block int, level int, bucket int, flags binary"
PACKED = "group int, bucket int, blocks binary, sizes binary, a binary, b binary, c binary"
ANSWERED = "group int, bucket int, blocks binary, sizes binary, found binary"
COLUMNS = ("a", "b", "c")
_ASKED, _PACKED, _ANSWERED = (pa.schema([(n.split()[0], pa.int32() if n.endswith("int") else pa.binary()) for n in s.split(", ")]) for s in (ASKED, PACKED, ANSWERED))


class Blocks(NamedTuple):
    table: DataFrame
    buckets: int
    size: int


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``text`` as a compressed ``packed``; a null text stays null."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for rows, data, offsets in chunks(batch):
            raw, at, null = memoryview(data), offsets.tolist(), rows.column("text").is_null().to_pylist()
            packed = [None if n else pack.compress(raw[a:b]) if b > a else b"" for a, b, n in zip(at[:-1], at[1:], null)]
            others = [n for n in rows.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in others), pa.array(packed, pa.binary())], names=[*others, "packed"])


def blocks(docs: DataFrame, whole: bool = False) -> Blocks:
    """The rows (doc_id, text) of ``docs`` in blocks; ``whole``: with all columns, as a struct ``row``, too.

    Rows of equal id and text are in one block. A null text counts as an empty one.
    """
    spark, n = docs.sparkSession, n_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES), min(2 * n, -(-size // LEAST_BYTES)))
    row = [F.struct([F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if whole else []
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", *row)
    schema = T.StructType([f for f in dealt.schema if f.name != "text"]).add("packed", "binary")
    name = new_path(spark, "blocks")
    table = "tidemark_" + name.rsplit("-", 1)[1]
    with cleared(spark):
        dealt.mapInArrow(_pack, schema).repartition(n, "block").write.option("path", name).option("compression", "none").bucketBy(n, "block").saveAsTable(table)
    return Blocks(spark.table(table), max(LEAST_BUCKETS, math.isqrt(size // ROW_BYTES)), size)


def dropped(dealt: Blocks) -> None:
    """Delete blocks that nothing reads any more."""
    for file in dealt.table.inputFiles()[:1]:
        forget(dealt.table)
        dealt.table.sparkSession.sql("DROP TABLE tidemark_" + file.split("/")[-2].rsplit("-", 1)[1])


class Texts:
    """The texts of one block: ``doc_ids``, bytes, offsets and ``digests``, ordered by doc_id (null first) and digest of the text."""

    def __init__(self, table: pa.Table):
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(p) if p else b"" for p in table["packed"].to_pylist()]
        digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        ids = table["doc_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, digests[i]))
        self.block = table["block"][0].as_py() if len(ids) else None
        self.table, self.order = table, order
        self.doc_ids, self.digests = [ids[i] for i in order], [digests[i] for i in order]
        self.data = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in order], dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.doc_ids)

    def rows(self, places: list[int], columns: list[str]) -> pa.Table:
        """Whole rows at these places, with the columns of the documents (blocks made ``whole``)."""
        kept = self.table.take(pa.array([self.order[k] for k in places], pa.int64()))
        row = kept["row"].combine_chunks()
        null = kept["packed"].is_null().to_pylist()
        texts = [None if n else self.data[self.offsets[k] : self.offsets[k + 1]].tobytes().decode() for k, n in zip(places, null)]
        return pa.Table.from_arrays([pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in columns], names=columns)


def passing(table: DataFrame, found: DataFrame | None, work: Callable, schema: str) -> DataFrame:
    """``work(texts, found rows of the block)`` for each block; ``found`` has a column ``block``."""
    if found is None:
        return table.groupBy("block").applyInArrow(lambda t: work(Texts(t), None), schema)

    def both(texts: pa.Table, rows: pa.Table) -> pa.Table:
        return work(Texts(texts), rows)

    return table.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(both, schema)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascends with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Items:
    """The distinct items of a block, in order, of hashes (and second hashes, where it takes 128 bits)."""

    def __init__(self, hashes: np.ndarray, second: np.ndarray | None = None):
        hashes = mixed(hashes)  # items that were chosen as the smallest hashes spread over all buckets again
        self.order = np.argsort(hashes, kind="stable") if second is None else np.lexsort((second, hashes))
        h = hashes[self.order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if second is not None:
            s = second[self.order]
            new[1:] |= s[1:] != s[:-1]
            self.second = s[new]
        else:
            self.second = None
        self.group = np.cumsum(new) - 1
        self.hashes = h[new]
        self.count = np.bincount(self.group, minlength=len(self.hashes)) if len(h) else np.zeros(0, np.int64)

    def spread(self, flags: np.ndarray) -> np.ndarray:
        """Values of the distinct items for all items as they were given."""
        out = np.empty(len(self.order), flags.dtype)
        out[self.order] = flags[self.group]
        return out

    def packed(self, which: np.ndarray) -> np.ndarray:
        """Low 32 bits, or both hashes, of some of the items; one row each."""
        if self.second is None:
            return self.hashes[which].astype(np.uint32)
        return np.stack([self.hashes[which], self.second[which]], axis=1)


def parcel(block: int | None, wanted: np.ndarray, parts: list[list[bytes]]) -> pa.Table:
    """The row of ``ASKED`` of a block from, for each bucket, how many answers it wants and the bytes of each column; no row without any."""
    lengths = np.array([wanted, *([len(p) for p in column] for column in parts)], "<u4")
    if block is None or not lengths.any():
        return _ASKED.empty_table()
    row = [block, zstandard.compress(lengths.tobytes(), 1), *(b"".join(column) for column in parts), *([b""] * (3 - len(parts)))]
    return pa.table([pa.array([x], f.type) for x, f in zip(row, _ASKED)], schema=_ASKED)


def _gathered(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """What the blocks of a group sent, by bucket."""
        table = table.sort_by("block")
        lengths = np.stack([np.frombuffer(zstandard.decompress(x), "<u4").reshape(-1, buckets) for x in table["lengths"].to_pylist()])  # block, what, bucket
        ends = np.cumsum(lengths, axis=2, dtype=np.int64)
        columns = [[memoryview(x) for x in table[c].to_pylist()] for c in COLUMNS[: lengths.shape[1] - 1]]
        blocks = table["block"].combine_chunks().to_numpy().astype("<i4").tobytes()
        rows = []
        for k in np.flatnonzero(lengths.any((0, 1))).tolist():
            parts = [b"".join([data[e - n : e] for data, e, n in zip(column, ends[:, i + 1, k].tolist(), lengths[:, i + 1, k].tolist())]) for i, column in enumerate(columns)]
            rows.append((key[0].as_py(), k, blocks, lengths[:, 0, k].tobytes(), *parts, *([b""] * (3 - len(parts)))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _PACKED)], schema=_PACKED)

    return gather


def _worked(work: Callable, bits: bool) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        found = work(*(table[c].to_pylist() for c in COLUMNS))
        ends = np.cumsum([0, *(int(np.frombuffer(s, "<u4").sum(dtype=np.int64)) for s in table["sizes"].to_pylist())]).tolist()
        parts = [(np.packbits(found[i:j]) if bits else found[i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:])]
        return pa.table([*(table[c].combine_chunks() for c in ("group", "bucket", "blocks", "sizes")), pa.array(parts, pa.binary())], schema=_ANSWERED)

    return answer


def _handed(level: int, bits: bool) -> Callable[[pa.Table], pa.Table]:
    def hand(table: pa.Table) -> pa.Table:
        """The answers of all buckets to a group, by block."""
        table = table.sort_by("bucket")
        blocks = np.frombuffer(table["blocks"][0].as_py(), "<i4").tolist()
        parts: list[list[np.ndarray]] = [[] for _ in blocks]
        for sizes, found in zip(table["sizes"].to_pylist(), table["found"].to_pylist()):
            ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)
            items = np.unpackbits(np.frombuffer(found, np.uint8), count=int(ends[-1])) if bits else np.frombuffer(found, np.uint8)
            for own, piece in zip(parts, np.split(items, ends[:-1])):
                own.append(piece)
        whole = [np.concatenate(p) for p in parts]
        flags = [(np.packbits(w) if bits else w).tobytes() for w in whole]
        n = len(blocks)
        return pa.table({"block": pa.array(blocks, pa.int32()), "level": pa.array([level] * n, pa.int32()), "bucket": pa.array([0] * n, pa.int32()), "flags": pa.array(flags, pa.binary())})

    return hand


def exchanged(parcels: DataFrame, buckets: int, work: Callable, level: int = 0, bits: bool = True, groups: int | None = None) -> DataFrame:
    """A row of ``ANSWER`` for each block that sent something. ``work`` gets, bucket by bucket, what groups of blocks sent (a list for each column)
    and gives the answers to all of it, one after the other: flags, or whole bytes without ``bits``. There are as many groups as buckets, if not told."""
    packed = parcels.withColumn("group", F.pmod("block", F.lit(groups or buckets))).groupBy("group").applyInArrow(_gathered(buckets), PACKED)
    return packed.groupBy("bucket").applyInArrow(_worked(work, bits), ANSWERED).groupBy("group").applyInArrow(_handed(level, bits), ANSWER)


def cut(data: np.ndarray, bucket: np.ndarray, buckets: int) -> list[bytes]:
    """The bytes of rows that ascend with their bucket, for each bucket."""
    at = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    return [data[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]


def asked(block: int | None, items: Items, buckets: int) -> pa.Table:
    """The row of ``ASKED``: hashes that the block has once (a; they want an answer), and others that it has more often (b)."""
    once = items.count == 1
    bucket = bucket_of(items.hashes, buckets)
    return parcel(block, np.bincount(bucket[once], minlength=buckets), [cut(items.packed(once), bucket[once], buckets), cut(items.packed(~once), bucket[~once], buckets)])


def _repeats(wide: bool) -> Callable:
    def repeats(ones: list[bytes], others: list[bytes], _: list[bytes]) -> np.ndarray:
        """Which of the ones occur anywhere else."""
        one, other = (np.frombuffer(b"".join(c), np.uint64 if wide else np.uint32) for c in (ones, others))
        both = np.concatenate([one, other])
        if wide:
            both = both.reshape(-1, 2)
            order = np.lexsort((both[:, 1], both[:, 0]))
            found = both[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]).any(1)
        else:
            order = np.argsort(both, kind="stable")
            found = both[order]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
        group = np.cumsum(new) - 1
        again = np.zeros(len(found), bool)
        again[order] = (np.bincount(group) > 1)[group]
        return again[: len(one) // 2 if wide else len(one)]

    return repeats


def answers(questions: DataFrame, level: int, buckets: int, wide: bool = False) -> DataFrame:
    """Rows of ``ANSWER``, written: which of the asked hashes another block has too."""
    return written(exchanged(questions, buckets, _repeats(wide), level), "answers")


def flagged(items: Items, found: pa.Table, level: int) -> np.ndarray:
    """Which items (as they were given) occur more than once, in this block or elsewhere."""
    repeats = items.count > 1
    once = np.flatnonzero(~repeats)
    for own, flags in zip(found["level"].to_pylist(), found["flags"].to_pylist()):
        if own == level:
            repeats[once] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(once)).astype(bool)
    return items.spread(repeats)


