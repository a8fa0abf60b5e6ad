"""Minimax contiguous partition of documents into shards.

Groups of equal texts stand in the order of their smallest doc_id and are never divided. The smallest
capacity is found for which cutting greedily - each shard takes groups as long as they fit - needs no
more than the wanted number of shards, and the groups are cut there.

Greedy cutting only asks where running sums of group sizes end. The running sums stay in a table; the
driver holds a bounded number of them (``MOST_SUMS``), spread over the whole range. With these each cut
of a capacity is known to lie in an interval, so most capacities are decided at once; when one is not,
the sums within the open intervals are fetched (or spread samples of them, again bounded) until it is.

Size is the UTF-8 bytes of the text plus ``OVERHEAD``; a null text has no bytes and is equal to the empty
one. Slots follow the order of groups, then doc_id (nulls first, then by size). Equal rows get slots of
their own. Without rows the result is empty. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import join_groups, n_partitions, written

SHARDS, OVERHEAD = 24, 8
#: Running sums that the driver holds at once.
MOST_SUMS = 100_000


def running(df: DataFrame, order: list[str], sums: dict[str, str], schema: str) -> DataFrame:
    """``df`` in order with running sums (including the row) of long columns, over all partitions.

    Only the total of each partition comes to the driver.
    """
    spark = df.sparkSession
    ordered = written(df.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordered")
    totals = ordered.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums)).orderBy("part").collect()
    offset, before = dict.fromkeys(sums, 0), {}
    for r in totals:
        before[r.part] = dict(offset)
        for c in sums:
            offset[c] += r[c]
    before = spark.sparkContext.broadcast(before)

    def add(table: pa.Table) -> pa.Table:
        own = before.value[table["part"][0].as_py()]
        table = table.sort_by([(c, "ascending") for c in order])
        for c, name in sums.items():
            table = table.append_column(name, pa.array(np.cumsum(table[c].to_numpy()) + own[c]))
        return table.drop_columns(["part"])

    return ordered.groupBy("part").applyInArrow(add, schema)


class Sums:
    """Some of the running sums, ascending, with the spans that are known in full.

    floor(x) brackets the largest running sum up to x: (largest known one up to x, a bound).
    """

    def __init__(self, known: list[int], full: list[tuple[int, int]]):
        self.known, self.full = known, full

    def floor(self, low: int, high: int) -> tuple[int, int]:
        """Bounds of the largest running sum up to some x between ``low`` and ``high``."""
        at = lambda x: self.known[bisect_right(self.known, x) - 1]
        exact = any(a <= at(high) and high < b for a, b in self.full)
        return at(low), at(high) if exact else high


def cuts(sums: Sums, capacity: int, shards: int, total: int) -> list[tuple[int, int]]:
    """Bounds of each shard's end."""
    low = high = 0
    ends = []
    for _ in range(shards):
        low, high = sums.floor(low + capacity, high + capacity)
        low, high = min(low, total), min(high, total)
        ends.append((low, high))
    return ends


def smallest_capacity(largest: int, total: int, shards: int, known: list[int], fetch: Callable[[list[tuple[int, int]]], tuple[list[int], bool]]) -> tuple[int, list[int]]:
    """(capacity, ends of the shards). ``fetch`` gives running sums within spans [a, b), and whether they are all."""
    if not total:
        return 0, [0] * shards
    sums = Sums(sorted({0, total, *known}), [])
    low, high = max(largest, -(-total // shards)), total
    while True:
        unsure = None
        while low < high:
            middle = (low + high) // 2
            a, b = cuts(sums, middle, shards, total)[-1]
            if a >= total:
                high = middle
            elif b < total:
                low = middle + 1
            else:
                unsure = middle
                break
        ends = cuts(sums, low if unsure is None else unsure, shards, total)
        spans = [(a, b + 1) for a, b in ends if a < b]
        if not spans:
            if unsure is None:
                return low, [a for a, _ in ends]
            raise AssertionError("bounds that meet decide every capacity")
        more, whole = fetch(spans)
        sums = Sums(sorted({*sums.known, *more}), sums.full + (spans if whole else []))


PLACED = "first long, doc_id long, size long, text_crc32 long, one long, rank long"
GROUPED = "first long, size long, rows long, size_end long, rows_end long"


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest")), "sizes")
    first = F.coalesce("doc_id", F.lit(-(1 << 63)))
    groups = written(rows.groupBy("digest").agg(F.min(first).alias("first"), F.sum("size").alias("size"), F.count("*").alias("rows")), "groups")
    sums = written(running(groups.select("first", "size", "rows"), ["first", "size", "rows"], {"size": "size_end", "rows": "rows_end"}, GROUPED), "sums")
    largest, total, n, n_rows = sums.agg(F.max("size"), F.sum("size"), F.count("*"), F.sum("rows")).first()

    def fetch(spans: list[tuple[int, int]]) -> tuple[list[int], bool]:
        within = F.lit(False)
        for a, b in spans:
            within |= (F.col("size_end") >= a) & (F.col("size_end") < b)
        found = sums.where(within)
        step = -(-found.count() // MOST_SUMS)
        taken = found if step <= 1 else found.where(F.pmod(F.xxhash64("size_end"), F.lit(step)) == 0)
        return [r[0] for r in taken.select("size_end").distinct().collect()], step <= 1

    spread = sums.where(F.pmod(F.xxhash64("size_end"), F.lit(max(1, (n or 0) // (MOST_SUMS // 4)))) == 0).select("size_end").collect()
    _, ends = smallest_capacity(largest or 0, total or 0, shards, [r[0] for r in spread], fetch)
    # the last group of each shard, and how many rows stand up to it
    last = {r.size_end: (r.rows_end, r.first) for r in sums.where(F.col("size_end").isin(ends)).collect()}
    ranks = [0] + [last[e][0] if e else 0 for e in ends]
    where = join_groups(rows, groups.select("digest", "first", "rows"), ["digest"], "rows", n_rows or 0).select("first", "doc_id", "size", "text_crc32", F.lit(1).cast("long").alias("one"))
    placed = running(where, ["first", "size", "doc_id"], {"one": "rank"}, PLACED)
    number = F.lit(0)
    begin = F.lit(0).cast("long")
    for k in range(1, shards):
        beyond = F.col("rank") > ranks[k]
        number, begin = number + beyond.cast("int"), F.when(beyond, F.lit(ranks[k]).cast("long")).otherwise(begin)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), number.alias("shard"), (F.col("rank") - 1 - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
