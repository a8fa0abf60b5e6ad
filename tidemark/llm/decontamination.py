"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

Items and documents are lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII characters.
Each run of ``window`` words of an item is a pattern, or the whole item if it is shorter. One pass over
a document finds all patterns; hits are mapped back to word numbers and to byte offsets of the original.

The automaton is broadcast. Its size is bounded: items are dealt into parts of at most
``MAX_PART_BYTES`` of text (measured first; an item is not divided), each part has its automaton and pass, and a document's hits
of all parts are united. Ordinary benchmarks are one part.

Null and empty texts have no words; an item without words hits nothing; rows of ``benchmark`` that share
an item_id are one item; those with a null item_id are one item that hits words and counts, but is not listed. Equal documents get equal results, one
row for each row of ``docs``; columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_scan import WORDS
from tidemark.llm.textarrays import IS_SPACE, buffers

WINDOW = 10
#: Benchmark text in one automaton; about 40 times as much memory.
MAX_PART_BYTES = 4 << 20

#: Stands for a null item_id.
NO_ID = "\x00"

SPAN = "array<struct<start:long,end:long>>"
#: ``runs`` are hit words, ``spans`` the bytes from the first to the last of each run.
SCHEMA = f"row long, doc_id long, n_words long, items array<string>, runs {SPAN}, spans {SPAN}"


def automaton(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton | None:
    """Patterns are windows between spaces; values are (number of words, item ids)."""
    patterns: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = text.encode().translate(WORDS).decode().split(" ")
        words = [w for w in words if w]
        for at in range(max(1, len(words) - window + 1) if words else 0):
            run = words[at : at + window]
            patterns.setdefault(f" {' '.join(run)} ", (len(run), set()))[1].add(item)
    if not patterns:
        return None
    machine = ahocorasick.Automaton()
    for pattern, (n, ids) in patterns.items():
        machine.add_word(pattern, (n, tuple(sorted(ids))))
    machine.make_automaton()
    return machine


def hits(normal: str, machine: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of hit words as (first, beyond the last), merged, and the items that hit, in a normalised text."""
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    at = n_spaces = 0
    for end, (n, ids) in machine.iter(normal):  # ends come in ascending order
        n_spaces += normal.count(" ", at, end)
        at = end
        items.update(ids)
        runs.append((n_spaces - n, n_spaces))  # before the closing space stand as many spaces as words so far
    merged: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged, items


def scanner(machine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("runs", span), ("spans", span)])

    def scan(batches):
        patterns = machine.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            raw, offsets = memoryview(data), offsets.tolist()
            found = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                mapped = bytes(raw[a:b]).translate(WORDS)
                words = mapped.split()
                runs, items = hits(f" {b' '.join(words).decode()} ", patterns) if words and patterns is not None else ([], set())
                spans = []
                if runs:
                    inner = ~IS_SPACE[np.frombuffer(mapped, np.uint8)]
                    start = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]]))
                    end = np.flatnonzero(inner & ~np.concatenate([inner[1:], [False]])) + 1
                    spans = [{"start": int(start[i]), "end": int(end[j - 1])} for i, j in runs]
                found.append((len(words), sorted(items), [{"start": i, "end": j} for i, j in runs], spans))
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)

    return scan


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    grown = lambda done, s: F.concat(
        F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
    )
    return F.aggregate(
        F.array_sort(spans), F.array().cast(SPAN), lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), grown(done, s)).otherwise(F.concat(done, F.array(s)))
    )


def parts_of(benchmark: DataFrame, part_bytes: int) -> tuple[DataFrame, int]:
    """(item, text) of items with words, and in how many parts of about ``part_bytes`` they are dealt."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit(NO_ID)).alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-size // part_bytes) or 1


def machine_of(items: DataFrame, k: int, parts: int, window: int):
    share = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
    return items.sparkSession.sparkContext.broadcast(automaton([(r[0], r[1]) for r in share.toLocalIterator()], window))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, whatever their ids; one filter after the other for the parts."""
    items, parts = parts_of(benchmark, part_bytes)
    clean, schema = docs, docs.schema
    for k in range(parts):
        clean = clean.mapInArrow(_kept(machine_of(items, k, parts, window)), schema)
    return clean


def _kept(machine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches):
        patterns = machine.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            raw, offsets = memoryview(data), offsets.tolist()
            clean = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                words = bytes(raw[a:b]).translate(WORDS).split()
                clean.append(patterns is None or next(patterns.iter(f" {b' '.join(words).decode()} "), None) is None)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """n_words, hit words, items that occur (ids, digest) and byte spans of hits: one row for each row of ``docs``."""
    spark = docs.sparkSession
    items, parts = parts_of(benchmark, part_bytes)
    texts = docs.select((F.lit(0) if parts == 1 else F.xxhash64("doc_id", "text")).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k in range(parts):
        one_pass = texts.mapInArrow(scanner(machine_of(items, k, parts, window)), SCHEMA)
        found = one_pass if found is None else found.unionByName(one_pass)
    if parts > 1:  # equal rows have equal hits and stand again as often as they came
        by_row = found.groupBy("row", "doc_id").agg(
            (F.count("*") / parts).cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            merged(F.flatten(F.collect_list("runs"))).alias("runs"), merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
        found = by_row.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    listed = F.array_remove("items", NO_ID)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), listed.alias("items"), "spans")
