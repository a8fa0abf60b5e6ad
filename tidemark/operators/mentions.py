"""Relations named in text: where a phrase stands, what stands around it, and which entities it links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases and the relation that each names.
PHRASES = (
    (r"supplier[s]? (?:to|of|for)", "supplier_of"),
    (r"customer[s]? (?:of|for)", "customer_of"),
    (r"compet(?:es?|itor[s]?) with", "competes_with"),
    (r"partner(?:ed|ship)? with", "partner_of"),
    (r"acqui(?:red|ring|sition of)", "acquired"),
    (r"joint venture with", "joint_venture_with"),
    (r"licens(?:es?|or[s]?) (?:to|from)", "licenses_to"),
    (r"manufactur(?:es?|er[s]?) for", "manufactures_for"),
    (r"distribut(?:es?|or[s]?) for", "distributes_for"),
)
#: Characters of context before and after a phrase.
BEFORE, AFTER = 50, 100
#: Words of the longest name that is looked up.
NAME_WORDS = 3
#: Places of a block, and the characters of a text that are dealt together.
PLACES, STRETCH = 8192, 65536
FOUND = "doc_id long, rel string, start int, stop int, before string, after string, evidence string"


def mentioned(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """doc_id, rel, start, stop (characters, stop exclusive), before, after and evidence (the phrase with both, trimmed) of every place of every phrase, ASCII letters in either case.

    One pass over the texts, linear in them; places of different phrases may overlap. Null texts have none; equal rows each have theirs.
    """
    kinds = [(re.compile(p, re.IGNORECASE | re.ASCII), rel) for p, rel in phrases]
    schema = pa.schema([("doc_id", pa.int64()), ("rel", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("evidence", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                for pattern, rel in kinds if text else ():
                    for m in pattern.finditer(text):
                        a, b = max(0, m.start() - BEFORE), m.end() + AFTER
                        found.append((doc_id, rel, m.start(), m.end(), text[a : m.start()], text[m.end() : b], text[a:b].strip()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 7, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, FOUND)


def words(text: str) -> Column:
    """Runs of letters, digits, _, #, $ and & of a context, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w#$&]+"), 0)


def names(found: Column, sizes: Column) -> Column:
    """All runs of 1 to ``NAME_WORDS`` of some words whose length is one of ``sizes``, joined by a space."""
    starts = lambda k: F.sequence(F.lit(1), F.size(found) - k + 1)
    runs = lambda k: found if k == 1 else F.transform(starts(k), lambda i: F.array_join(F.slice(found, i, k), " "))
    return F.concat(*(F.when(F.array_contains(sizes, k) & (F.size(found) >= k), runs(k)).otherwise(F.array().cast("array<string>")) for k in range(1, NAME_WORDS + 1)))


def _runs(lists: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All runs of k words of each row, joined by a space, in order: their row, their first word among all words, and the text."""
    ends, words = lists.offsets.to_numpy().astype(np.int64), lists.values
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    at = np.flatnonzero(row[: max(len(row) - k + 1, 0)] == row[k - 1 :])
    start = at + ends[0]
    return row[at], start, pc.binary_join_element_wise(*(words.take(pa.array(start + i)) for i in range(k)), " ")


def _asked(rows: pa.Table) -> pa.Table:
    """The different names of a block: runs of 1 to ``NAME_WORDS`` words whose length an alias has."""
    sizes = sorted({k for k in rows["_sizes"][0].as_py() if k <= NAME_WORDS})
    found = pa.chunked_array([_runs(rows[c].combine_chunks(), k)[2] for c in ("_before", "_after") for k in sizes], pa.string()).unique()
    return pa.table([pa.repeat(rows["_block"][0], len(found)), found], names=["_block", "alias"])


def _nearest(lists: pa.ListArray, aliases: pa.Array, entities: pa.Array, sizes: list[int], last: bool) -> pa.Array:
    """For each row the entity of the run that ends last, or begins first, then of the longest; ``sizes`` are those of the aliases, the smallest first."""
    near, which = np.full(len(lists), -1), np.full(len(lists), -1)
    for k in sizes:
        row, start, names = _runs(lists, k)
        hit = pc.fill_null(pc.index_in(names, value_set=aliases), -1).to_numpy(zero_copy_only=False)
        row, start, hit = (x[hit >= 0] for x in (row, start, hit))
        edge = row[1:] != row[:-1]
        one = np.flatnonzero(np.append(edge, True) if last else np.append(True, edge)) if len(row) else np.zeros(0, np.int64)
        key = start[one] + k if last else len(lists.values) - start[one]
        better = key >= near[row[one]]
        near[row[one][better]], which[row[one][better]] = key[better], hit[one][better]
    return entities.take(pa.array(which, mask=which < 0))


def resolved(found: DataFrame, aliases: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``mentioned`` rows, with whichever columns they have beside doc_id, start, before and after, and ``src`` and ``dst``: the nearest entity before and after the phrase by ``aliases`` (alias, entity); null where there is none.

    The nearest is the one that ends, or begins, closest to the phrase, then the longest. An alias of several entities
    counts for the first. Places are dealt into blocks of about ``PLACES``; the different names of a block are joined to the
    aliases, however many these are, and those that are one come back to the block: what is shuffled is each place once
    and each name once a block. A stretch of a text is in one block, rows without doc_id are dealt by their context.
    ``counted`` is one row with about how many ``rows`` of ``found`` there are, where it is known without making them;
    else they are made once more for it. It only settles the number of blocks.
    """
    known = aliases.select(F.lower("alias").alias("alias"), "entity").where("alias is not null and entity is not null").groupBy("alias").agg(F.min("entity").alias("entity"))
    sizes = known.agg(F.collect_set(F.size(F.split("alias", " "))).alias("_sizes"))  # one row
    rows = found.agg(F.count("*").alias("rows")) if counted is None else counted
    n = rows.select(F.greatest(F.ceil(F.col("rows") / PLACES), F.lit(1)).alias("_n"))  # one row
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.floor(F.col("start") / STRETCH))).otherwise(F.xxhash64("before", "after"))
    places = found.crossJoin(F.broadcast(n)).withColumn("_block", F.pmod(own, "_n")).drop("_n")
    # both the names and the rows are made of this exchange, so the texts are read once; words are not shuffled
    split = places.repartition("_block").withColumns({"_before": words("before"), "_after": words("after")})
    asked = split.crossJoin(F.broadcast(sizes)).groupBy("_block").applyInArrow(_asked, "_block long, alias string")
    told = asked.join(known, "alias").select(*(F.col(c).alias(c) for c in ("_block", "alias", "entity")))

    columns = found.columns

    def look(rows: pa.Table, entities: pa.Table) -> pa.Table:
        by = [entities[c].combine_chunks() for c in ("alias", "entity")]
        lengths = sorted({a.count(" ") + 1 for a in by[0].to_pylist()})
        ends = [_nearest(rows[c].combine_chunks(), *by, lengths, last) for c, last in (("_before", True), ("_after", False))]
        return rows.select(columns).append_column("src", ends[0]).append_column("dst", ends[1])

    return split.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(look, T.StructType([*found.schema.fields, T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())]))


def relations(linked: DataFrame) -> DataFrame:
    """(src, dst, rel, n, first_doc) of ``resolved`` rows with two different ends."""
    return linked.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst", "rel").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


#: Words in capitals that are no symbols.
NO_SYMBOLS = ("CEO", "CFO", "COO", "CTO", "IPO", "ETF", "SEC", "FED", "GDP", "CPI", "AI", "ML", "US", "EU", "UK", "NEW", "THE", "FOR", "AND", "BUT")


def symbols(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, symbol) named with a dollar sign or after a word like shares or ticker; only ``known`` ones (symbol), if given. One row a document and symbol."""
    after_sign = F.regexp_extract_all("text", F.lit(r"\$([A-Z]{1,5})\b"), 1)
    after_word = F.regexp_extract_all("text", F.lit(r"\b(shares?|stock|ticker|symbol|NYSE|NASDAQ)\s+([A-Z]{1,5})\b"), 2)
    found = docs.select("doc_id", F.explode(F.array_except(F.array_distinct(F.concat(after_sign, after_word)), F.array(*map(F.lit, NO_SYMBOLS)))).alias("symbol"))
    found = found.distinct()
    return found.join(known.select(F.upper("symbol").alias("symbol")).distinct(), "symbol", "left_semi").select("doc_id", "symbol") if known is not None else found


#: Relations between names that are known beforehand, by kind, and how a macro series moves a sector.
SUPPLIERS = (
    ("TSM", "NVDA", "semiconductor_manufacturing", 0.10), ("TSM", "AMD", "semiconductor_manufacturing", 0.09), ("TSM", "AAPL", "semiconductor_manufacturing", 0.25), ("TSM", "QCOM", "semiconductor_manufacturing", 0.08),
    ("TSM", "AVGO", "semiconductor_manufacturing", 0.06), ("ASML", "TSM", "lithography_equipment", None), ("ASML", "INTC", "lithography_equipment", None), ("AMAT", "TSM", "process_equipment", None),
    ("LRCX", "TSM", "process_equipment", None), ("FOXCONN", "AAPL", "contract_manufacturing", None), ("QCOM", "AAPL", "modems", None), ("NVDA", "MSFT", "gpu_infrastructure", None),
    ("NVDA", "GOOGL", "gpu_infrastructure", None), ("NVDA", "META", "gpu_infrastructure", None), ("NVDA", "AMZN", "gpu_infrastructure", None), ("SLB", "XOM", "oilfield_services", None),
    ("SLB", "CVX", "oilfield_services", None), ("TMO", "LLY", "research_services", None), ("TMO", "MRK", "research_services", None),
)


def with_known(found: DataFrame, known: DataFrame) -> DataFrame:
    """Relations (src, dst, rel, n, first_doc) and ``known`` ones (src, dst, rel): one row each, with whether it was known and whether it was read; n is 0 where it was not."""
    told = known.select("src", "dst", "rel").distinct().withColumn("known", F.lit(True))
    both = found.withColumn("read", F.lit(True)).join(told, ["src", "dst", "rel"], "full")
    return both.select("src", "dst", "rel", F.coalesce("n", F.lit(0)).alias("n"), "first_doc", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("read", F.lit(False)).alias("read"))


def chain(found: DataFrame, rel: str = "supplier_of") -> DataFrame:
    """(src, tier, n_names): how many names are reached from each along one relation directly and over one name between; not the name itself."""
    edge = found.where(F.col("rel") == rel).select("src", "dst").distinct()
    over = edge.alias("x").join(edge.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst")).where("src <> dst").distinct()
    far = over.join(edge, ["src", "dst"], "left_anti")
    return edge.withColumn("tier", F.lit(1)).unionByName(far.withColumn("tier", F.lit(2))).groupBy("src", "tier").agg(F.count("*").alias("n_names"))


def ranked(found: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` relations of each kind by their mentions (ties by ends), with their rank."""
    order = Window.partitionBy("rel").orderBy(F.desc("n"), "src", "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
