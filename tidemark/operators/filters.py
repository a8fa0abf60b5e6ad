"""Filters and listings of registries: discoveries, sources, experiments, claims, graph edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(rows: DataFrame, equal: dict[str, object] | None = None, holds: dict[str, object] | None = None, least: dict[str, float] | None = None, within: dict[str, tuple[float, float]] | None = None, present: tuple[str, ...] = (), search: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows that pass all filters that are given; a filter of None is none.

    equal: columns by value; holds: arrays by member; least: at least so large, null fails; within: between, null passes;
    present: not null; search: a text in one of some columns, in any case.
    """
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.array_contains(c, v) for c, v in (holds or {}).items() if v is not None]
    tests += [F.col(c) >= v for c, v in (least or {}).items() if v is not None]
    tests += [F.col(c).isNull() | F.col(c).between(*v) for c, v in (within or {}).items() if v is not None]
    tests += [F.col(c).isNotNull() for c in present]
    if search and search[0]:
        tests.append(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(search[0].lower())) for c in search[1])))
    return reduce(lambda df, t: df.where(t), tests, rows)


def ordered(rows: DataFrame, column: str, descending: bool = True, tie: str | None = None, ranks: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Sorted by a column, nulls last in both directions, or by the place of its values in ``ranks`` (others last)."""
    key = F.col(column)
    if ranks:
        key = reduce(lambda other, kv: F.when(F.col(column) == kv[1], kv[0]).otherwise(other), enumerate(ranks), F.lit(len(ranks)))
        descending = False
    made = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *([tie] if tie else []))
    return made.limit(limit) if limit else made


def discovery_summary(found: DataFrame) -> DataFrame:
    """(measure, value): discoveries (a, b, strength, run_id) by strength, distinct series on either side, distinct runs."""
    series = found.select(F.explode(F.array("a", "b")).alias("s"))
    by = found.groupBy("strength").agg(F.count("*").alias("value")).select(F.col("strength").alias("measure"), "value")
    return by.unionAll(series.agg(F.lit("series").alias("measure"), F.count_distinct("s"))).unionAll(found.agg(F.lit("runs").alias("measure"), F.count_distinct("run_id")))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    return reduce(lambda a, b: a.unionAll(b), (df.agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, df in tables.items()))


def edges_between(edges: DataFrame, nodes: DataFrame, relation: str | None = None, kind: str | None = None, regime: str | None = None, limit: int = 800) -> DataFrame:
    """Edges (src, dst, rel_type, regime, weight) whose either end is of a kind, with both kinds; ``limit`` is that of the listing."""
    ends = edges.join(nodes.select(F.col("node").alias("src"), F.col("kind").alias("src_kind")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    kept = matching(ends, {"rel_type": relation, "regime": regime})
    kept = kept.where((F.col("src_kind") == kind) | (F.col("dst_kind") == kind)) if kind else kept
    return kept.orderBy(F.desc("weight"), "src", "dst", "rel_type").limit(limit)


def neighbours(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, other): nodes one edge away from each start, in either direction."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst"), F.col("src")))
    return starts.select("node").join(both, F.col("node") == F.col("src")).select("node", F.col("dst").alias("other")).distinct()


def two_hops(edges: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of targets a < b of one source, and how many sources they share."""
    left, right = edges.select("src", F.col("dst").alias("a")).distinct(), edges.select("src", F.col("dst").alias("b")).distinct()
    return left.join(right, "src").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def unknown_edges(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (a, b, ...) without a known edge (src, dst) in either direction."""
    both = known.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return candidates.join(both, (F.least(candidates.a, candidates.b) == both.a) & (F.greatest(candidates.a, candidates.b) == both.b), "left_anti")
