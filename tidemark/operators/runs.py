"""Discovery as one run over what is new: correlations kept up to date by their sums, the graph they make, and what has changed in it.

A run reads the closes (asset, ts, close) of the days after the last run alone. It keeps, as partitions of a version:
the last close of each asset; of each pair of assets the sums of its common returns, to which those of the new days
are added; the edges that the sums give; the ranking of the nodes. Each is written once and read by what follows.
A row in the ledger, written last, ends a run. A run that finds no new day writes nothing; one that was cut
short has no row in the ledger, and the next one writes its version again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import degrees
from tidemark.operators.pairwise import pairwise
from tidemark.sources.sinks import stored

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
LEDGER = "version int, upto date, n_days long, n_closes long"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """version, upto (the last day that is in it), n_days and n_closes that its run has read."""
    found = stored(spark, f"{folder}/ledger")
    return spark.createDataFrame([], LEDGER) if found is None else found


def table(spark: SparkSession, folder: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}/version={version}")


def _kept(rows: DataFrame, folder: str, name: str, version: int) -> DataFrame:
    path = f"{folder}/{name}/version={version}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _sums(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    return [(len(x), *map(float, (x.sum(), y.sum(), x @ x, y @ y, x @ y)))] if len(x) else []


def edges_of(sums: DataFrame, least_rows: int, least: float) -> DataFrame:
    """(a, b, n, r) of pairs of ``least_rows`` common returns whose correlation is ``least`` or more in size."""
    spread = lambda s: F.col(f"s{s}{s}") - F.col(f"s{s}") * F.col(f"s{s}") / F.col("n")
    varies = (spread("x") > 1e-12 * F.col("sxx")) & (spread("y") > 1e-12 * F.col("syy"))
    r = F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("x") * spread("y")))
    return sums.where(F.col("n") >= least_rows).select("a", "b", "n", r.alias("r")).where(F.abs("r") >= least)


def ranking_of(edges: DataFrame) -> DataFrame:
    """(node, degree, strength, rank): nodes by the sum of |r| of their edges, then by name. One row a node with edges; nodes are assets, so one window ranks them."""
    ends = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("r").alias("size"))
    each = ends.select(F.explode(F.array("src", "dst")).alias("node"), "size").groupBy("node").agg(F.sum("size").alias("strength"))
    order = Window.orderBy(F.desc(F.round("strength", 9)), "node")
    return degrees(ends).join(each, "node").select("node", "degree", "strength", F.row_number().over(order).alias("rank"))


def discovered(closes: DataFrame, folder: str, upto: str | None = None, least_rows: int = 60, least: float = 0.35) -> int | None:
    """Run over the days after the last version's (up to ``upto``); the version that holds now, None if there is none."""
    spark = closes.sparkSession
    before = ledger(spark, folder).orderBy(F.desc("version")).first()
    found = closes.select("asset", "ts", "close").where("asset is not null and close is not null and ts is not null")
    fresh = found.where(F.col("ts") > F.lit(before.upto)) if before else found
    fresh = fresh.where(F.col("ts") <= F.lit(upto).cast("date")) if upto else fresh
    version = before.version + 1 if before else 1
    if fresh.isEmpty():
        return before.version if before else None
    new = _kept(fresh, folder, "closes", version)
    old = table(spark, folder, "last", before.version) if before else new.limit(0)
    known = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    _kept(known.groupBy("asset").agg(F.max_by(F.struct("ts", "close"), "ts").alias("l")).select("asset", "l.*"), folder, "last", version)
    step = Window.partitionBy("asset").orderBy("ts")
    returns = known.withColumn("ret", F.try_divide("close", F.lag("close").over(step)) - 1).where("_new and ret is not null").select("asset", "ts", "ret")
    sums = pairwise(returns, _sums, "n long, " + ", ".join(f"{c} double" for c in SUMS[1:]))
    if before:
        sums = table(spark, folder, "sums", before.version).unionByName(sums).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in SUMS))
    edges = _kept(edges_of(_kept(sums, folder, "sums", version), least_rows, least), folder, "edges", version)
    _kept(ranking_of(edges), folder, "ranking", version)
    new.agg(F.lit(version).alias("version"), F.max("ts").alias("upto"), F.count_distinct("ts").alias("n_days"), F.count("*").alias("n_closes")).write.mode("append").parquet(f"{folder}/ledger")
    return version


def _pair(spark: SparkSession, folder: str, name: str, version: int) -> tuple[DataFrame, DataFrame]:
    now = table(spark, folder, name, version)
    return (table(spark, folder, name, version - 1) if version > 1 else now.limit(0)), now


def edge_changes(before: DataFrame, now: DataFrame, least: float = 0.01) -> DataFrame:
    """(a, b, change, before, now): edges that are new or gone, and those whose |r| has grown or shrunk by ``least``."""
    both = before.select("a", "b", F.col("r").alias("before")).join(now.select("a", "b", F.col("r").alias("now")), ["a", "b"], "full")
    by = F.abs("now") - F.abs("before")
    kind = F.when(F.col("before").isNull(), "gained").when(F.col("now").isNull(), "lost").when(by >= least, "strengthened").when(by <= -least, "weakened")
    return both.select("a", "b", kind.alias("change"), "before", "now").where("change is not null")


def rank_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(node, change, previous_rank, current_rank): nodes that moved up or down, and those that were not ranked before."""
    both = now.select("node", F.col("rank").alias("current_rank")).join(before.select("node", F.col("rank").alias("previous_rank")), "node", "left")
    kind = F.when(F.col("previous_rank").isNull(), "entered").when(F.col("current_rank") < F.col("previous_rank"), "up").when(F.col("current_rank") > F.col("previous_rank"), "down")
    return both.select("node", kind.alias("change"), "previous_rank", "current_rank").where("change is not null")


def metrics_of(edges: DataFrame, ranking: DataFrame) -> DataFrame:
    """(metric, value): n_edges, n_nodes, mean_degree, mean_r (of |r|), positive_share."""
    e = edges.agg(F.count("*").cast("double").alias("n_edges"), F.avg(F.abs("r")).alias("mean_r"), F.avg((F.col("r") > 0).cast("int")).alias("positive_share"))
    n = ranking.agg(F.count("*").cast("double").alias("n_nodes"), F.avg("degree").alias("mean_degree"))
    return e.crossJoin(n).unpivot([], ["n_edges", "n_nodes", "mean_degree", "mean_r", "positive_share"], "metric", "value")  # one row each


def report(spark: SparkSession, folder: str, version: int, top: int | None = None) -> DataFrame:
    """(section, subject, change, before, now) of a version against the one before it: metrics, edges, ranks; of edges and ranks the ``top`` largest changes, if given."""
    edges, ranking = _pair(spark, folder, "edges", version), _pair(spark, folder, "ranking", version)
    old, new = (metrics_of(e, r) for e, r in zip(edges, ranking))
    metric = old.withColumnRenamed("value", "before").join(new.withColumnRenamed("value", "now"), "metric", "full")
    size = F.abs(F.col("now") - F.col("before"))
    parts = [
        metric.select(F.lit("metric").alias("section"), F.col("metric").alias("subject"), F.when(F.col("now") > F.col("before"), "up").when(F.col("now") < F.col("before"), "down").otherwise("same").alias("change"), "before", "now"),
        edge_changes(*edges).select(F.lit("edge").alias("section"), F.concat_ws("/", "a", "b").alias("subject"), "change", "before", "now"),
        rank_changes(*ranking).select(F.lit("rank").alias("section"), F.col("node").alias("subject"), "change", F.col("previous_rank").cast("double").alias("before"), F.col("current_rank").cast("double").alias("now")),
    ]
    if top:
        cut: Callable[[DataFrame], DataFrame] = lambda p: p.orderBy(F.desc(F.coalesce(size, F.lit(0.0))), "subject").limit(top)
        parts[1:] = map(cut, parts[1:])
    return reduce(DataFrame.unionByName, parts)
