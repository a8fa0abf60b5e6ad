"""Property-graph operators over edge tables (src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half-lives in days of the confidence of each relation (fixed values), and of all others.
HALF_LIVES = {"BELONGS_TO": 3650.0, "SENSITIVE_TO": 180.0, "IMPACTS": 180.0, "CORRELATED_WITH": 60.0, "CAUSES": 45.0, "TRIGGERED_BY": 45.0, "GENERATES": 90.0, "TRAINED_ON": 365.0}
OTHER_HALF_LIFE = 90.0


def half_life(relation: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in HALF_LIVES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.col(relation)), F.lit(OTHER_HALF_LIFE))


def decayed(confidence: str, age_days: str, evidence: str, relation: str) -> Column:
    """Confidence after exponential decay: more evidence lengthens the half-life, a tenth always stays."""
    life = half_life(relation) * (1 + 0.2 * F.greatest(F.col(evidence) - 1, F.lit(0)))
    later = F.greatest(F.col(confidence) * F.pow(F.lit(0.5), F.col(age_days) / life), F.col(confidence) * 0.1)
    return F.least(F.greatest(F.when(F.col(age_days) <= 0, F.col(confidence)).otherwise(later), F.lit(0.0)), F.lit(1.0))


def staleness(age_days: str, evidence: str) -> Column:
    """fresh, aging, stale or expired: limits of 30, 90 and 180 days, a week more for each of up to five reconfirmations."""
    more = F.least(F.col(evidence) - 1, F.lit(5)) * 7
    return F.when(F.col(age_days) <= 30 + more, "fresh").when(F.col(age_days) <= 90 + more, "aging").when(F.col(age_days) <= 180 + more, "stale").otherwise("expired")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), undirected; a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hops(edges: DataFrame, start: DataFrame, most: int = 2) -> DataFrame:
    """(origin, node, hop): nodes reached from each origin (node) along directed edges, at the first hop that does.

    From the second hop on, the edges that go on from the front are an exchange of their own: where they are few (many
    origins reach few nodes) Spark broadcasts them, so that no task gathers and sorts all origins of one node.
    """
    links = edges.select("src", "dst").distinct()
    seen = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hop"))
    front = seen
    for k in range(1, most + 1):
        onward = links if k == 1 else links.join(front.select(F.col("node").alias("src")).distinct(), "src", "left_semi").repartition("src", "dst")
        reached = front.join(onward, front.node == onward.src).select("origin", F.col("dst").alias("node"), F.lit(k).alias("hop")).distinct()
        front = reached.join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def bridges(edges: DataFrame, least: int = 2) -> DataFrame:
    """Factors (dst) whose sources are of ``least`` classes or more: number of classes, sources and edges."""
    found = edges.where("class is not null").groupBy("dst").agg(F.count_distinct("class").alias("n_classes"), F.count_distinct("src").alias("n_sources"), F.count("*").alias("n_edges"))
    return found.where(F.col("n_classes") >= least)


def profile_similarity(weights: DataFrame) -> DataFrame:
    """Cosine of the factor profiles (node, factor, beta; missing is 0) of nodes a < b that share a factor."""
    norm = weights.groupBy("node").agg(F.sqrt(F.sum(F.col("beta") * F.col("beta"))).alias("norm"))
    sides = weights.where("beta <> 0").join(norm, "node")
    a, b = (sides.select("factor", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "beta", "norm"))) for s in "ab")
    met = a.join(b, "factor").where("node_a < node_b").groupBy("node_a", "node_b").agg(F.sum(F.col("beta_a") * F.col("beta_b")).alias("dot"), F.first("norm_a").alias("na"), F.first("norm_b").alias("nb"), F.count("*").alias("shared"))
    return met.select("node_a", "node_b", F.try_divide("dot", F.col("na") * F.col("nb")).alias("cosine"), "shared")


def merged_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """MERGE of edges by (src, dst, rel): endpoints must exist; evidence counts up, dates of first and last sight are kept."""
    known = nodes.select("node").distinct()
    for end in ("src", "dst"):
        new = new.join(known.withColumnRenamed("node", end), end, "left_semi")
    fresh = new.select("src", "dst", "rel").distinct().withColumn("_new", F.lit(1))
    both = old.join(fresh, ["src", "dst", "rel"], "full")
    day = F.lit(as_of).cast("date")
    return both.select("src", "dst", "rel", (F.coalesce("evidence", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("evidence"), F.coalesce("first_seen", day).alias("first_seen"), F.when(F.col("_new") == 1, day).otherwise(F.col("last_seen")).alias("last_seen"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """gained, lost and shifted keys between two snapshots."""
    both = before.withColumnRenamed(value, "before").join(after.withColumnRenamed(value, "after"), keys, "full")
    kind = F.when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "lost").when(F.abs(F.col("after") - F.col("before")) >= least, "shifted")
    return both.withColumn("change", kind).where("change is not null")
