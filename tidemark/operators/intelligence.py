"""Structure of a factor graph: divergence of regimes, stress of sectors, importance of events, anomalies, insights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import running
from tidemark.operators.scores import edge_confidence, unit


def divergence(betas: DataFrame) -> DataFrame:
    """(asset, factor, regime, beta_all, beta_regime, abs_change, rel_change, direction) of betas (asset, factor, regime, beta) against those of regime "all"."""
    base = betas.where("regime = 'all'").select("asset", "factor", F.col("beta").alias("beta_all"))
    found = betas.where("regime <> 'all'").withColumnRenamed("beta", "beta_regime").join(base, ["asset", "factor"])
    change = F.abs(F.col("beta_regime") - F.col("beta_all"))
    rel = F.when(F.abs("beta_all") > 1e-9, change / F.abs("beta_all"))
    return found.select("asset", "factor", "regime", "beta_all", "beta_regime", change.alias("abs_change"), rel.alias("rel_change"), F.when(F.abs("beta_regime") > F.abs("beta_all"), "amplified").otherwise("dampened").alias("direction"))


def wide_betas(betas: DataFrame, regimes: list[str]) -> DataFrame:
    """(asset, factor, a column for each regime)."""
    return betas.groupBy("asset", "factor").agg(*(F.max(F.when(F.col("regime") == r, F.col("beta"))).alias(f"beta_{r}") for r in regimes))


def exposure(divergences: DataFrame, bridges: DataFrame) -> DataFrame:
    """(asset, divergence: sum of changes, bridges: number of bridge factors (asset, factor))."""
    div = divergences.groupBy("asset").agg(F.sum("abs_change").alias("divergence"))
    return div.join(bridges.groupBy("asset").agg(F.count_distinct("factor").alias("bridges")), "asset", "full_outer").select("asset", F.coalesce("divergence", F.lit(0.0)).alias("divergence"), F.coalesce("bridges", F.lit(0)).alias("bridges"))


def sector_stress(members: DataFrame, exposures: DataFrame) -> DataFrame:
    """One row a sector of members (asset, sector): half by mean divergence, a quarter each by bridges and by the share of members that diverge."""
    own = members.join(exposures, "asset", "left").select("asset", "sector", F.coalesce("divergence", F.lit(0.0)).alias("d"), F.coalesce("bridges", F.lit(0)).alias("b"))
    done = own.groupBy("sector").agg(F.count("*").alias("members"), F.avg("d").alias("mean_divergence"), F.max("d").alias("max_divergence"), F.min_by("asset", F.struct(-F.col("d"), "asset")).alias("top"), F.avg("b").alias("mean_bridges"), F.avg((F.col("d") > 0).cast("int")).alias("breadth"))
    stress = 0.50 * F.least(F.col("mean_divergence") / 0.3, F.lit(1.0)) + 0.25 * F.least(F.col("mean_bridges") / 3, F.lit(1.0)) + 0.25 * F.col("breadth")
    return done.withColumns({"stress": stress, "most_divergent": F.when(F.col("max_divergence") > 0, F.col("top"))}).drop("top")


def importance(events: DataFrame, degrees: DataFrame, exposures: DataFrame, today: str, back: int = 7, ahead: int = 14) -> DataFrame:
    """Events (asset, event_date, ...) from ``back`` days before today to ``ahead`` days after, with their structural importance and whether they are upcoming."""
    day = F.lit(today).cast("date")
    near = events.where(F.col("event_date").between(F.date_sub(day, back), F.date_add(day, ahead)))
    done = near.join(degrees, "asset", "left").join(exposures, "asset", "left").fillna(0, ["degree", "divergence", "bridges"])
    score = 0.40 * F.least(F.col("degree") / 10, F.lit(1.0)) + 0.35 * F.least(F.col("divergence") / 0.3, F.lit(1.0)) + 0.25 * F.least(F.col("bridges") / 3, F.lit(1.0))
    return done.withColumns({"importance": score, "upcoming": F.col("event_date") >= day})


def measures(similar: DataFrame, divergences: DataFrame, bridges: DataFrame, degrees: DataFrame, sectors: DataFrame) -> DataFrame:
    """(metric, value) of a graph: similarity, divergence, bridges, centrality and stress. One aggregate of each table."""
    parts = [
        (similar, {"exposure_sim_mean": F.avg(F.abs("cosine")), "exposure_sim_max": F.max(F.abs("cosine")), "similar_pairs": F.count("*")}),
        (divergences, {"regime_divergence_mean": F.avg("abs_change"), "regime_divergence_max": F.max("abs_change"), "regime_amplified_pct": F.avg((F.col("direction") == "amplified").cast("int"))}),
        (bridges, {"bridge_count": F.count("*"), "bridge_max_span": F.max("n_classes")}),
        (degrees, {"centrality_top_degree": F.max("degree"), "centrality_mean_degree": F.avg("degree"), "nodes": F.count("*")}),
        (sectors, {"sector_stress_max": F.max("stress"), "sector_stress_mean": F.avg("stress"), "sectors": F.count("*")}),
    ]
    rows = [df.agg(F.array(*(F.struct(F.lit(n).alias("metric"), x.cast("double").alias("value")) for n, x in named.items())).alias("m")).select(F.inline("m")) for df, named in parts]
    return reduce(lambda a, b: a.unionAll(b), rows)


def anomalies(current: DataFrame, history: DataFrame, by: list[str], least: int = 3, threshold: float = 2.0) -> DataFrame:
    """Current values (by, value) that are ``threshold`` sample deviations off their history (by, value); history that does not vary names none."""
    past = history.where("value is not null").groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("depth")).where((F.col("depth") >= least) & (F.col("std") >= 1e-12))
    found = current.join(past, by).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std")).where(F.abs("z") >= threshold)
    return found.withColumns({"direction": F.when(F.col("z") > 0, "spike").otherwise("drop"), "severity": F.when(F.abs("z") >= 3, "critical").otherwise("warning")})


def rolling_anomalies(series: DataFrame, window: int = 252, least: int = 20, threshold: float = 3.0) -> DataFrame:
    """Rows of (node, ts, value) whose z among the last ``window`` of their node, itself included, is beyond ``threshold``."""
    w = Window.partitionBy("node").orderBy("ts").rowsBetween(-(window - 1), 0)
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w))
    return series.withColumns({"z": z, "seen": F.count("value").over(w)}).where((F.col("seen") >= least) & (F.abs("z") > threshold))


def confidence_stats(edges: DataFrame) -> DataFrame:
    """n, mean, least, low and upper quarter of confidence (the value at the place of a quarter, from below), by relation. Places go by ranges of the values: no relation is gathered."""
    each = edges.where("confidence is not null").groupBy("rel_type", "confidence").agg(F.count("*").alias("c"))
    sizes = each.groupBy("rel_type").agg(F.sum("c").alias("n"), (F.sum(F.col("confidence") * F.col("c")) / F.sum("c")).alias("mean"), F.min("confidence").alias("min"))
    placed = running(each, "confidence", "c", ["rel_type"]).join(sizes, "rel_type")
    at = lambda share: F.max(F.when((F.col("before") <= F.floor(F.col("n") * share)) & (F.floor(F.col("n") * share) < F.col("before") + F.col("c")), F.col("confidence")))
    return placed.groupBy("rel_type").agg(F.first("n").cast("int").alias("n"), F.first("mean").alias("mean"), F.first("min").alias("min"), at(0.25).alias("p25"), at(0.75).alias("p75"))


def discovery_edges(found: DataFrame, causal: float = 0.05, places: int | None = 4) -> DataFrame:
    """Edges (src, dst, rel_type, pearson_r, lag, granger_p, confidence) of discoveries (a, b, relationship_type, ...).

    ``*_sensitive``: a is sensitive to b. All others: a correlation in alphabetical order and, below the causal limit, a cause from a to b.
    """
    sensitive = F.col("relationship_type").endswith("_sensitive")
    one = lambda kind, src, dst: F.struct(F.lit(kind).alias("rel_type"), src.alias("src"), dst.alias("dst"))
    correlated = one("CORRELATED_WITH", F.least("a", "b"), F.greatest("a", "b"))
    made = F.when(sensitive, F.array(one("SENSITIVE_TO", F.col("a"), F.col("b")))).when(F.col("granger_p") < causal, F.array(correlated, one("CAUSES", F.col("a"), F.col("b")))).otherwise(F.array(correlated))
    rows = found.withColumn("_e", F.explode(made)).select("*", "_e.*").drop("_e", "a", "b")
    return rows.withColumn("confidence", edge_confidence(places=places))


#: Rank of each strength in the ladder (fixed values).
LADDER = {"weak": 1, "moderate": 2, "strong": 3}


def materialised(found: DataFrame, least: str = "moderate", least_r: float = 0.0, limit: int = 2000, places: int | None = 4) -> DataFrame:
    """Edges of the strongest discoveries: at least ``least`` in the ladder and ``least_r``; ``limit`` is that of a run's report."""
    rung = reduce(lambda other, kv: F.when(F.col("strength") == kv[0], kv[1]).otherwise(other), LADDER.items(), F.lit(0))
    kept = found.where((rung >= LADDER[least]) & (F.abs("pearson_r") >= least_r)).orderBy(F.desc(F.abs("pearson_r")), "a", "b").limit(limit)
    return discovery_edges(kept, places=places)


def hidden(pairs: DataFrame, known: DataFrame | None, least: float = 0.85, top: int | None = 100) -> DataFrame:
    """Similar pairs (a, b, kind_a, kind_b, cosine): whether an edge (src, dst) is known, a type and a strength; unknown ones first. ``top`` limits what is reported; None: all. Without a table of edges the pairs have ``known`` themselves."""
    kind = lambda k: (F.col("kind_a") == k) | (F.col("kind_b") == k)
    done = pairs.where(F.col("cosine") >= least)
    if known is not None:
        ends = known.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("_k", F.lit(True))
        done = done.join(ends, ["a", "b"], "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")
    done = done.orderBy("known", F.desc("cosine"), "a", "b")
    done = done.limit(top) if top else done
    return done.withColumns({"suggested": F.when(kind("macro"), "macro_impact").when(kind("sector"), "sector_membership").otherwise("hidden_correlation"), "strength": F.when(F.col("cosine") > 0.95, "very_strong").when(F.col("cosine") > 0.90, "strong").otherwise("moderate")})


def source_of(series: str, prices: tuple[str, ...], macros: tuple[str, ...]) -> Column:
    """Which source feeds a series: by the tables of known ones, else market data where a sign of its symbols occurs."""
    x = F.col(series)
    return F.when(x.isin(*prices), "market").when(x.isin(*macros), "macro").when(x.rlike(r"[-=.^]"), "market (inferred)").otherwise("unknown")


def insights(divergences: DataFrame, sectors: DataFrame, odd: DataFrame, bridges: DataFrame) -> DataFrame:
    """(priority, kind, subject, text): what to look at, by priority, then kind and subject."""
    row = lambda p, kind, subject, text: [p.cast("int").alias("priority"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), text.alias("text")]
    parts = [
        odd.select(*row(F.when(F.col("severity") == "critical", 1).otherwise(2), "anomaly", F.col("metric"), F.format_string("%s shows a %s of %.2f deviations", "metric", "direction", "z"))),
        sectors.where("stress >= 0.5").select(*row(F.when(F.col("stress") >= 0.75, 1).otherwise(2), "sector_stress", F.col("sector"), F.format_string("%s is under stress (%.2f) over %d members", "sector", "stress", "members"))),
        divergences.where("abs_change >= 0.1").select(*row(F.when(F.col("direction") == "amplified", 2).otherwise(3), "regime_divergence", F.concat_ws("/", "asset", "factor", "regime"), F.format_string("%s to %s is %s by %.3f in %s", "asset", "factor", "direction", "abs_change", "regime"))),
        bridges.where("n_classes >= 2").select(*row(F.lit(3), "bridge", F.col("factor"), F.format_string("%s links %d classes", "factor", "n_classes"))),
    ]
    return reduce(lambda a, b: a.unionAll(b), parts).orderBy("priority", "kind", "subject")


def health(values: DataFrame) -> DataFrame:
    """health (0..100: mean of capped components) and grade of metrics (metric, value)."""
    m = values.agg(*(F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in ("regime_divergence_mean", "sector_stress_mean", "bridge_count", "centrality_mean_degree")))
    part = lambda c, full: unit(F.coalesce(F.col(c), F.lit(0.0)) / full)
    score = 100 * ((1 - part("regime_divergence_mean", 0.3)) + (1 - part("sector_stress_mean", 1.0)) + part("bridge_count", 5.0) + part("centrality_mean_degree", 5.0)) / 4
    return m.select(score.alias("health")).withColumn("grade", F.when(F.col("health") >= 80, "A").when(F.col("health") >= 65, "B").when(F.col("health") >= 50, "C").when(F.col("health") >= 35, "D").otherwise("F"))


def tensors(edges: DataFrame, nodes: DataFrame, kinds: dict[str, int], least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes with an index from 0 by id, edges as indices with the number of their type and weight).

    The weight is the confidence, else |r|, else 0.5. Indices are running counts over ranges of ids: no task holds all nodes.
    """
    parts = nodes.select("node").distinct().withColumn("part", F.substring(F.sha2("node", 256), 1, 3))
    before = parts.groupBy("part").agg(F.count("*").alias("own")).select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))  # at most 4096 rows
    index = parts.join(F.broadcast(before), "part").select("node", (F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1 + F.col("before")).alias("index"))
    number = reduce(lambda other, kv: F.when(F.col("rel_type") == kv[0], kv[1]).otherwise(other), kinds.items(), F.lit(0))
    weight = F.coalesce("confidence", F.abs("pearson_r"), F.lit(0.5))
    made = edges.withColumns({"type": number, "weight": weight}).where(F.col("weight") >= least)
    made = made.join(index.select(F.col("node").alias("src"), F.col("index").alias("i")), "src").join(index.select(F.col("node").alias("dst"), F.col("index").alias("j")), "dst")
    return index, made.select("src", "dst", "i", "j", "type", "weight")
