"""What an analysis of the factor graph comes to: summary metrics, ranked insights, conclusions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import decayed, staleness
from tidemark.operators.scores import unit


class Analysis(NamedTuple):
    """similar (a, b, cosine, shared), divergences (of ``intelligence.divergence``), bridges (factor, n_classes, n_assets, n_edges, classes), ranking (node, degree), sectors (of ``intelligence.sector_stress``),
    events (asset, event_date, degree, divergence, bridges, importance, upcoming, has_actuals, surprise_pct)."""

    similar: DataFrame
    divergences: DataFrame
    bridges: DataFrame
    ranking: DataFrame
    sectors: DataFrame
    events: DataFrame


#: Classes from which a factor is a bridge, and a systemic one; importance of an event of high impact.
BRIDGE, SYSTEMIC, HIGH_IMPACT = 2, 3, 0.5


def bridges(links: DataFrame) -> DataFrame:
    """(factor, n_classes, n_assets, n_edges, classes: sorted) of links (asset, factor, class); a null class is none."""
    return links.groupBy("factor").agg(F.count_distinct("class").alias("n_classes"), F.count_distinct("asset").alias("n_assets"), F.count("*").alias("n_edges"), F.array_sort(F.collect_set("class")).alias("classes"))


def evidence_stats(edges: DataFrame) -> DataFrame:
    """One row of edges (confidence, age_days, evidence, rel_type): scored, mean_confidence, mean_effective (after decay), low (effective below 0.4), reconfirmed, mean_evidence, stale, expired."""
    step = edges.where("confidence is not null").withColumns({"_e": decayed("confidence", "age_days", "evidence", "rel_type"), "_s": staleness("age_days", "evidence")})
    return step.agg(
        F.count("*").alias("scored"), F.avg("confidence").alias("mean_confidence"), F.avg("_e").alias("mean_effective"), F.count_if(F.col("_e") < 0.4).alias("low"), F.count_if(F.col("evidence") > 1).alias("reconfirmed"),
        F.avg("evidence").alias("mean_evidence"), F.count_if(F.col("_s") == "stale").alias("stale"), F.count_if(F.col("_s") == "expired").alias("expired"),
    )


def _first(value: Column, order: list[Column]) -> Column:
    return F.min_by(value, F.struct(*order))


def summary_metrics(found: Analysis) -> DataFrame:
    """(metric, value, name): the 26 measures that are followed from one analysis to the next; a measure is a number or a name (the ids of bridges with commas). One aggregate of each table."""
    is_bridge = F.col("n_classes") >= BRIDGE
    number = lambda x: F.struct(x.cast("double").alias("value"), F.lit(None).cast("string").alias("name"))
    name = lambda x: F.struct(F.lit(None).cast("double").alias("value"), x.cast("string").alias("name"))
    profiles = found.similar.select(F.explode(F.array("a", "b")).alias("asset")).agg(F.count_distinct("asset").alias("n"))
    parts = [
        (profiles, {"exposure_asset_count": number(F.max("n"))}),
        (found.divergences, {"exposure_factor_count": number(F.count_distinct("factor")), "regime_pairs_analyzed": number(F.count_distinct("asset", "factor")), "regime_divergence_count": number(F.count("*")), "regime_divergence_mean": number(F.avg("abs_change")), "regime_divergence_max": number(F.max("abs_change")), "regime_amplified_pct": number(F.avg((F.col("direction") == "amplified").cast("int"))), "regime_top_shift": name(_first(F.concat_ws("/", "asset", "factor", "regime"), [-F.round("abs_change", 9), F.col("asset"), F.col("factor"), F.col("regime")]))}),
        (found.similar, {"exposure_pair_count": number(F.count("*")), "exposure_sim_mean": number(F.avg("cosine")), "exposure_sim_max": number(F.max("cosine")), "exposure_top_pair": name(_first(F.concat_ws("/", "a", "b"), [-F.round("cosine", 9), F.col("a"), F.col("b")]))}),
        (found.bridges, {"bridge_total_factors": number(F.count("*")), "bridge_count": number(F.count_if(is_bridge)), "bridge_max_span": number(F.coalesce(F.max(F.when(is_bridge, F.col("n_classes"))), F.lit(0))), "bridge_factor_ids": name(F.array_join(F.array_sort(F.collect_list(F.when(is_bridge, F.col("factor")))), ","))}),
        (found.ranking, {"centrality_top_node": name(_first(F.col("node"), [-F.col("degree"), F.col("node")])), "centrality_top_degree": number(F.coalesce(F.max("degree"), F.lit(0))), "centrality_mean_degree": number(F.avg("degree"))}),
        (found.sectors, {"sector_count": number(F.count("*")), "sector_stress_max": number(F.max("stress")), "sector_stress_mean": number(F.avg("stress")), "sector_most_stressed": name(_first(F.col("sector"), [-F.round("stress", 9), F.col("sector")]))}),
        (found.events, {"earnings_upcoming": number(F.count_if("upcoming")), "earnings_recent_actuals": number(F.count_if(~F.col("upcoming") & F.col("has_actuals"))), "earnings_high_impact": number(F.count_if(F.col("importance") >= HIGH_IMPACT))}),
    ]
    rows = [df.agg(F.array(*(F.struct(F.lit(n).alias("metric"), x.alias("v")) for n, x in named.items())).alias("m")).select(F.inline("m")).select("metric", "v.*") for df, named in parts]
    return reduce(DataFrame.unionAll, rows)


def metric_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(metric, before, now, change, changed) of two ``summary_metrics``: numbers with their difference, names with whether they are others; a list of ids as those gained (+) and lost (-)."""
    both = before.select("metric", F.col("value").alias("before"), F.col("name").alias("_b")).join(now.select("metric", F.col("value").alias("now"), F.col("name").alias("_n")), "metric", "full")
    ids = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    marked = lambda a, b, sign: F.transform(F.array_except(ids(a), ids(b)), lambda x: F.concat(F.lit(sign), x))
    other = F.when(F.col("metric") == "bridge_factor_ids", F.array_join(F.concat(marked("_n", "_b", "+"), marked("_b", "_n", "-")), ",")).when(~F.col("_n").eqNullSafe(F.col("_b")), F.concat(F.coalesce("_b", F.lit("-")), F.lit(" -> "), F.coalesce("_n", F.lit("-"))))
    return both.select("metric", "before", "now", (F.col("now") - F.col("before")).alias("change"), F.nullif(other, F.lit("")).alias("changed"))


def _percent(x: Column) -> Column:
    return F.concat(F.format_string("%.0f", x * 100), F.lit("%"))


def insights(found: Analysis, before: Analysis | None = None, odd: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(priority, kind, subject, text) of sixteen kinds, 1 the most urgent.

    Lists are reports: the three largest shifts of a regime, the two most similar pairs, the two largest new shifts, the three most
    stressed sectors, the most important event ahead, the two largest surprises behind.
    """
    out: list[DataFrame] = []

    def add(rows: DataFrame, kind: str | Column, priority: int | Column, subject: str | Column, text: Column) -> None:
        value = lambda x: F.lit(x) if isinstance(x, int) else x
        out.append(rows.select(value(priority).cast("int").alias("priority"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), text.alias("text")))

    shift = F.concat_ws("/", "asset", "factor", "regime")
    widest = [F.desc(F.round("abs_change", 9)), "asset", "factor", "regime"]
    add(found.divergences.orderBy(*widest).limit(3), "crisis_exposure", F.when(F.col("abs_change") >= 0.25, 1).otherwise(2), shift, F.format_string("%s: beta %.3f, in all %.3f", "direction", "beta_regime", "beta_all"))
    spans = F.array_join("classes", ", ")
    of = found.bridges.where(F.col("n_classes") >= BRIDGE)
    add(of, F.when(F.col("n_classes") >= SYSTEMIC, "systemic_bridge").otherwise("bridge_factor"), F.when(F.col("n_classes") >= SYSTEMIC, 1).otherwise(3), "factor", F.format_string("%d assets, %d edges: %s", "n_assets", "n_edges", spans))
    twins = found.similar.orderBy(F.desc(F.round("cosine", 9)), "a", "b").limit(2).where("cosine >= 0.9")
    add(twins, "structural_twin", 2, F.concat_ws("/", "a", "b"), F.format_string("cosine %.2f over %d factors", "cosine", "shared"))
    if before is not None:
        new = found.divergences.join(before.divergences.select("asset", "factor", "regime"), ["asset", "factor", "regime"], "left_anti").orderBy(*widest).limit(2)
        add(new, "new_regime_exposure", 1, shift, F.format_string("%s: beta %.3f, a shift of %.3f", "direction", "beta_regime", "abs_change"))
        were = before.bridges.where(F.col("n_classes") >= BRIDGE)
        add(of.join(were.select("factor"), "factor", "left_anti"), "new_bridge", 1, "factor", F.format_string("%d assets: %s", "n_assets", spans))
        add(were.join(of.select("factor"), "factor", "left_anti"), "lost_bridge", 2, "factor", F.format_string("was %d assets: %s", "n_assets", spans))
    if odd is not None:
        add(odd, "structural_anomaly", F.when(F.col("severity") == "critical", 1).otherwise(2), "metric", F.format_string("%s of %+.1f deviations, %s", "direction", "z", "severity"))
    if stats is not None:
        share = lambda c: F.col(c) / F.col("scored")
        thin = F.col("mean_effective") < 0.45
        some = stats.where("scored > 0")
        add(some.where(thin), "weak_evidence_base", 2, F.lit("graph"), F.format_string("effective confidence %.2f; %d of %d edges below 0.4", "mean_effective", "low", "scored"))
        add(some.where(~thin & (share("low") > 0.30)), "many_weak_edges", 3, F.lit("graph"), F.concat(_percent(share("low")), F.format_string(" of %d edges are weak; effective confidence %.2f", "scored", "mean_effective")))
        add(some.where(share("reconfirmed") > 0.5), "strong_reconfirmation", 3, F.lit("graph"), F.concat(_percent(share("reconfirmed")), F.format_string(" of %d edges were seen again, %.1f times in the mean", "scored", "mean_evidence")))
        add(some.where(share("expired") > 0.10), "expired_edges", 2, F.lit("graph"), F.concat(_percent(share("expired")), F.format_string(" of %d edges have expired", "scored")))
        add(some.where(share("stale") > 0.25), "stale_edges", 3, F.lit("graph"), F.concat(_percent(share("stale")), F.format_string(" of %d edges are stale", "scored")))
    tense = found.sectors.orderBy(F.desc(F.round("stress", 9)), "sector").limit(3).where("stress >= 0.35")
    high = F.col("stress") >= 0.60
    add(tense, "sector_stress", F.when(high, 1).otherwise(2), "sector", F.concat(F.format_string("%.2f over %d members, ", "stress", "members"), _percent(F.col("breadth")), F.lit(" of them"), F.when(high, F.concat(F.lit(", most "), F.coalesce("most_divergent", F.lit("none")))).otherwise("")))
    ahead = found.events.where("upcoming and importance >= 0.4")
    top = ahead.orderBy(F.desc(F.round("importance", 9)), "event_date", "asset").limit(1).crossJoin(F.broadcast(ahead.agg(F.count("*").alias("_n"))))  # one row each
    add(top, "earnings_catalyst", F.when(F.col("importance") >= 0.6, 1).otherwise(2), "asset", F.format_string("on %s, importance %.2f, degree %d; %d such events", F.col("event_date").cast("string"), "importance", F.col("degree").cast("int"), "_n"))
    behind = found.events.where("not upcoming and has_actuals and abs(surprise_pct) >= 5 and importance >= 0.3").orderBy(F.desc(F.round("importance", 9)), "event_date", "asset", "surprise_pct").limit(2)
    add(behind, "earnings_surprise", 2, "asset", F.format_string("%s of %+.1f percent, degree %d", F.when(F.col("surprise_pct") > 0, "beat").otherwise("miss"), "surprise_pct", F.col("degree").cast("int")))
    return reduce(DataFrame.unionAll, out).orderBy("priority", "kind", "subject")


def conclusions(found: Analysis, stats: DataFrame | None = None) -> DataFrame:
    """(question, subject, value, text): the most influential factor, the most stressed sector, the most exposed asset, the health of the structure with its components, and the dominant pattern.

    Health is the mean of the components that there are, each from 0 to 1: confidence (of 0.7), reconfirmation (of a half of the
    edges), freshness, coverage (of 50 nodes) and diversity of bridges (of 5).
    """
    of = found.bridges.where(F.col("n_classes") >= BRIDGE)
    row = lambda rows, question, subject, value, text: rows.select(F.lit(question).alias("question"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), text.alias("text"))
    factor = of.orderBy(F.desc("n_classes"), F.desc("n_assets"), "factor").limit(1)
    sector = found.sectors.orderBy(F.desc(F.round("stress", 9)), "sector").limit(1)
    exposed = found.divergences.groupBy("asset").agg(F.sum("abs_change").alias("total"), F.count("*").alias("n")).orderBy(F.desc(F.round("total", 9)), "asset").limit(1)
    alike = found.similar.where("cosine >= 0.85").agg(F.count("*").alias("n"), _first(F.concat_ws(" and ", "a", "b"), [-F.round("cosine", 9), F.col("a"), F.col("b")]).alias("top"), F.max("cosine").alias("cosine"))
    shaken = found.divergences.agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "amplified").alias("up"))
    pattern = alike.crossJoin(shaken.select(F.col("n").alias("m"), "up"))  # one row each
    convergent, amplified = F.col("n") > 0, F.col("up") * 2 > F.col("m")
    kind = F.when(convergent, "convergence").when(amplified, "amplification").when(F.col("m") > 0, "dampening").otherwise("none")
    told = F.when(convergent, F.format_string("%d pairs from 0.85 on, first %s at %.2f", "n", "top", "cosine")).otherwise(F.format_string("%d of %d shifts are amplified", "up", "m"))
    parts = [
        row(factor, "most_influential_factor", F.col("factor"), F.col("n_classes"), F.format_string("links %d assets of %d classes", "n_assets", "n_classes")),
        row(sector, "most_stressed_sector", F.col("sector"), F.col("stress"), F.concat(_percent(F.col("breadth")), F.format_string(" of %d members shift", "members"), F.coalesce(F.concat(F.lit(", first "), "most_divergent"), F.lit("")))),
        row(exposed, "most_exposed_asset", F.col("asset"), F.col("total"), F.format_string("%d shifts", "n")),
        row(pattern, "dominant_pattern", kind, F.when(convergent, F.col("n")).when(amplified, F.col("up")).otherwise(F.col("m") - F.col("up")), told),
    ]
    nodes = found.ranking.agg(F.when(F.count("*") > 0, unit(F.count("*") / 50)).alias("coverage"))
    wide = nodes.crossJoin(of.agg(F.when(F.count("*") > 0, unit(F.count("*") / 5)).alias("bridge_diversity")))  # one row each
    names = ["coverage", "bridge_diversity"]
    if stats is not None:
        some = F.when(F.col("scored") > 0, F.lit(1.0))
        wide = wide.crossJoin(stats.select((some * unit(F.col("mean_confidence") / 0.7)).alias("confidence"), (some * unit(F.col("reconfirmed") / F.col("scored") / 0.5)).alias("reconfirmation"), (some * unit(1 - (F.col("stale") + F.col("expired")) / F.col("scored"))).alias("freshness")))
        names = ["confidence", "reconfirmation", "freshness", *names]
    known = F.filter(F.array(*names), lambda x: x.isNotNull())
    health = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    grade = F.when(health >= 0.8, "excellent").when(health >= 0.6, "good").when(health >= 0.4, "fair").otherwise("poor")
    listed = F.concat_ws(", ", *(F.concat(F.lit(f"{n} "), _percent(F.col(n))) for n in names))
    parts.append(row(wide.where(F.size(known) > 0), "structural_health", grade, health, listed))
    return reduce(DataFrame.unionAll, parts)
