"""Queries of a whole analysis of the factor graph: its metrics, what has changed, insights and conclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph, intelligence, reasoning
from tidemark.plans.listing import MONTHLY
from tidemark.plans.listing import anomalies as odd_months
from tidemark.plans.market import rounded
from tidemark.plans.sql import picked
from tidemark.sources.tables import table

#: The analysis before is that of the lines shipped until this day; events are those around the second.
BEFORE, TODAY, AS_OF = "1996-12-31", "1996-06-15", "1998-08-02"


def analysis(spark: SparkSession, sf_dir: str, until: str | None = None) -> reasoning.Analysis:
    """Brands as assets, return flags as factors, line statuses as regimes, parts' types as classes and sectors."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= until if until else F.lit(True))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"), F.split("p_type", " ")[0].alias("class"))
    joined = lines.join(parts, "l_partkey").withColumnRenamed("l_returnflag", "factor")
    beta = (F.avg("l_discount") * 10 + F.avg("l_tax") * 5 - 0.6).alias("beta")
    betas = joined.groupBy("asset", "factor", F.when(F.col("l_linestatus") == "O", "bear").otherwise("stress").alias("regime")).agg(beta)
    betas = betas.unionAll(joined.groupBy("asset", "factor").agg(beta).select("asset", "factor", F.lit("all").alias("regime"), "beta"))
    divergences = intelligence.divergence(betas)
    profile = betas.where("regime = 'all'").select(F.col("asset").alias("node"), "factor", "beta")
    similar = graph.profile_similarity(profile).withColumnsRenamed({"node_a": "a", "node_b": "b"})
    links = joined.where("l_discount >= 0.09 and l_tax >= 0.07").select("asset", "factor", "class").distinct()
    ranking = links.select(F.explode(F.array("asset", "factor")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    exposure = intelligence.exposure(divergences, links.select("asset", "factor"))
    members = parts.select("asset", F.substring("asset", 1, 7).alias("sector")).distinct()
    due = joined.groupBy("asset", F.to_date("l_shipdate").alias("event_date")).agg(((F.avg("l_tax") - F.avg("l_discount")) * 200).alias("surprise_pct"), F.bool_or(F.col("factor") != "N").alias("has_actuals"))
    events = intelligence.importance(due, ranking.withColumnRenamed("node", "asset"), exposure, TODAY)
    return reasoning.Analysis(similar, divergences, reasoning.bridges(links), ranking, intelligence.sector_stress(members, exposure), events)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers' nations to order priorities with confidence, evidence and age."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    edges = orders.groupBy("c_nationkey", "o_orderpriority", "o_orderstatus").agg((F.avg("o_totalprice") / 300000).alias("confidence"), F.count("*").alias("evidence"), F.datediff(F.lit(AS_OF), F.max(F.to_date("o_orderdate"))).alias("age_days"))
    return reasoning.evidence_stats(edges.withColumn("rel_type", F.when(F.col("o_orderstatus") == "F", "CORRELATED_WITH").when(F.col("o_orderstatus") == "O", "CAUSES").otherwise("OTHER")))


def _parts(name: str, until: str | None) -> dict[str, str]:
    """The tables of an analysis as named parts of a query."""
    when = f"WHERE l_shipdate <= TIMESTAMP '{until}'" if until else ""
    n = name
    return {
        f"{n}_j": f"SELECT l.*, l_returnflag AS factor, p_brand AS asset, split_part(p_type, ' ', 1) AS class FROM lineitem l JOIN part ON p_partkey = l_partkey {when}",
        f"{n}_b": f"SELECT asset, factor, CASE l_linestatus WHEN 'O' THEN 'bear' ELSE 'stress' END AS regime, avg(l_discount) * 10 + avg(l_tax) * 5 - 0.6 AS beta FROM {n}_j GROUP BY 1, 2, 3 UNION ALL SELECT asset, factor, 'all', avg(l_discount) * 10 + avg(l_tax) * 5 - 0.6 FROM {n}_j GROUP BY 1, 2",
        f"{n}_d": f"SELECT r.asset, r.factor, r.regime, b.beta AS beta_all, r.beta AS beta_regime, abs(r.beta - b.beta) AS abs_change, CASE WHEN abs(r.beta) > abs(b.beta) THEN 'amplified' ELSE 'dampened' END AS direction FROM {n}_b r JOIN {n}_b b ON r.asset = b.asset AND r.factor = b.factor AND r.regime <> 'all' AND b.regime = 'all'",
        f"{n}_s": f"SELECT a, b, dot / (na * nb) AS cosine, shared FROM (SELECT x.asset AS a, y.asset AS b, sum(x.beta * y.beta) AS dot, count(*) AS shared FROM {n}_b x JOIN {n}_b y ON x.factor = y.factor AND x.asset < y.asset AND x.regime = 'all' AND y.regime = 'all' AND x.beta <> 0 AND y.beta <> 0 GROUP BY 1, 2) JOIN (SELECT asset AS a, sqrt(sum(beta * beta)) AS na FROM {n}_b WHERE regime = 'all' GROUP BY 1) USING (a) JOIN (SELECT asset AS b, sqrt(sum(beta * beta)) AS nb FROM {n}_b WHERE regime = 'all' GROUP BY 1) USING (b)",
        f"{n}_l": f"SELECT DISTINCT asset, factor, class FROM {n}_j WHERE l_discount >= 0.09 AND l_tax >= 0.07",
        f"{n}_f": f"SELECT factor, count(DISTINCT class) AS n_classes, count(DISTINCT asset) AS n_assets, count(*) AS n_edges, array_to_string(list_sort(list(DISTINCT class)), ', ') AS classes FROM {n}_l GROUP BY 1",
        f"{n}_r": f"SELECT node, count(*) AS degree FROM (SELECT unnest([asset, factor]) AS node FROM {n}_l) GROUP BY 1",
        f"{n}_x": f"SELECT asset, coalesce(divergence, 0) AS divergence, coalesce(bridges, 0) AS bridges FROM (SELECT asset, sum(abs_change) AS divergence FROM {n}_d GROUP BY 1) FULL JOIN (SELECT asset, count(DISTINCT factor) AS bridges FROM {n}_l GROUP BY 1) USING (asset)",
        f"{n}_t": f"SELECT sector, count(*) AS members, CASE WHEN max(d) > 0 THEN arg_min(asset, (-d, asset)) END AS most_divergent, avg(CAST(d > 0 AS INT)) AS breadth, 0.5 * least(avg(d) / 0.3, 1) + 0.25 * least(avg(b) / 3, 1) + 0.25 * avg(CAST(d > 0 AS INT)) AS stress FROM (SELECT m.asset, sector, coalesce(divergence, 0) AS d, coalesce(bridges, 0) AS b FROM (SELECT DISTINCT p_brand AS asset, p_brand[1:7] AS sector FROM part) m LEFT JOIN {n}_x USING (asset)) GROUP BY 1",
        f"{n}_e": f"SELECT e.*, coalesce(degree, 0) AS degree, event_date >= DATE '{TODAY}' AS upcoming, 0.4 * least(coalesce(degree, 0) / 10, 1) + 0.35 * least(coalesce(divergence, 0) / 0.3, 1) + 0.25 * least(coalesce(bridges, 0) / 3, 1) AS importance FROM (SELECT asset, CAST(l_shipdate AS DATE) AS event_date, (avg(l_tax) - avg(l_discount)) * 200 AS surprise_pct, bool_or(factor <> 'N') AS has_actuals FROM {n}_j GROUP BY 1, 2) e LEFT JOIN {n}_r ON node = asset LEFT JOIN {n}_x USING (asset) WHERE event_date BETWEEN DATE '{TODAY}' - 7 AND DATE '{TODAY}' + 14",
    }


def _with(parts: dict[str, str]) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts.items())


def _metrics_sql(n: str) -> str:
    rows = {
        "exposure_asset_count": (f"SELECT count(DISTINCT x) FROM (SELECT unnest([a, b]) AS x FROM {n}_s)", None), "exposure_factor_count": (f"SELECT count(DISTINCT factor) FROM {n}_d", None), "regime_pairs_analyzed": (f"SELECT count(DISTINCT (asset, factor)) FROM {n}_d", None),
        "regime_divergence_count": (f"SELECT count(*) FROM {n}_d", None), "regime_divergence_mean": (f"SELECT avg(abs_change) FROM {n}_d", None), "regime_divergence_max": (f"SELECT max(abs_change) FROM {n}_d", None), "regime_amplified_pct": (f"SELECT avg(CAST(direction = 'amplified' AS INT)) FROM {n}_d", None),
        "regime_top_shift": (None, f"SELECT asset || '/' || factor || '/' || regime FROM {n}_d ORDER BY round(abs_change, 9) DESC, asset, factor, regime LIMIT 1"), "exposure_pair_count": (f"SELECT count(*) FROM {n}_s", None), "exposure_sim_mean": (f"SELECT avg(cosine) FROM {n}_s", None), "exposure_sim_max": (f"SELECT max(cosine) FROM {n}_s", None),
        "exposure_top_pair": (None, f"SELECT a || '/' || b FROM {n}_s ORDER BY round(cosine, 9) DESC, a, b LIMIT 1"), "bridge_total_factors": (f"SELECT count(*) FROM {n}_f", None), "bridge_count": (f"SELECT count(*) FROM {n}_f WHERE n_classes >= 2", None), "bridge_max_span": (f"SELECT coalesce(max(n_classes), 0) FROM {n}_f WHERE n_classes >= 2", None),
        "bridge_factor_ids": (None, f"SELECT coalesce(string_agg(factor, ',' ORDER BY factor), '') FROM {n}_f WHERE n_classes >= 2"), "centrality_top_node": (None, f"SELECT node FROM {n}_r ORDER BY degree DESC, node LIMIT 1"), "centrality_top_degree": (f"SELECT coalesce(max(degree), 0) FROM {n}_r", None), "centrality_mean_degree": (f"SELECT avg(degree) FROM {n}_r", None),
        "sector_count": (f"SELECT count(*) FROM {n}_t", None), "sector_stress_max": (f"SELECT max(stress) FROM {n}_t", None), "sector_stress_mean": (f"SELECT avg(stress) FROM {n}_t", None), "sector_most_stressed": (None, f"SELECT sector FROM {n}_t ORDER BY round(stress, 9) DESC, sector LIMIT 1"),
        "earnings_upcoming": (f"SELECT count(*) FROM {n}_e WHERE upcoming", None), "earnings_recent_actuals": (f"SELECT count(*) FROM {n}_e WHERE NOT upcoming AND has_actuals", None), "earnings_high_impact": (f"SELECT count(*) FROM {n}_e WHERE importance >= 0.5", None),
    }
    cell = lambda q, kind: f"CAST(({q}) AS {kind})" if q else f"CAST(NULL AS {kind})"
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {cell(v, 'DOUBLE')} AS value, {cell(name, 'VARCHAR')} AS name" for m, (v, name) in rows.items())


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reasoning.summary_metrics(analysis(spark, sf_dir)), ["metric", "name"], ["value"])


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = (reasoning.summary_metrics(analysis(spark, sf_dir, until)) for until in (BEFORE, None))
    return rounded(reasoning.metric_changes(before, now), ["metric", "changed"], ["before", "now", "change"])


def _changes_sql() -> str:
    ids = "array_to_string(list_concat(list_transform(list_sort(list_filter(string_split(b.name, ','), lambda x: x <> '' AND NOT list_contains(string_split(a.name, ','), x))), lambda x: '+' || x), list_transform(list_sort(list_filter(string_split(a.name, ','), lambda x: x <> '' AND NOT list_contains(string_split(b.name, ','), x))), lambda x: '-' || x)), ',')"
    changed = f"nullif(CASE WHEN metric = 'bridge_factor_ids' THEN {ids} WHEN a.name IS DISTINCT FROM b.name THEN coalesce(a.name, '-') || ' -> ' || coalesce(b.name, '-') END, '')"
    return f"{_with(_parts('o', BEFORE) | _parts('c', None))} {picked(f'SELECT metric, {changed} AS changed, a.value AS before, b.value AS now, b.value - a.value AS change FROM ({_metrics_sql('o')}) a JOIN ({_metrics_sql('c')}) b USING (metric)', ['metric', 'changed'], ['before', 'now', 'change'])}"


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = odd_months(spark, sf_dir).withColumn("metric", F.concat_ws(" ", "metric", F.col("ts").cast("string")))
    return reasoning.insights(analysis(spark, sf_dir), analysis(spark, sf_dir, BEFORE), odd, evidence(spark, sf_dir))


LIFE = "CASE rel_type WHEN 'CORRELATED_WITH' THEN 60.0 WHEN 'CAUSES' THEN 45.0 ELSE 90.0 END * (1 + 0.2 * greatest(evidence - 1, 0))"
EDGES = f"SELECT *, CASE WHEN age_days <= 0 THEN confidence ELSE greatest(confidence * pow(0.5, age_days / ({LIFE})), confidence * 0.1) END AS raw, least(evidence - 1, 5) * 7 AS more FROM (SELECT c_nationkey, o_orderpriority, o_orderstatus, avg(o_totalprice) / 300000 AS confidence, count(*) AS evidence, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{AS_OF}') AS age_days, CASE o_orderstatus WHEN 'F' THEN 'CORRELATED_WITH' WHEN 'O' THEN 'CAUSES' ELSE 'OTHER' END AS rel_type FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"
STATS = f"SELECT count(*) AS scored, avg(confidence) AS mean_confidence, avg(e) AS mean_effective, count(*) FILTER (WHERE e < 0.4) AS low, count(*) FILTER (WHERE evidence > 1) AS reconfirmed, avg(evidence) AS mean_evidence, count(*) FILTER (WHERE age_days > 90 + more AND age_days <= 180 + more) AS stale, count(*) FILTER (WHERE age_days > 180 + more) AS expired FROM (SELECT *, least(greatest(raw, 0), 1) AS e FROM ({EDGES}))"


def _insights_sql() -> str:
    pct = lambda x: f"printf('%.0f', round(100 * ({x}))) || '%'"
    widest = "ORDER BY round(abs_change, 9) DESC, asset, factor, regime"
    shift = "asset || '/' || factor || '/' || regime"
    rows = [
        f"SELECT CASE WHEN abs_change >= 0.25 THEN 1 ELSE 2 END AS priority, 'crisis_exposure' AS kind, {shift} AS subject, printf('%s: beta %.3f, in all %.3f', direction, beta_regime, beta_all) AS text FROM (SELECT * FROM c_d {widest} LIMIT 3)",
        "SELECT CASE WHEN n_classes >= 3 THEN 1 ELSE 3 END, CASE WHEN n_classes >= 3 THEN 'systemic_bridge' ELSE 'bridge_factor' END, factor, printf('%d assets, %d edges: %s', n_assets, n_edges, classes) FROM c_f WHERE n_classes >= 2",
        "SELECT 2, 'structural_twin', a || '/' || b, printf('cosine %.2f over %d factors', cosine, shared) FROM (SELECT * FROM c_s ORDER BY round(cosine, 9) DESC, a, b LIMIT 2) WHERE cosine >= 0.9",
        f"SELECT 1, 'new_regime_exposure', {shift}, printf('%s: beta %.3f, a shift of %.3f', direction, beta_regime, abs_change) FROM (SELECT * FROM c_d ANTI JOIN o_d USING (asset, factor, regime) {widest} LIMIT 2)",
        "SELECT 1, 'new_bridge', factor, printf('%d assets: %s', n_assets, classes) FROM c_f WHERE n_classes >= 2 AND factor NOT IN (SELECT factor FROM o_f WHERE n_classes >= 2)",
        "SELECT 2, 'lost_bridge', factor, printf('was %d assets: %s', n_assets, classes) FROM o_f WHERE n_classes >= 2 AND factor NOT IN (SELECT factor FROM c_f WHERE n_classes >= 2)",
        "SELECT CASE WHEN abs(z) >= 3 THEN 1 ELSE 2 END, 'structural_anomaly', metric || ' ' || ts, printf('%s of %+.1f deviations, %s', CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END, z, CASE WHEN abs(z) >= 3 THEN 'critical' ELSE 'warning' END) FROM odd",
        "SELECT 2, 'weak_evidence_base', 'graph', printf('effective confidence %.2f; %d of %d edges below 0.4', mean_effective, low, scored) FROM st WHERE scored > 0 AND mean_effective < 0.45",
        f"SELECT 3, 'many_weak_edges', 'graph', {pct('low / scored')} || printf(' of %d edges are weak; effective confidence %.2f', scored, mean_effective) FROM st WHERE scored > 0 AND mean_effective >= 0.45 AND low / scored > 0.3",
        f"SELECT 3, 'strong_reconfirmation', 'graph', {pct('reconfirmed / scored')} || printf(' of %d edges were seen again, %.1f times in the mean', scored, mean_evidence) FROM st WHERE scored > 0 AND reconfirmed / scored > 0.5",
        f"SELECT 2, 'expired_edges', 'graph', {pct('expired / scored')} || printf(' of %d edges have expired', scored) FROM st WHERE scored > 0 AND expired / scored > 0.1",
        f"SELECT 3, 'stale_edges', 'graph', {pct('stale / scored')} || printf(' of %d edges are stale', scored) FROM st WHERE scored > 0 AND stale / scored > 0.25",
        f"SELECT CASE WHEN stress >= 0.6 THEN 1 ELSE 2 END, 'sector_stress', sector, printf('%.2f over %d members, ', stress, members) || {pct('breadth')} || ' of them' || CASE WHEN stress >= 0.6 THEN ', most ' || coalesce(most_divergent, 'none') ELSE '' END FROM (SELECT * FROM c_t ORDER BY round(stress, 9) DESC, sector LIMIT 3) WHERE stress >= 0.35",
        "SELECT CASE WHEN importance >= 0.6 THEN 1 ELSE 2 END, 'earnings_catalyst', asset, printf('on %s, importance %.2f, degree %d; %d such events', CAST(event_date AS VARCHAR), importance, degree, n) FROM (SELECT *, count(*) OVER () AS n FROM c_e WHERE upcoming AND importance >= 0.4 ORDER BY round(importance, 9) DESC, event_date, asset LIMIT 1)",
        "SELECT 2, 'earnings_surprise', asset, printf('%s of %+.1f percent, degree %d', CASE WHEN surprise_pct > 0 THEN 'beat' ELSE 'miss' END, surprise_pct, degree) FROM (SELECT * FROM c_e WHERE NOT upcoming AND has_actuals AND abs(surprise_pct) >= 5 AND importance >= 0.3 ORDER BY round(importance, 9) DESC, event_date, asset, surprise_pct LIMIT 2)",
    ]
    odd = f"SELECT metric, ts, round((value - mean) / std, 6) AS z FROM (SELECT * FROM ({MONTHLY}) WHERE ts >= DATE '1998-01-01') JOIN (SELECT metric, avg(value) AS mean, stddev_samp(value) AS std FROM ({MONTHLY}) WHERE ts < DATE '1998-01-01' GROUP BY 1 HAVING count(*) >= 3) USING (metric) WHERE abs((value - mean) / std) >= 1"
    return f"{_with(_parts('o', BEFORE) | _parts('c', None) | {'odd': odd, 'st': STATS})} SELECT CAST(priority AS INT) AS priority, kind, subject, text FROM ({' UNION ALL '.join(rows)})"


def conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reasoning.conclusions(analysis(spark, sf_dir), evidence(spark, sf_dir)), ["question", "subject", "text"], ["value"])


def _conclusions_sql() -> str:
    pct = lambda x: f"printf('%.0f', round(100 * ({x}))) || '%'"
    unit = lambda x: f"least(greatest({x}, 0), 1)"
    health = f"SELECT {unit('mean_confidence / 0.7')} AS k, {unit('reconfirmed / scored / 0.5')} AS r, {unit('1 - (stale + expired) / scored')} AS f, (SELECT {unit('count(*) / 50')} FROM c_r) AS c, (SELECT {unit('count(*) / 5')} FROM c_f WHERE n_classes >= 2) AS b FROM st"
    rows = [
        "SELECT 'most_influential_factor' AS question, factor AS subject, CAST(n_classes AS DOUBLE) AS value, printf('links %d assets of %d classes', n_assets, n_classes) AS text FROM (SELECT * FROM c_f WHERE n_classes >= 2 ORDER BY n_classes DESC, n_assets DESC, factor LIMIT 1)",
        f"SELECT 'most_stressed_sector', sector, stress, {pct('breadth')} || printf(' of %d members shift', members) || coalesce(', first ' || most_divergent, '') FROM (SELECT * FROM c_t ORDER BY round(stress, 9) DESC, sector LIMIT 1)",
        "SELECT 'most_exposed_asset', asset, total, printf('%d shifts', n) FROM (SELECT asset, sum(abs_change) AS total, count(*) AS n FROM c_d GROUP BY 1 ORDER BY round(sum(abs_change), 9) DESC, asset LIMIT 1)",
        "SELECT 'dominant_pattern', CASE WHEN n > 0 THEN 'convergence' WHEN up * 2 > m THEN 'amplification' WHEN m > 0 THEN 'dampening' ELSE 'none' END, CASE WHEN n > 0 THEN n WHEN up * 2 > m THEN up ELSE m - up END, CASE WHEN n > 0 THEN printf('%d pairs from 0.85 on, first %s at %.2f', n, top, cosine) ELSE printf('%d of %d shifts are amplified', up, m) END FROM (SELECT count(*) AS n, arg_min(a || ' and ' || b, (-round(cosine, 9), a, b)) AS top, max(cosine) AS cosine FROM c_s WHERE cosine >= 0.85), (SELECT count(*) AS m, count(*) FILTER (WHERE direction = 'amplified') AS up FROM c_d)",
        f"SELECT 'structural_health', CASE WHEN h >= 0.8 THEN 'excellent' WHEN h >= 0.6 THEN 'good' WHEN h >= 0.4 THEN 'fair' ELSE 'poor' END, h, 'confidence ' || {pct('k')} || ', reconfirmation ' || {pct('r')} || ', freshness ' || {pct('f')} || ', coverage ' || {pct('c')} || ', bridge_diversity ' || {pct('b')} FROM (SELECT *, (k + r + f + c + b) / 5 AS h FROM ({health}))",
    ]
    return f"{_with(_parts('c', None) | {'st': STATS})} {picked(' UNION ALL '.join(rows), ['question', 'subject', 'text'], ['value'])}"


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    return {
        "summary_metrics": (metrics, f"{_with(_parts('c', None))} {picked(_metrics_sql('c'), ['metric', 'name'], ['value'])}"),
        "metric_changes": (changes, _changes_sql()),
        "ranked_insights": (insights, _insights_sql()),
        "graph_conclusions": (conclusions, _conclusions_sql()),
        "evidence_stats": (lambda s, d: rounded(evidence(s, d), ["scored", "low", "reconfirmed", "stale", "expired"], ["mean_confidence", "mean_effective", "mean_evidence"]), picked(STATS, ["scored", "low", "reconfirmed", "stale", "expired"], ["mean_confidence", "mean_effective", "mean_evidence"])),
    }
