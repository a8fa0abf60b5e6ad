"""Queries over scores, validation suites, filters and the structure of the factor graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, filters, intelligence, scores, suite
from tidemark.plans.market import _features, _screener_sql, bars, rounded, screener
from tidemark.plans.sql import BARS, picked
from tidemark.sources import tables


def table(name: str):
    return lambda spark, sf_dir: tables.table(spark, sf_dir, name)


orders, suppliers, parts, customers, nations, lines, events = (table(n) for n in ("orders", "supplier", "part", "customer", "nation", "lineitem", "events"))

# discoveries: pairs of order priorities by status, with figures made of prices
DISCOVERIES = """SELECT o_orderpriority AS a, o_orderstatus AS b, 'run' || (o_custkey % 3) AS run_id, avg(o_totalprice) / 300000 AS pearson_r, CAST(o_custkey % 3 AS INT) AS lag, avg(o_totalprice) / 2010000 AS granger_p, count(*) / 1000.0 AS mutual_info,
 CASE WHEN avg(o_totalprice) >= 151000 THEN 'strong' WHEN avg(o_totalprice) >= 149000 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN o_orderstatus = 'P' THEN 'rate_sensitive' ELSE 'discovered' END AS relationship_type,
 avg(o_totalprice) / 200000 AS beta, CASE WHEN o_custkey % 3 = 0 THEN count(*) / 100.0 END AS t_stat, CASE WHEN o_custkey % 3 = 1 THEN 0.04 END AS p_value, CASE WHEN o_custkey % 3 = 2 THEN 0.0 ELSE 0.3 END AS r_squared FROM orders GROUP BY o_orderpriority, o_orderstatus, o_custkey % 3"""


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    made = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"), k.alias("k")).agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    return made.select("a", "b", F.concat(F.lit("run"), k.cast("string")).alias("run_id"), (m / 300000).alias("pearson_r"), k.cast("int").alias("lag"), (m / 2010000).alias("granger_p"), (n / 1000).alias("mutual_info"),
                       F.when(m >= 151000, "strong").when(m >= 149000, "moderate").otherwise("weak").alias("strength"), F.when(F.col("b") == "P", "rate_sensitive").otherwise("discovered").alias("relationship_type"),
                       (m / 200000).alias("beta"), F.when(k == 0, n / 100).alias("t_stat"), F.when(k == 1, 0.04).alias("p_value"), F.when(k == 2, 0.0).otherwise(0.3).alias("r_squared"))


FLOOR = "CASE strength WHEN 'strong' THEN 1.0 WHEN 'moderate' THEN 0.6 ELSE 0.3 END"
CONFIDENCE = f"""least(greatest(CASE rel_type WHEN 'SENSITIVE_TO' THEN coalesce(least(abs(t_stat) / 4, 1), greatest(1 - p_value / 0.1, 0), 0.4) * 0.35 + least(abs(beta), 1) * 0.25 + least(coalesce(nullif(r_squared, 0), 0.1), 1) * 0.2 + {FLOOR} * 0.2
 WHEN 'CAUSES' THEN greatest(1 - granger_p / 0.1, 0) * 0.45 + least(abs(pearson_r) / 0.8, 1) * 0.25 + least(mutual_info / 0.3, 1) * 0.15 + {FLOOR} * 0.15
 ELSE least(abs(pearson_r) / 0.8, 1) * 0.4 + greatest(1 - granger_p / 0.1, 0) * 0.3 + least(mutual_info / 0.3, 1) * 0.15 + {FLOOR} * 0.15 END, 0), 1)"""


def _edges_sql(source: str) -> str:
    return f"SELECT *, {CONFIDENCE} AS confidence FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, 'CORRELATED_WITH' AS rel_type, * FROM ({source}) WHERE relationship_type NOT LIKE '%_sensitive' UNION ALL SELECT a, b, 'CAUSES', * FROM ({source}) WHERE relationship_type NOT LIKE '%_sensitive' AND granger_p < 0.075 UNION ALL SELECT a, b, 'SENSITIVE_TO', * FROM ({source}) WHERE relationship_type LIKE '%_sensitive')"


# a registry of sources made of suppliers
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kinds = F.array(*(F.lit(x) for x in ("ohlcv", "yields", "inflation", "news")))
    return suppliers(spark, sf_dir).select(k.alias("id"), F.col("s_name").alias("name"), F.element_at(F.array(*(F.lit(x) for x in ("price", "macro", "social"))), (k % 3 + 1).cast("int")).alias("category"),
                                          F.element_at(F.array(*(F.lit(x) for x in ("active", "validated", "discovered", "rejected"))), (k % 4 + 1).cast("int")).alias("status"), F.slice(kinds, 1, (k % 4 + 1).cast("int")).alias("data_types"), F.slice(F.array(F.lit("equity"), F.lit("crypto"), F.lit("fx")), 1, (k % 3 + 1).cast("int")).alias("asset_types"),
                                          (k % 2 == 0).alias("official"), (k % 5 != 0).alias("free"), (k % 3 == 0).alias("auth"), F.when(k % 7 == 0, "unknown").otherwise("daily").alias("cadence"), (k % 5 + 1).cast("int").alias("schema_clarity"))


SOURCES = """SELECT s_suppkey AS id, s_name AS name, (['price', 'macro', 'social'])[s_suppkey % 3 + 1] AS category, (['active', 'validated', 'discovered', 'rejected'])[s_suppkey % 4 + 1] AS status, (['ohlcv', 'yields', 'inflation', 'news'])[:s_suppkey % 4 + 1] AS data_types,
 (['equity', 'crypto', 'fx'])[:s_suppkey % 3 + 1] AS asset_types, s_suppkey % 2 = 0 AS official, s_suppkey % 5 <> 0 AS free, s_suppkey % 3 = 0 AS auth, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE 'daily' END AS cadence, CAST(s_suppkey % 5 + 1 AS INT) AS schema_clarity FROM supplier"""
VALUED = "len(list_intersect(data_types, ['ohlcv', 'yields', 'inflation']))"
USEFUL = f"""round(least(0.2 * CAST(official AS INT) + 0.15 * CAST(free AS INT) + 0.08 * CAST(NOT auth AS INT) + 0.1 * CAST(cadence = 'daily' AS INT) + 0.15 * (schema_clarity - 1) / 4
 + 0.2 * least(0.5 * CAST(category IN ('price', 'macro') AS INT) + CASE WHEN {VALUED} >= 3 THEN 0.5 WHEN {VALUED} >= 1 THEN 0.25 * least({VALUED}, 2) ELSE 0 END, 1) + 0.12 * least((len(asset_types) + len(data_types)) / 8, 1), 1), 4)"""


def useful(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sources(spark, sf_dir).withColumn("score", scores.usefulness())
    return made.select("id", "name", "category", "status", "score", scores.proposal_priority("score").alias("priority"), F.array_join("data_types", ",").alias("types"))


USEFUL_SQL = f"SELECT id, name, category, status, score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS priority, array_to_string(data_types, ',') AS types FROM (SELECT *, {USEFUL} AS score FROM ({SOURCES}))"


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.matching(sources(spark, sf_dir).withColumn("score", scores.usefulness()), {"auth": False}, {"data_types": "yields"}, {"score": 0.4}, search=("SUPPLIER", ("name", "category")))
    return filters.ordered(kept, "status", tie="id", ranks=("active", "validated", "discovered")).select("id", "status", "score")


# claims and experiments made of orders
def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return orders(spark, sf_dir).select(k.alias("experiment_id"), F.when(k % 3 == 0, "mlp").otherwise("logistic").alias("model_type"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.array(F.lit("daily"), F.substring("o_orderpriority", 1, 1)).alias("tags"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("backtest"), F.to_date("o_orderdate").alias("created"))


EXPERIMENTS = "SELECT o_orderkey AS experiment_id, CASE WHEN o_orderkey % 3 = 0 THEN 'mlp' ELSE 'logistic' END AS model_type, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, o_orderpriority[1:1] AS tag, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS backtest, CAST(o_orderdate AS DATE) AS created FROM orders"


def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bars(spark, sf_dir).transform(features.bands).transform(features.directional).transform(features.moving_averages)
    ret = F.try_divide("close", features.lag("close")) - 1
    made = made.withColumn("_r", ret)
    made = made.withColumn("rolling_sharpe_21", features.roll(F.avg, "_r", 21) / (features.roll(F.stddev_samp, "_r", 21) + 1e-9) * features.YEAR).drop("_r")
    return made


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ladders of votes on every bar."""
    made = latest_features(spark, sf_dir).withColumns({"c": scores.consensus(), "signal": scores.quick_signal(), "p": scores.rule_probability()})
    return rounded(made.select("asset", "ts", "c.*", "signal", "p", scores.direction("p").alias("direction"), scores.certainty("p").alias("certainty")), ["asset", "ts", "overall", "bull", "bear", "signal", "direction", "certainty"], ["score", "p"])


def _ladders_sql() -> str:
    made = _features()
    joined = f"SELECT m.asset, m.ts, m.rsi_14, m.macd, m.macd_signal, m.ema_9_21_cross AS cross_, b.bb_pct, a.adx_14, r.rolling_sharpe_21 AS sh FROM ({made['feature_moving_averages'][3]}) m JOIN ({made['feature_bands'][3]}) b USING (asset, ts) JOIN ({made['feature_adx'][3]}) a USING (asset, ts) JOIN ({made['feature_risk'][3]}) r USING (asset, ts)"
    v = "list_filter([CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 WHEN rsi_14 IS NOT NULL THEN 0 END, CASE WHEN macd > macd_signal THEN 1 ELSE -1 END, CASE WHEN bb_pct < 0.2 THEN 1 WHEN bb_pct > 0.8 THEN -1 WHEN bb_pct IS NOT NULL THEN 0 END, CASE WHEN cross_ = 1 THEN 1 ELSE -1 END], lambda x: x IS NOT NULL)"
    p = "list_avg(list_filter([CASE WHEN rsi_14 < 30 THEN 1.0 WHEN rsi_14 > 70 THEN 0.0 WHEN rsi_14 IS NOT NULL THEN 0.5 END, CASE WHEN macd > macd_signal THEN 0.65 ELSE 0.35 END, CASE WHEN bb_pct < 0.2 THEN 0.72 WHEN bb_pct > 0.8 THEN 0.28 WHEN bb_pct IS NOT NULL THEN 0.5 END, CASE WHEN cross_ = 1 THEN 0.68 END, CASE WHEN sh > 0.5 THEN 0.62 WHEN sh < -0.5 THEN 0.38 END], lambda x: x IS NOT NULL))"
    one = lambda c: f"CAST(coalesce({c}, false) AS INT)"
    step = f"SELECT *, {v} AS v, CAST({p} AS DOUBLE) AS p, {one('rsi_14 < 35')} + {one('macd > macd_signal')} + {one('cross_ = 1')} AS qb, {one('rsi_14 > 65')} + {one('NOT macd > macd_signal')} + {one('cross_ <> 1')} AS qs FROM ({joined})"
    step = f"SELECT *, CAST(len(list_filter(v, lambda x: x = 1)) AS INT) AS bull, CAST(len(list_filter(v, lambda x: x = -1)) AS INT) AS bear FROM ({step})"
    out = f"SELECT *, CASE WHEN bull > bear + 1 THEN 'bullish' WHEN bear > bull + 1 THEN 'bearish' ELSE 'neutral' END AS overall, round((bull - bear) / greatest(len(v) + CAST(adx_14 IS NOT NULL AS INT), 1) * 100, 1) AS score, CASE WHEN qb > qs THEN 'bullish' WHEN qs > qb THEN 'bearish' ELSE 'neutral' END AS signal, CASE WHEN p > 0.55 THEN 'bullish' WHEN p < 0.45 THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN abs(p - 0.5) > 0.15 THEN 'high' WHEN abs(p - 0.5) > 0.07 THEN 'medium' ELSE 'low' END AS certainty FROM ({step})"
    return picked(out, ["asset", "ts", "overall", "bull", "bear", "signal", "direction", "certainty"], ["score", "p"])


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regime for each nation: its suppliers' and customers' balances stand for the levels of the series."""
    level = customers(spark, sf_dir).groupBy(F.col("c_nationkey").alias("nation")).agg((F.avg("c_acctbal") / 1000 - 4.5).alias("T10Y2Y"), (F.max("c_acctbal") / 2400).alias("CPIAUCSL"), (F.min("c_acctbal") / -300 - 0.5).alias("T10YIE"), (F.stddev_samp("c_acctbal") / 500).alias("BAMLH0A0HYM2"), F.lit(None).cast("double").alias("STLFSI4"), (F.count("*") / 2.0).alias("VIXCLS"))
    return scores.macro_regime(level).select("nation", "growth", "inflation", "credit", "risk", "quadrant")


REGIMES = """SELECT nation, growth, inflation, credit, risk, CASE WHEN growth >= 0 AND inflation > 0 THEN 'reflation' WHEN growth >= 0 THEN 'goldilocks' WHEN inflation > 0 THEN 'stagflation' ELSE 'deflation_risk' END AS quadrant FROM (SELECT nation, CAST(CASE WHEN c > 0.5 THEN 1 WHEN c < -0.25 THEN -1 ELSE 0 END AS INT) AS growth,
 CAST(CASE WHEN p > 4 OR e > 3 THEN 1 WHEN p < 1.5 OR e < 1.5 THEN -1 ELSE 0 END AS INT) AS inflation, CAST(CASE WHEN h > 6 THEN -1 ELSE 0 END AS INT) AS credit, CAST(CASE WHEN v > 30 THEN -1 WHEN v < 15 THEN 1 ELSE 0 END AS INT) AS risk
 FROM (SELECT c_nationkey AS nation, avg(c_acctbal) / 1000 - 4.5 AS c, max(c_acctbal) / 2400 AS p, min(c_acctbal) / -300 - 0.5 AS e, stddev_samp(c_acctbal) / 500 AS h, count(*) / 2.0 AS v FROM customer GROUP BY 1))"""

# betas of brands to order modes by regime, sectors by type, for the structure of the graph
BETAS = "SELECT p_brand AS asset, l_returnflag AS factor, CASE l_linestatus WHEN 'O' THEN 'bear' ELSE 'stress' END AS regime, avg(l_discount) * 10 + avg(l_tax) * 5 - 0.6 AS beta FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3 UNION ALL SELECT p_brand, l_returnflag, 'all', avg(l_discount) * 10 + avg(l_tax) * 5 - 0.6 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"


def betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lines(spark, sf_dir).join(parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    beta = (F.avg("l_discount") * 10 + F.avg("l_tax") * 5 - 0.6).alias("beta")
    asset, factor = F.col("p_brand").alias("asset"), F.col("l_returnflag").alias("factor")
    by = joined.groupBy(asset, factor, F.when(F.col("l_linestatus") == "O", "bear").otherwise("stress").alias("regime")).agg(beta)
    return by.unionAll(joined.groupBy(asset, factor).agg(beta).select("asset", "factor", F.lit("all").alias("regime"), "beta"))


DIVERGENCE = f"SELECT r.asset, r.factor, r.regime, b.beta AS beta_all, r.beta AS beta_regime, abs(r.beta - b.beta) AS abs_change, CASE WHEN abs(b.beta) > 1e-9 THEN abs(r.beta - b.beta) / abs(b.beta) END AS rel_change, CASE WHEN abs(r.beta) > abs(b.beta) THEN 'amplified' ELSE 'dampened' END AS direction FROM (SELECT * FROM ({BETAS}) WHERE regime <> 'all') r JOIN (SELECT * FROM ({BETAS}) WHERE regime = 'all') b USING (asset, factor)"


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.divergence(betas(spark, sf_dir))


def bridge_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, factor): a brand and a flag where it discounts more than usual."""
    return betas(spark, sf_dir).where("regime = 'all' and beta > 0.1").select("asset", "factor")


BRIDGES = f"SELECT asset, factor FROM ({BETAS}) WHERE regime = 'all' AND beta > 0.1"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(F.col("p_brand").alias("asset"), F.substring("p_brand", 1, 7).alias("sector")).distinct()


MEMBERS = "SELECT DISTINCT p_brand AS asset, p_brand[1:7] AS sector FROM part"
EXPOSURE = f"SELECT asset, coalesce(divergence, 0) AS divergence, coalesce(bridges, 0) AS bridges FROM (SELECT asset, sum(abs_change) AS divergence FROM ({DIVERGENCE}) GROUP BY 1) FULL JOIN (SELECT asset, count(DISTINCT factor) AS bridges FROM ({BRIDGES}) GROUP BY 1) USING (asset)"
STRESS = f"SELECT sector, count(*) AS members, avg(d) AS mean_divergence, max(d) AS max_divergence, CASE WHEN max(d) > 0 THEN arg_min(asset, (-d, asset)) END AS most_divergent, avg(b) AS mean_bridges, avg(CAST(d > 0 AS INT)) AS breadth, 0.5 * least(avg(d) / 0.3, 1) + 0.25 * least(avg(b) / 3, 1) + 0.25 * avg(CAST(d > 0 AS INT)) AS stress FROM (SELECT m.asset, m.sector, coalesce(divergence, 0) AS d, coalesce(bridges, 0) AS b FROM ({MEMBERS}) m LEFT JOIN ({EXPOSURE}) USING (asset)) GROUP BY 1"


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.sector_stress(members(spark, sf_dir), intelligence.exposure(divergences(spark, sf_dir), bridge_factors(spark, sf_dir)))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of the brands of their lines, within three weeks of a day."""
    joined = lines(spark, sf_dir).join(parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    due = joined.select(F.col("p_brand").alias("asset"), F.to_date("l_shipdate").alias("event_date"), F.col("l_orderkey").alias("event_id"), "l_linenumber")
    degree = joined.groupBy(F.col("p_brand").alias("asset")).agg(F.count_distinct("l_suppkey").alias("degree"))
    found = intelligence.importance(due, degree, intelligence.exposure(divergences(spark, sf_dir), bridge_factors(spark, sf_dir)), "1996-06-15")
    return rounded(found, ["asset", "event_id", "event_date", "l_linenumber", "upcoming"], ["importance"])


def _importance_sql() -> str:
    joined = "SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey"
    return f"SELECT p_brand AS asset, l_orderkey AS event_id, CAST(l_shipdate AS DATE) AS event_date, l_linenumber, l_shipdate >= DATE '1996-06-15' AS upcoming, round(0.4 * least(coalesce(degree, 0) / 10, 1) + 0.35 * least(coalesce(divergence, 0) / 0.3, 1) + 0.25 * least(coalesce(bridges, 0) / 3, 1), 6) AS importance FROM ({joined}) l LEFT JOIN (SELECT p_brand AS asset, count(DISTINCT l_suppkey) AS degree FROM ({joined}) GROUP BY 1) g ON g.asset = p_brand LEFT JOIN ({EXPOSURE}) e ON e.asset = p_brand WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-06-08' AND DATE '1996-06-29'"


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = bridge_factors(spark, sf_dir).select(F.explode(F.array("asset", "factor")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def factor_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge_factors(spark, sf_dir).groupBy("factor").agg(F.count_distinct(F.substring("asset", 1, 7)).alias("n_classes"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = divergences(spark, sf_dir)
    similar = d.select(F.greatest(F.least(F.col("rel_change"), F.lit(1.0)), F.lit(-1.0)).alias("cosine"))
    return intelligence.measures(similar, d, factor_spans(spark, sf_dir), degrees(spark, sf_dir), stress(spark, sf_dir))


def _metrics_sql() -> str:
    spans = f"SELECT factor, count(DISTINCT asset[1:7]) AS n_classes FROM ({BRIDGES}) GROUP BY 1"
    degree = f"SELECT node, count(*) AS degree FROM (SELECT unnest([asset, factor]) AS node FROM ({BRIDGES})) GROUP BY 1"
    one = lambda name, value, source: f"SELECT '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM ({source})"
    cosine = "abs(greatest(least(rel_change, 1), -1))"
    rows = [("exposure_sim_mean", f"avg({cosine})", DIVERGENCE), ("exposure_sim_max", f"max({cosine})", DIVERGENCE), ("similar_pairs", "count(*)", DIVERGENCE), ("regime_divergence_mean", "avg(abs_change)", DIVERGENCE), ("regime_divergence_max", "max(abs_change)", DIVERGENCE), ("regime_amplified_pct", "avg(CAST(direction = 'amplified' AS INT))", DIVERGENCE),
            ("bridge_count", "count(*)", spans), ("bridge_max_span", "max(n_classes)", spans), ("centrality_top_degree", "max(degree)", degree), ("centrality_mean_degree", "avg(degree)", degree), ("nodes", "count(*)", degree), ("sector_stress_max", "max(stress)", STRESS), ("sector_stress_mean", "avg(stress)", STRESS), ("sectors", "count(*)", STRESS)]
    return " UNION ALL ".join(one(*r) for r in rows)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.macro(lines(spark, sf_dir)).select(F.col("indicator").alias("metric"), "ts", "value")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of 1998 against the years before."""
    found = monthly(spark, sf_dir)
    return rounded(intelligence.anomalies(found.where("ts >= '1998-01-01'"), found.where("ts < '1998-01-01'"), ["metric"], threshold=1.0), ["metric", "ts", "direction", "severity"], ["z"])


MONTHLY = "SELECT l_returnflag AS metric, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2"
ODD = f"SELECT metric, ts, (value - mean) / std AS z FROM (SELECT * FROM ({MONTHLY}) WHERE ts >= DATE '1998-01-01') JOIN (SELECT metric, avg(value) AS mean, stddev_samp(value) AS std FROM ({MONTHLY}) WHERE ts < DATE '1998-01-01' GROUP BY 1 HAVING count(*) >= 3) USING (metric) WHERE abs((value - mean) / std) >= 1"


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monthly(spark, sf_dir)
    odd = intelligence.anomalies(found.where("ts >= '1998-01-01'"), found.where("ts < '1998-01-01'"), ["metric"], threshold=1.0).withColumn("metric", F.concat_ws(" ", "metric", F.col("ts").cast("string")))
    return intelligence.insights(divergences(spark, sf_dir), stress(spark, sf_dir), odd, factor_spans(spark, sf_dir))


def _insights_sql() -> str:
    spans = f"SELECT factor, count(DISTINCT asset[1:7]) AS n_classes FROM ({BRIDGES}) GROUP BY 1"
    return f"""SELECT CAST(CASE WHEN abs(z) >= 3 THEN 1 ELSE 2 END AS INT) AS priority, 'anomaly' AS kind, metric || ' ' || ts AS subject, printf('%s shows a %s of %.2f deviations', metric || ' ' || ts, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END, z) AS text FROM ({ODD})
 UNION ALL SELECT CASE WHEN stress >= 0.75 THEN 1 ELSE 2 END, 'sector_stress', sector, printf('%s is under stress (%.2f) over %d members', sector, stress, members) FROM ({STRESS}) WHERE stress >= 0.5
 UNION ALL SELECT CASE WHEN direction = 'amplified' THEN 2 ELSE 3 END, 'regime_divergence', asset || '/' || factor || '/' || regime, printf('%s to %s is %s by %.3f in %s', asset, factor, direction, abs_change, regime) FROM ({DIVERGENCE}) WHERE abs_change >= 0.1
 UNION ALL SELECT 3, 'bridge', factor, printf('%s links %d classes', factor, n_classes) FROM ({spans}) WHERE n_classes >= 2"""


def suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(suite.time_series(events(spark, sf_dir), "event_type", "ts", "2024-02-10", arrival="event_id", required=("ts", "value", "unit"), expected=("event_id", "ts", "user_id", "event_type", "value", "unit"), keys=("value", "props"), ranges={"value": (1.0, 100.0), "user_id": (0.0, None)}), ["event_type", "check", "severity", "passed"], ["detail"])


def _suites_sql() -> str:
    base = "SELECT event_type, count(*) AS rows, count(*) - count(DISTINCT (event_id, ts, user_id, event_type, value, props)) AS same, greatest(count(*) FILTER (WHERE value IS NULL), count(*) FILTER (WHERE props IS NULL)) AS nulls, count(ts) - count(DISTINCT ts) AS ties, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') AS age, avg(CAST(value < 1 OR value > 100 AS INT)) AS v, avg(CAST(user_id < 0 AS INT)) AS u FROM events GROUP BY 1"
    back = "SELECT event_type, count(*) FILTER (WHERE ts < before) AS back FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) GROUP BY 1"
    one = lambda name, severity, ok, detail: f"SELECT event_type, '{name}' AS \"check\", '{severity}' AS severity, {ok} AS passed, CAST({detail} AS DOUBLE) AS detail FROM b"
    rows = [one("required_columns", "ERROR", "false", 1), one("row_count", "ERROR", "rows >= 10", "rows"), one("null_rate", "ERROR", "nulls <= 0.05 * rows", "nulls / rows"), one("duplicate_rows", "WARN", "same = 0", "same"), one("duplicate_timestamps", "ERROR", "ties = 0", "ties"), one("stale_data", "WARN", "age <= 7", "age"), one("schema_drift", "WARN", "false", 2), one("numeric_range_value", "ERROR", "v <= 0.001", "v"), one("numeric_range_user_id", "ERROR", "u <= 0.001", "u"), one("monotonic_timestamps", "WARN", "back = 0", "back")]
    return f"WITH b AS (SELECT * FROM ({base}) JOIN ({back}) USING (event_type)) {picked(' UNION ALL '.join(rows), ['event_type', '\"check\"', 'severity', 'passed'], ['detail'])}"


def price_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = suite.prices(bars(spark, sf_dir), "asset", "1998-12-05", expected=("asset", "ts", *suite.PRICES))
    return suite.verdict(checks, "asset")


PRICE_SUITE = f"SELECT asset, CAST(count(*) < 20 AS BIGINT) AS errors, CAST(date_diff('day', max(ts), DATE '1998-12-05') > 5 AS BIGINT) AS warnings, CAST(13 AS BIGINT) AS checks, count(*) >= 20 AS passed FROM ({BARS}) GROUP BY 1"


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", scores.plain_url("url").alias("url"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    made = nations(spark, sf_dir).select("n_nationkey", F.concat(F.when(k % 3 == 0, "asset:").when(k % 3 == 1, "macro:").otherwise(""), F.col("n_name")).alias("node"))
    return made.withColumn("p", scores.namespaced("node", {"asset": "Asset", "macro": "Macro"})).select("n_nationkey", "p.*")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations to order priorities, with the mean price as weight."""
    joined = orders(spark, sf_dir).join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("src"), F.col("o_orderpriority").alias("dst"), F.when(F.col("n_regionkey") % 2 == 0, "IMPACTS").otherwise("CAUSES").alias("rel_type"), F.col("o_orderstatus").alias("regime")).agg(F.avg("o_totalprice").alias("weight"))


EDGES = "SELECT n_name AS src, o_orderpriority AS dst, CASE WHEN n_regionkey % 2 = 0 THEN 'IMPACTS' ELSE 'CAUSES' END AS rel_type, o_orderstatus AS regime, avg(o_totalprice) AS weight FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3, 4"


def between(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = nations(spark, sf_dir).select(F.col("n_name").alias("node"), F.when(F.col("n_regionkey") == 0, "asset").otherwise("macro").alias("kind"))
    ends = orders(spark, sf_dir).select(F.col("o_orderpriority").alias("node"), F.lit("event").alias("kind")).distinct()
    found = filters.edges_between(edges(spark, sf_dir), named.unionAll(ends), relation="IMPACTS", kind="asset", regime="F")
    return rounded(found, ["src", "dst", "src_kind", "dst_kind"], ["weight"])


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    strong = f"SELECT * FROM ({DISCOVERIES}) WHERE strength IN ('moderate', 'strong')"
    edge_columns = ["src", "dst", "rel_type", "run_id"]
    return {
        "discovery_filter": (lambda s, d: rounded(filters.ordered(filters.matching(discoveries(s, d), {"strength": "strong", "run_id": "run1"}, least={"pearson_r": 0.5}), "pearson_r", tie="a", limit=100), ["a", "b", "strength"], ["pearson_r"]), f"SELECT a, b, strength, round(pearson_r, 6) AS pearson_r FROM ({DISCOVERIES}) WHERE strength = 'strong' AND run_id = 'run1' AND pearson_r >= 0.5"),
        "discovery_summary": (lambda s, d: filters.discovery_summary(discoveries(s, d)), f"SELECT strength AS measure, count(*) AS value FROM ({DISCOVERIES}) GROUP BY 1 UNION ALL SELECT 'series', count(DISTINCT x) FROM (SELECT unnest([a, b]) AS x FROM ({DISCOVERIES})) UNION ALL SELECT 'runs', count(DISTINCT run_id) FROM ({DISCOVERIES})"),
        "discovery_edges": (lambda s, d: rounded(intelligence.discovery_edges(discoveries(s, d), 0.075, places=None), edge_columns, ["confidence"]), picked(_edges_sql(DISCOVERIES), edge_columns, ["confidence"])),
        "materialised_edges": (lambda s, d: rounded(intelligence.materialised(discoveries(s, d), places=None).where("rel_type <> 'CAUSES'"), edge_columns, ["confidence"]), picked(f"SELECT * FROM ({_edges_sql(strong)}) WHERE rel_type <> 'CAUSES'", edge_columns, ["confidence"])),
        "confidence_stats": (lambda s, d: rounded(intelligence.confidence_stats(intelligence.discovery_edges(discoveries(s, d), 0.075, places=None)), ["rel_type", "n"], ["mean", "min", "p25", "p75"]), picked(f"SELECT rel_type, CAST(len(x) AS INT) AS n, list_avg(x) AS mean, x[1] AS min, x[CAST(floor(len(x) * 0.25) AS INT) + 1] AS p25, x[CAST(floor(len(x) * 0.75) AS INT) + 1] AS p75 FROM (SELECT rel_type, list_sort(list(confidence)) AS x FROM ({_edges_sql(DISCOVERIES)}) GROUP BY 1)", ["rel_type", "n"], ["mean", "min", "p25", "p75"])),
        "source_usefulness": (useful, USEFUL_SQL),
        "source_list": (source_list, f"SELECT id, status, score FROM (SELECT *, {USEFUL} AS score FROM ({SOURCES})) WHERE NOT auth AND list_contains(data_types, 'yields') AND score >= 0.4 AND contains(lower(name), 'supplier')"),
        "experiment_filter": (lambda s, d: filters.ordered(filters.matching(experiments(s, d), {"model_type": "mlp", "status": "completed"}, {"tags": "1"}, present=("backtest",)), "created", tie="experiment_id").select("experiment_id", "created", "backtest"), f"SELECT experiment_id, created, backtest FROM ({EXPERIMENTS}) WHERE model_type = 'mlp' AND status = 'completed' AND tag = '1' AND backtest IS NOT NULL"),
        "screener_filter": (lambda s, d: filters.ordered(filters.matching(screener(s, d), within={"rsi_14": (45.0, 60.0)}), "rsi_14", descending=False, tie="asset").select("asset", "consensus", "rsi_14"), f"SELECT asset, consensus, rsi_14 FROM ({_screener_sql()}) WHERE rsi_14 IS NULL OR rsi_14 BETWEEN 45 AND 60"),
        "symbol_search": (lambda s, d: filters.matching(parts(s, d), search=("MEDIUM", ("p_name", "p_type"))).orderBy("p_partkey").limit(10).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'medium') OR contains(lower(p_type), 'medium') ORDER BY p_partkey LIMIT 10"),
        "table_counts": (lambda s, d: filters.counts({n: tables.table(s, d, n) for n in ("region", "nation", "customer", "orders", "events")}), " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in ("region", "nation", "customer", "orders", "events"))),
        "vote_ladders": (ladders, _ladders_sql()),
        "macro_regime": (regimes, REGIMES),
        "regime_divergence": (lambda s, d: rounded(divergences(s, d), ["asset", "factor", "regime", "direction"], ["beta_all", "beta_regime", "abs_change", "rel_change"]), picked(DIVERGENCE, ["asset", "factor", "regime", "direction"], ["beta_all", "beta_regime", "abs_change", "rel_change"])),
        "wide_betas": (lambda s, d: rounded(intelligence.wide_betas(betas(s, d), ["all", "bear", "stress"]), ["asset", "factor"], ["beta_all", "beta_bear", "beta_stress"]), picked(f"SELECT asset, factor, {', '.join(f"max(beta) FILTER (WHERE regime = '{r}') AS beta_{r}" for r in ('all', 'bear', 'stress'))} FROM ({BETAS}) GROUP BY 1, 2", ["asset", "factor"], ["beta_all", "beta_bear", "beta_stress"])),
        "sector_stress": (lambda s, d: rounded(stress(s, d), ["sector", "members", "most_divergent"], ["mean_divergence", "max_divergence", "mean_bridges", "breadth", "stress"]), picked(STRESS, ["sector", "members", "most_divergent"], ["mean_divergence", "max_divergence", "mean_bridges", "breadth", "stress"])),
        "event_importance": (importance, _importance_sql()),
        "graph_metrics": (lambda s, d: rounded(metrics(s, d), ["metric"], ["value"]), picked(_metrics_sql(), ["metric"], ["value"])),
        "graph_health": (lambda s, d: rounded(intelligence.health(metrics(s, d)), ["grade"], ["health"]), f"WITH m AS ({_metrics_sql()}), v AS (SELECT 25 * ((1 - least(max(value) FILTER (WHERE metric = 'regime_divergence_mean') / 0.3, 1)) + (1 - least(max(value) FILTER (WHERE metric = 'sector_stress_mean'), 1)) + least(max(value) FILTER (WHERE metric = 'bridge_count') / 5, 1) + least(max(value) FILTER (WHERE metric = 'centrality_mean_degree') / 5, 1)) AS h FROM m) SELECT CASE WHEN h >= 80 THEN 'A' WHEN h >= 65 THEN 'B' WHEN h >= 50 THEN 'C' WHEN h >= 35 THEN 'D' ELSE 'F' END AS grade, round(h, 6) AS health FROM v"),
        "structural_anomalies": (anomalies, picked(f"SELECT *, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS direction, CASE WHEN abs(z) >= 3 THEN 'critical' ELSE 'warning' END AS severity FROM ({ODD})", ["metric", "ts", "direction", "severity"], ["z"])),
        "rolling_anomalies": (lambda s, d: rounded(intelligence.rolling_anomalies(bars(s, d).select(F.col("asset").alias("node"), "ts", F.col("close").alias("value"))), ["node", "ts", "seen"], ["z"]), picked(f"SELECT * FROM (SELECT asset AS node, ts, count(close) OVER w AS seen, (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) AS z FROM ({BARS}) WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE seen >= 20 AND abs(z) > 3", ["node", "ts", "seen"], ["z"])),
        "insights": (insights, _insights_sql()),
        "validation_suite": (suites, _suites_sql()),
        "price_suite": (price_suite, PRICE_SUITE),
        "plain_urls": (urls, "SELECT page_id, regexp_replace(lower(trim(url)), '/+$', '') AS url FROM pages"),
        "namespaced_nodes": (nodes, "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Asset' WHEN 1 THEN 'Macro' ELSE 'unknown' END AS kind, n_name AS label FROM nation"),
        "edges_between": (between, f"SELECT src, dst, 'asset' AS src_kind, 'event' AS dst_kind, round(weight, 6) AS weight FROM ({EDGES}) JOIN nation ON n_name = src WHERE rel_type = 'IMPACTS' AND regime = 'F' AND n_regionkey = 0"),
        "two_hops": (lambda s, d: filters.two_hops(edges(s, d).where("weight > 150000")), f"WITH e AS (SELECT DISTINCT src, dst FROM ({EDGES}) WHERE weight > 150000) SELECT x.dst AS a, y.dst AS b, count(*) AS shared FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2"),
        "unknown_edges": (lambda s, d: filters.unknown_edges(filters.two_hops(edges(s, d)).select("a", "b"), edges(s, d).where("weight > 160000").select("src", "dst")), f"SELECT DISTINCT x.dst AS a, y.dst AS b FROM ({EDGES}) x JOIN ({EDGES}) y ON x.src = y.src AND x.dst < y.dst"),
        "undirected_neighbours": (lambda s, d: filters.neighbours(edges(s, d), nations(s, d).where("n_regionkey = 1").select(F.col("n_name").alias("node"))), f"SELECT DISTINCT src AS node, dst AS other FROM ({EDGES}) JOIN nation ON n_name = src WHERE n_regionkey = 1"),
    }
