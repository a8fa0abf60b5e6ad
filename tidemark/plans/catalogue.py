"""Queries of candidates, proposals, claims, graph builders, and of operators that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest, builders, candidates, features, intelligence, quality, relations, scores, suite, text, validation
from tidemark.operators.baseline import evidence, saved
from tidemark.plans.discovery import FOLDS, folds, returns
from tidemark.plans.listing import EDGES, edges, latest_features
from tidemark.plans.market import SIGNALS, _features, bars, rounded, signals
from tidemark.plans.modelling import BRAND_PAIRS, brand_returns
from tidemark.plans.sql import BARS, S, picked
from tidemark.sources.tables import table


# candidates made of suppliers
def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    pick = lambda n, *options: F.element_at(F.array(*(F.lit(o) for o in options)), (k % n + 1).cast("int"))
    lists = lambda n, *options: F.element_at(F.array(*(F.array(*map(F.lit, o)) if o else F.array().cast("array<string>") for o in options)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.lit(None).cast("string").alias("source_id"), F.when(k % 13 != 0, F.concat(F.lit(" "), "s_name", F.lit(" (EU) "))).alias("name"), F.when(k % 11 != 0, F.concat(F.lit("https://host"), k.cast("string"))).alias("url"),
        pick(4, "Macro ", "price", "weird", None).alias("category"), lists(3, ["ETF", "etf ", "", "bond"], ["Bond"], []).alias("asset_types"), lists(4, ["OHLCV", "news"], ["yields", "unknown_x"], [], ["trade", "cpi", "gdp"]).alias("data_types"),
        pick(3, "API", "file_download", None).alias("method"), pick(5, "EOD", "Real-Time", "q", None, "hourly").alias("cadence"), (k % 2 == 0).alias("auth"), (k % 5 != 0).alias("free"), F.lit(None).cast("boolean").alias("official"), (k % 9 - 1).cast("int").alias("clarity"), k.alias("key"),
    )


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.normalised(raw_candidates(spark, sf_dir)).select("source_id", "name", "url", "category", "method", "cadence", "auth", "free", "official", F.array_join("asset_types", ",").alias("asset_types"), F.array_join("data_types", ",").alias("data_types"), "clarity", "problem")


NORMALISED = """SELECT CASE WHEN s_suppkey % 13 <> 0 THEN regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') || '_eu' ELSE '' END AS source_id, CASE WHEN s_suppkey % 13 <> 0 THEN s_name || ' (EU)' ELSE '' END AS name, CASE WHEN s_suppkey % 11 <> 0 THEN 'https://host' || s_suppkey ELSE '' END AS url,
 CASE WHEN s_suppkey % 4 = 0 THEN 'macro' WHEN s_suppkey % 4 = 1 THEN 'price' ELSE (['price', 'macro', 'unknown'])[s_suppkey % 3 + 1] END AS category, (['api', 'file_download', 'api'])[s_suppkey % 3 + 1] AS method, (['daily', 'realtime', 'quarterly', 'unknown', 'hourly'])[s_suppkey % 5 + 1] AS cadence,
 s_suppkey % 2 = 0 AS auth, s_suppkey % 5 <> 0 AS free, false AS official, (['etf,bond', 'bond', ''])[s_suppkey % 3 + 1] AS asset_types, (['ohlcv,news', 'yields,unknown_x', '', 'trade,cpi,gdp'])[s_suppkey % 4 + 1] AS data_types, CAST(least(greatest(s_suppkey % 9 - 1, 1), 5) AS INT) AS clarity,
 CASE WHEN s_suppkey % 13 = 0 THEN 'no name' WHEN s_suppkey % 11 = 0 THEN 'no url' END AS problem FROM supplier"""


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.normalised(raw_candidates(spark, sf_dir)).withColumn("score", F.length("source_id") % 3 * 0.2 + F.size("data_types") * 0.15 + F.when(F.col("auth"), 0.1).otherwise(0.0))


SCORED = f"SELECT *, len(source_id) % 3 * 0.2 + CASE WHEN data_types = '' THEN 0 ELSE len(string_split(data_types, ',')) END * 0.15 + CASE WHEN auth THEN 0.1 ELSE 0 END AS score FROM ({NORMALISED}) WHERE problem IS NULL"


def proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.proposals(scored_candidates(spark, sf_dir)).withColumns({"fields": F.array_join("fields", ","), "checks": F.array_join("checks", "; ")})


def _proposed_sql() -> str:
    fields = "CASE data_types WHEN 'ohlcv,news' THEN 'date,open,high,low,close,volume,published_at,title,url,source' WHEN 'yields,unknown_x' THEN 'date,maturity,yield_pct,field_unknown_x' WHEN 'trade,cpi,gdp' THEN 'date,country,export_value,import_value,series_id,value,unit' ELSE 'date,value' END"
    checks = "concat_ws('; ', CASE WHEN data_types LIKE 'ohlcv%' THEN 'prices between low and high, some volume' END, CASE WHEN data_types LIKE 'yields%' OR data_types LIKE 'trade%' THEN 'values in their usual range' END, CASE WHEN data_types LIKE '%news' THEN 'one row a url, times that can be read' END, CASE WHEN method = 'file_download' THEN 'size and checksum' ELSE 'status, limits of rate' END, 'nulls below 5 percent')"
    schedule = "CASE cadence WHEN 'daily' THEN '0 20 * * 1-5' WHEN 'realtime' THEN 'every few minutes' WHEN 'quarterly' THEN 'after the reports of a quarter' WHEN 'hourly' THEN '0 * * * *' ELSE 'not known' END"
    return f"SELECT source_id, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS priority, method, {fields} AS fields, {schedule} AS schedule, CASE WHEN NOT auth THEN 'none' ELSE CASE WHEN free THEN 'free' ELSE 'paid' END || ' key ' || upper(source_id) || '_API_KEY' END AS access, {checks} AS checks FROM ({SCORED})"


CLAIM = ["claim_type", "subject", "predicate", "object", "status", "tags", "counterpoints", "notes"]


def told(claims: DataFrame) -> DataFrame:
    return rounded(claims.withColumns({c: F.array_join(c, ",") for c in ("tags", "counterpoints")}), CLAIM, ["confidence"])


def source_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(candidates.source_claims(scored_candidates(spark, sf_dir)))


SOURCE_CLAIMS = f"SELECT 'source_usefulness' AS claim_type, 'source:' || source_id AS subject, 'is_useful_for' AS predicate, 'domain:' || category AS object, 'proposed' AS status, 'scout,' || category || ',' || method AS tags, '' AS counterpoints, name || ': by its description alone' AS notes, round(round(score, 4), 6) + 0.0 AS confidence FROM ({SCORED})"


def source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.source_evidence(scored_candidates(spark, sf_dir))


SOURCE_EVIDENCE = f"SELECT sha256('scout:' || source_id)[:12] AS evidence_id, 'source_registry' AS source_type, 'scout:' || source_id AS source_ref, name || printf(', score %.2f, ', score + 1e-9) || category || ', official no, free ' || CASE WHEN free THEN 'yes' ELSE 'no' END || ', by ' || method AS summary FROM ({SCORED})"


def summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = folds(spark, sf_dir).withColumn("symbol", F.when(F.col("fold") <= 4, "aaa").otherwise("bbb"))
    return made.groupBy("symbol", "model").agg(F.count("*").alias("n_folds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.count_if("beat").alias("n_beat"), (F.avg("auc") > 0.515).alias("overall"))


def fold_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(candidates.fold_claims(summarised(spark, sf_dir)))


def _fold_claims_sql() -> str:
    s = f"SELECT CASE WHEN fold <= 4 THEN 'AAA' ELSE 'BBB' END AS symbol, model, count(*) AS n_folds, avg(accuracy) AS m, stddev_pop(accuracy) AS d, count(*) FILTER (WHERE total_return > benchmark_return) AS n_beat, avg(auc) > 0.515 AS overall FROM ({FOLDS}) GROUP BY 1, 2"
    each = "SELECT 'performance' AS claim_type, 'model:' || model || '_on_' || symbol AS subject, 'achieves_wf_mean_accuracy' AS predicate, printf('acc:%.4f_folds:%d', m, n_folds) AS object, 'proposed' AS status, 'walk_forward,' || symbol || ',' || model || CASE WHEN overall THEN ',wf_promoted' ELSE ',wf_not_promoted' END AS tags, concat_ws(',', CASE WHEN d > 0.06 THEN printf('accuracy varies over folds by %.3f', d) END, CASE WHEN n_beat < (n_folds + 1) // 2 THEN printf('beats the market on %d of %d folds', n_beat, n_folds) END) AS counterpoints, printf('mean %.3f, deviation %.3f', m, d) AS notes, CAST(CASE WHEN overall THEN 0.7 WHEN m >= 0.52 AND n_beat >= (n_folds + 1) // 2 THEN 0.58 ELSE 0.42 END AS DOUBLE) AS confidence FROM s"
    lead = "SELECT 'performance', 'model:' || model || '_on_' || symbol, 'leads_walk_forward_comparison', 'vs:' || array_to_string(list_filter(names, lambda x: x <> model), '+'), 'proposed', 'wf_comparison_winner,walk_forward,' || symbol || ',' || model, 'differences may be small beside those between folds', printf('mean %.3f', m), 0.6 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(m, 9) DESC, model) AS k, list_sort(list(model) OVER (PARTITION BY symbol)) AS names FROM s) WHERE k = 1 AND len(names) > 1"
    return f"WITH s AS ({s}) {each} UNION ALL {lead}"


def relationship_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.pairwise import correlations

    strong = correlations(brand_returns(spark, sf_dir)).where("n >= 30 and abs(r) >= 0.05")
    return rounded(candidates.relationship_claims(strong, "returns"), ["claim_type", "subject", "predicate", "object", "status"], ["confidence"])


RELATIONSHIP_CLAIMS = f"SELECT 'relationship' AS claim_type, 'asset:' || a AS subject, 'is_correlated_with' AS predicate, 'asset:' || b || '_criterion:returns' AS object, 'proposed' AS status, round(abs(r), 4) AS confidence FROM (SELECT a, b, corr(x, y) AS r FROM ({BRAND_PAIRS}) GROUP BY 1, 2 HAVING count(*) >= 30 AND abs(corr(x, y)) >= 0.05)"


# probes made of orders: a HEAD of each, and a GET
def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), k.alias("k"), F.to_date("o_orderdate").alias("probed_at"))
    code = lambda *codes: F.element_at(F.array(*map(F.lit, codes)), (F.col("k") % len(codes) + 1).cast("int"))
    heads = orders.select("source_id", "probed_at", "k", code(200, 405, 404, 501, 500, 301, 429).alias("http_status"), (F.col("k") % 90).cast("double").alias("latency_ms"))
    gets = orders.where("k % 3 <> 0").select("source_id", "probed_at", "k", code(200, 503).alias("http_status"), (F.col("k") % 50 + 10).cast("double").alias("latency_ms"))
    return candidates.answered(heads, gets).withColumn("ok", F.col("http_status").between(200, 399) | F.col("http_status").isin(401, 403, 404, 429))


PROBES = """SELECT 's' || k AS source_id, k, day AS probed_at, CASE WHEN refused AND k % 3 <> 0 THEN (CASE k % 2 WHEN 0 THEN 200 ELSE 503 END) ELSE h END AS http_status, CASE WHEN refused AND k % 3 <> 0 THEN CAST(k % 50 + 10 AS DOUBLE) ELSE CAST(k % 90 AS DOUBLE) END AS latency_ms, CASE WHEN refused AND k % 3 <> 0 THEN 'GET' ELSE 'HEAD' END AS method
 FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, ([200, 405, 404, 501, 500, 301, 429])[o_orderkey % 7 + 1] AS h, o_orderkey % 7 IN (1, 3) AS refused FROM orders)"""
PROBED = f"SELECT *, http_status BETWEEN 200 AND 399 OR http_status IN (401, 403, 404, 429) AS ok FROM ({PROBES})"


def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.probe_summary(_probes(spark, sf_dir), 200000), ["total", "attempted", "reachable", "failed", "skipped", "avg_latency_ms"], ["success_rate"])


PROBE_SUMMARY = f"SELECT CAST(200000 AS INT) AS total, count(*) AS attempted, count(*) FILTER (WHERE ok) AS reachable, count(*) FILTER (WHERE NOT ok) AS failed, 200000 - count(*) AS skipped, round(avg(CASE WHEN ok AND latency_ms > 0 THEN latency_ms END), 1) AS avg_latency_ms, round(count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate FROM ({PROBED})"


def probe_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _probes(spark, sf_dir).withColumns({"name": F.upper("source_id"), "url": F.concat(F.lit("https://"), "source_id")})
    return candidates.probe_evidence(named)


PROBE_EVIDENCE = f"SELECT sha256('probe:' || source_id || ':' || probed_at)[:12] AS evidence_id, 'source_registry' AS source_type, 'probe:' || source_id || ':' || probed_at AS source_ref, upper(source_id) || ' at https://' || source_id || CASE WHEN ok THEN ' is there' ELSE ' is not there' END || ', status ' || http_status || ' by ' || method || printf(', %.0f ms', latency_ms) AS summary FROM ({PROBED})"


def evidence_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of folds saved beside that of probes, new keys only; then that of one type."""
    known = probe_evidence(spark, sf_dir).select("evidence_id", "source_type", "source_ref")
    new = evidence(folds(spark, sf_dir)).select("evidence_id", "source_type", F.col("note").alias("source_ref"))
    return saved(new, known, "evidence_id").where("source_type = 'walk_forward'")


EVIDENCE_OF_TYPE = f"SELECT sha256('walk_forward:' || model || ':' || fold)[:12] AS evidence_id, 'walk_forward' AS source_type, printf('%s fold %d: accuracy %.3f', model, fold, accuracy) AS source_ref FROM ({FOLDS})"


# graph builders
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.split("p_type", " ")
    assets = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("asset"), kind[0].alias("sector"), F.col("p_type").alias("industry"))
    return builders.classified(assets)


CLASSIFIED = "SELECT DISTINCT * FROM (SELECT 'P' || p_partkey AS src, 'industry:' || p_type AS dst, 'BELONGS_TO' AS rel FROM part UNION ALL SELECT 'P' || p_partkey, 'sector:' || split_part(p_type, ' ', 1), 'BELONGS_TO' FROM part UNION ALL SELECT 'industry:' || p_type, 'sector:' || split_part(p_type, ' ', 1), 'PART_OF' FROM part)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a part on a day as reports; those of small parts."""
    found = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("eps"), F.col("l_tax").alias("eps_estimate"))
    universe = table(spark, sf_dir, "part").where("p_size <= 25").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    nodes, links = builders.reported(found, universe)
    return links.join(nodes.select(F.col("event_id").alias("dst"), "eps", "eps_estimate"), "dst").select("src", "dst", "rel", "eps", "eps_estimate")


REPORTS = "SELECT 'P' || l_partkey AS src, 'earnings_P' || l_partkey || '_' || CAST(l_shipdate AS DATE) AS dst, 'REPORTS' AS rel, max(l_extendedprice) AS eps, arg_max(l_tax, (l_extendedprice, l_tax)) AS eps_estimate FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY l_partkey, CAST(l_shipdate AS DATE)"


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of parts, modes' impact on brands, brands' sectors and correlated brands, counted by relation."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    supplies = lines.groupBy(name("S", "l_suppkey").alias("src"), name("P", "l_partkey").alias("dst")).agg(F.max(F.when(F.col("l_discount") > 0.02, F.col("l_discount"))).alias("share"))
    impacts = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("src"), name("C", "o_custkey").alias("dst")).distinct()
    sectors = table(spark, sf_dir, "part").select(name("P", "p_partkey").alias("asset"), F.col("p_brand").alias("sector"))
    from tidemark.operators.pairwise import correlations

    found = correlations(brand_returns(spark, sf_dir)).where("n >= 30 and r is not null").withColumn("relationship_type", F.when(F.col("r") > 0.02, "leads").otherwise("correlates_with"))
    made = builders.knowledge(supplies, impacts, sectors, found)
    return rounded(made.groupBy("rel").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.count_distinct("src").alias("n_src")), ["rel", "n", "n_src"], ["weight"])


def _knowledge_sql() -> str:
    s = "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, 'supplies_to' AS rel, coalesce(nullif(max(CASE WHEN l_discount > 0.02 THEN l_discount END), 0), 0.1) AS weight FROM lineitem GROUP BY 1, 2"
    c = f"SELECT a AS src, b AS dst, CASE WHEN corr(x, y) > 0.02 THEN 'leads' ELSE 'correlates_with' END AS rel, abs(corr(x, y)) AS weight FROM ({BRAND_PAIRS}) GROUP BY 1, 2 HAVING count(*) >= 30"
    b = "SELECT 'P' || p_partkey AS src, 'SECTOR:' || p_brand AS dst, 'belongs_to' AS rel, 1.0 AS weight FROM part"
    union = f"SELECT * FROM s UNION ALL SELECT dst, src, rel, weight / 2 FROM s UNION ALL SELECT DISTINCT o_orderpriority, 'C' || o_custkey, 'impacts', 1.0 FROM orders UNION ALL SELECT * FROM b UNION ALL SELECT dst, src, rel, weight FROM b UNION ALL SELECT * FROM c UNION ALL SELECT dst, src, rel, weight FROM c WHERE rel <> 'leads'"
    return f"WITH s AS ({s}), b AS ({b}), c AS ({c}) SELECT rel, count(*) AS n, count(DISTINCT src) AS n_src, round(sum(weight), 6) + 0.0 AS weight FROM ({union}) GROUP BY 1"


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.pairwise import correlations

    found = builders.correlated(correlations(brand_returns(spark, sf_dir)).where("n >= 30"))
    return rounded(builders.partners(found, 0.02, 3), ["node", "other", "rank"], ["r"])


PARTNERS = f"WITH c AS (SELECT a, b, corr(x, y) AS r FROM ({BRAND_PAIRS}) GROUP BY 1, 2 HAVING count(*) >= 30) SELECT node, other, CAST(rank AS INT) AS rank, round(r, 6) + 0.0 AS r FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(abs(r), 9) DESC, other) AS rank FROM (SELECT a AS node, b AS other, r FROM c UNION ALL SELECT b, a, r FROM c) WHERE abs(r) >= 0.02) WHERE rank <= 3"


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg((F.avg("o_totalprice") / 290003).alias("c"), F.count("*").alias("evidence"), F.datediff(F.lit("1998-08-02"), F.max(F.to_date("o_orderdate"))).alias("age_days"))
    k = F.col("src")
    found = found.withColumns({"confidence": F.when(k % 3 == 0, F.least("c", F.lit(1.0))), "pearson_r": F.when(k % 3 == 1, -F.col("c") / 2), "rel_type": F.when(k % 2 == 0, "CAUSES").otherwise("BELONGS_TO")})
    return rounded(builders.weighed(found, 0.3), ["src", "dst"], ["weight"])


WEIGHED = "SELECT src, dst, round(w, 6) + 0.0 AS weight FROM (SELECT *, CASE WHEN src % 3 = 0 THEN least(greatest(CASE WHEN age <= 0 THEN least(c, 1) ELSE greatest(least(c, 1) * pow(0.5, age / (CASE WHEN src % 2 = 0 THEN 45.0 ELSE 3650.0 END * (1 + 0.2 * greatest(e - 1, 0)))), least(c, 1) * 0.1) END, 0), 1) WHEN src % 3 = 1 THEN c / 2 ELSE 0.5 END AS w FROM (SELECT o_custkey AS src, o_orderpriority AS dst, avg(o_totalprice) / 290003 AS c, count(*) AS e, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-08-02') AS age FROM orders GROUP BY 1, 2)) WHERE w >= 0.3"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = edges(spark, sf_dir).select("src", "dst", F.col("rel_type").alias("rel"))
    nodes = made.select(F.col("src").alias("node"), F.lit("nation").alias("kind")).unionAll(made.select(F.col("dst"), F.lit("priority"))).distinct()
    return builders.counted(nodes, made)


COUNTED = f"SELECT 'edge' AS what, rel_type AS kind, count(*) AS n FROM ({EDGES}) GROUP BY 2 UNION ALL SELECT 'node', 'nation', count(DISTINCT src) FROM ({EDGES}) UNION ALL SELECT 'node', 'priority', count(DISTINCT dst) FROM ({EDGES})"


def triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(F.col("event_id"), F.col("event_type").alias("indicator"))
    return builders.triggered(found, found.where("indicator <> 'view'").select("indicator")).groupBy("dst", "rel").agg(F.count("*").alias("n"))


# operators that no other module queries
BASE = ["feature_returns", "feature_volatility", "feature_oscillators", "feature_bands", "feature_moving_averages"]


def base_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All base features of every bar in one plan: of each asset and column the number of values and their mean, missing ones as 0."""
    names = [c for q in BASE for c in _features()[q][2]]
    made = features.base_features(bars(spark, sf_dir))
    long = made.select("asset", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), scores.finite_or_zero(F.col(c).cast("double")).alias("value"), F.col(c).isNotNull().cast("int").alias("there")) for c in names))).alias("f")).select("asset", "f.*")
    return long.groupBy("asset", "name").agg(F.sum("there").alias("n"), (F.round(F.avg("value"), 5) + F.lit(0.0)).alias("mean"))


def _base_sql() -> str:
    rows = [f"SELECT asset, '{c}' AS name, CAST(count({c}) AS BIGINT) AS n, round(avg(coalesce({c}, 0)), 5) + 0.0 AS mean FROM ({_features()[q][3]}) GROUP BY 1" for q in BASE for c in _features()[q][2]]
    return " UNION ALL ".join(rows)


def significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = returns(spark, sf_dir)
    market = rets.groupBy("ts").agg(F.avg("ret").alias("x"))
    fits = relations.exposures(rets.withColumnRenamed("ret", "y").join(market, "ts"), ["asset"])
    return rounded(relations.significant(fits), ["asset", "n", "strength"], ["beta", "t", "p"])


def clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the first of three passes that names it: price, volume, another source."""
    made = bars(spark, sf_dir)
    price = quality.z_scores(made, "close").where("abs(z) > 2").select("asset", "ts", F.lit("price_outlier").alias("reason"))
    volume = quality.z_scores(made, "volume").where("z > 2").select("asset", "ts", F.lit("volume_spike").alias("reason"))
    key = F.concat_ws("/", "asset", F.col("ts").cast("string")).alias("key")
    other = made.select(key, F.col("ts").alias("at"), ((F.col("open") + F.col("close")) / 2).alias("value"))
    differs = quality.reconciled(made.select(key, F.col("close").alias("value")), other, "key", 0.2).select(F.split("key", "/")[0].alias("asset"), F.split("key", "/")[1].cast("date").alias("ts"), F.lit("cross_source").alias("reason"))
    done = suite.filtered(made, [price, volume, differs], ["asset", "ts"])
    return done.groupBy("asset", F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("n"))


def _clean_sql() -> str:
    z = lambda c: f"({c} - avg({c}) OVER (PARTITION BY asset)) / nullif(stddev_samp({c}) OVER (PARTITION BY asset), 0)"
    return f"SELECT asset, CASE WHEN abs(zp) > 2 THEN 'price_outlier' WHEN zv > 2 THEN 'volume_spike' WHEN close <> 0 AND abs((open + close) / 2 - close) / abs(close) > 0.2 THEN 'cross_source' ELSE 'clean' END AS reason, count(*) AS n FROM (SELECT *, coalesce({z('close')}, 0) AS zp, coalesce({z('volume')}, 0) AS zv FROM ({BARS})) GROUP BY 1, 2"


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folds(spark, sf_dir).withColumn("score", validation.composite("accuracy", "auc", "hit_rate", "sharpe"))
    return found.select("model", "fold", "score")


COMPOSITE = f"SELECT model, fold, round(0.3 * accuracy + 0.25 * auc + 0.25 * hit_rate + 0.2 * least(greatest((sharpe + 3) / 6, 0), 1), 6) AS score FROM ({FOLDS})"


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source feeds a series: brands are prices, priorities macro; types have signs or none."""
    names = table(spark, sf_dir, "part").select(F.explode(F.array("p_brand", "p_type", F.concat(F.lit("^"), "p_brand"))).alias("series")).distinct()
    return names.select("series", intelligence.source_of("series", ("Brand#1", "Brand#2", "Brand#3"), ("Brand#4", "Brand#5")).alias("source"))


PROVENANCE = "SELECT series, CASE WHEN series IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'market' WHEN series IN ('Brand#4', 'Brand#5') THEN 'macro' WHEN regexp_matches(series, '[-=.^]') THEN 'market (inferred)' ELSE 'unknown' END AS source FROM (SELECT DISTINCT unnest([p_brand, p_type, '^' || p_brand]) AS series FROM part)"


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bars(spark, sf_dir)
    return rounded(found.select("asset", "ts", scores.colour(F.col("close"), 1000.0, 2003.0).alias("ranged"), scores.colour(F.col("close") / 1003 - 1.5).alias("squashed")), ["asset", "ts"], ["ranged", "squashed"])


def named_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on orders that name the symbols of their parts' types."""
    note = F.concat(F.lit("sold $"), F.substring(F.upper("p_type"), 1, 4), F.lit(" and $"), F.substring(F.upper("p_type"), 1, 2), F.lit(" not $toolong"))
    notes = table(spark, sf_dir, "part").select("p_partkey", note.alias("text"))
    return notes.select("p_partkey", F.array_join(text.tickers("text", ["ECON", "EC", "STAN", "PROM"]), ",").alias("symbols"))


NAMED_SYMBOLS = "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([upper(p_type)[:4], upper(p_type)[:2]], lambda x: x IN ('ECON', 'EC', 'STAN', 'PROM') AND regexp_full_match(x, '[A-Z]{1,5}')))), ',') AS symbols FROM part"


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.shown(latest_features(spark, sf_dir).select("asset", "ts", "rsi_14", "macd", "macd_signal", "adx_14", "bb_pct", "rolling_sharpe_21"), ["asset", "ts"], 4).where("ts >= '1998-01-01'")


def _shown_sql() -> str:
    made = _features()
    joined = f"SELECT m.asset, m.ts, m.rsi_14, m.macd, m.macd_signal, a.adx_14, b.bb_pct, r.rolling_sharpe_21 FROM ({made['feature_moving_averages'][3]}) m JOIN ({made['feature_bands'][3]}) b USING (asset, ts) JOIN ({made['feature_adx'][3]}) a USING (asset, ts) JOIN ({made['feature_risk'][3]}) r USING (asset, ts) WHERE m.ts >= DATE '1998-01-01'"
    names = (("rsi_14", "RSI 14", "momentum"), ("macd", "MACD", "trend"), ("macd_signal", "MACD Signal", "trend"), ("adx_14", "ADX 14", "trend"), ("bb_pct", "BB Position", "volatility"), ("rolling_sharpe_21", "Sharpe 21D", "risk"))
    each = " UNION ALL ".join(f"SELECT asset, ts, {i} AS i, '{n}' AS name, '{k}' AS kind, CAST({c} AS DOUBLE) AS value FROM j" for i, (c, n, k) in enumerate(names))
    return f"WITH j AS MATERIALIZED ({joined}) SELECT asset, ts, CAST(place AS INT) AS place, name, kind, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY asset, ts ORDER BY i) AS place FROM ({each}) WHERE value IS NOT NULL) WHERE place <= 4"


def rolling_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of the rules on each asset's last 90 bars, of those that have 60 before them."""
    from pyspark.sql import Window

    made = latest_features(spark, sf_dir)
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))
    row = F.row_number().over(Window.partitionBy("asset").orderBy("ts"))
    kept = made.withColumns({"_back": back, "_row": row}).where("_back <= 90 and _row > 60")
    return rounded(kept.withColumn("p", scores.rule_probability()), ["asset", "ts"], ["p"])


def _rolling_sql() -> str:
    made = _features()
    joined = f"SELECT m.asset, m.ts, m.rsi_14, m.macd, m.macd_signal, m.ema_9_21_cross AS cross_, b.bb_pct, r.rolling_sharpe_21 AS sh FROM ({made['feature_moving_averages'][3]}) m JOIN ({made['feature_bands'][3]}) b USING (asset, ts) JOIN ({made['feature_risk'][3]}) r USING (asset, ts)"
    p = "list_avg(list_filter([CASE WHEN rsi_14 < 30 THEN 1.0 WHEN rsi_14 > 70 THEN 0.0 WHEN rsi_14 IS NOT NULL THEN 0.5 END, CASE WHEN macd > macd_signal THEN 0.65 ELSE 0.35 END, CASE WHEN bb_pct < 0.2 THEN 0.72 WHEN bb_pct > 0.8 THEN 0.28 WHEN bb_pct IS NOT NULL THEN 0.5 END, CASE WHEN cross_ = 1 THEN 0.68 END, CASE WHEN sh > 0.5 THEN 0.62 WHEN sh < -0.5 THEN 0.38 END], lambda x: x IS NOT NULL))"
    return f"SELECT asset, ts, round(CAST({p} AS DOUBLE), 6) + 0.0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS k, row_number() OVER ({S}) AS i FROM ({joined})) WHERE k <= 90 AND i > 60"


def short_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = bars(spark, sf_dir)
    return rounded(backtest.summary(backtest.positions(prices, signals(prices), short=True)), ["asset", "n_bars"], ["total_return", "annual_return", "max_drawdown"])


def _short_sql() -> str:
    steps = f"SELECT *, coalesce(lag(CASE WHEN coalesce(want, 0) = 1 THEN 1 ELSE -1 END) OVER ({S}), 0) AS position, coalesce(close / lag(close) OVER ({S}) - 1, 0) AS r FROM ({SIGNALS})"
    steps = f"SELECT *, coalesce(lag(position) OVER ({S}), 0) * r - CAST(position <> coalesce(lag(position) OVER ({S}), 0) AS INT) * 0.001 AS sr FROM ({steps})"
    steps = f"SELECT *, product(greatest(1 + sr, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS equity FROM ({steps})"
    steps = f"SELECT *, equity / max(equity) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM ({steps})"
    return picked(f"SELECT *, g - 1 AS total_return, pow(g, 252.0 / n_bars) - 1 AS annual_return FROM (SELECT asset, count(*) AS n_bars, product(greatest(1 + sr, 0)) AS g, min(drawdown) AS max_drawdown FROM ({steps}) GROUP BY asset)", ["asset", "n_bars"], ["total_return", "annual_return", "max_drawdown"])


def rolling_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.folds(returns(spark, sf_dir), n_folds=6, min_train=100, gap=10, rolling=True)


def _rolling_folds_sql() -> str:
    n = f"SELECT asset, count(*) AS n, greatest((count(*) - 100) // 6, 1) AS size FROM (SELECT asset FROM (SELECT asset, close / lag(close) OVER ({S}) - 1 AS ret FROM ({BARS})) WHERE ret IS NOT NULL) GROUP BY 1"
    return f"SELECT asset, CAST(fold AS INT) AS fold, fold * size AS train_start, 100 + fold * size AS train_end, 110 + fold * size AS test_start, 110 + fold * size + size AS test_end, CAST(100 + fold * size - greatest(floor(100 * 0.15), 1) AS BIGINT) AS val_start FROM ({n}), range(6) t(fold) WHERE 110 + fold * size + size <= n"


def article_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of articles as one: documents and pages' titles, by source."""
    words = lambda c: text.sentiment(c, ["license", "version", "the", "und"], ["token", "les", "des"])
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("symbol"), words("text").alias("score"))
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("symbol"), words("text").alias("score"))
    return builders.mood(docs.unionAll(turns))


def _mood_sql() -> str:
    score = "coalesce(round((u - d) / nullif(u + d, 0), 3), 0)"
    one = lambda t, key: f"SELECT {key} AS symbol, {score} AS score FROM (SELECT {key}, len(list_intersect(ws, ['license', 'version', 'the', 'und'])) AS u, len(list_intersect(ws, ['token', 'les', 'des'])) AS d FROM (SELECT {key}, list_distinct(regexp_split_to_array(lower(text), '\\W+')) AS ws FROM {t}))"
    return f"SELECT symbol, count(*) AS n_articles, round(avg(score), 3) AS score, CASE WHEN avg(score) > 0.05 THEN 'bullish' WHEN avg(score) < -0.05 THEN 'bearish' ELSE 'neutral' END AS label FROM ({one('documents', 'source')} UNION ALL {one('conversations', 'role')}) GROUP BY 1"


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    return {
        "candidates_normalised": (normalised, NORMALISED),
        "connector_proposals": (proposed, _proposed_sql()),
        "source_claims": (source_claims, SOURCE_CLAIMS),
        "source_evidence": (source_evidence, SOURCE_EVIDENCE),
        "fold_claims": (fold_claims, _fold_claims_sql()),
        "relationship_claims": (relationship_claims, RELATIONSHIP_CLAIMS),
        "probe_summary": (probe_summary, PROBE_SUMMARY),
        "probe_evidence": (probe_evidence, PROBE_EVIDENCE),
        "evidence_of_type": (evidence_of_type, EVIDENCE_OF_TYPE),
        "sector_edges": (classified, CLASSIFIED),
        "report_edges": (reports, REPORTS),
        "knowledge_edges": (knowledge, _knowledge_sql()),
        "correlation_partners": (partners, PARTNERS),
        "weighed_edges": (weighed, WEIGHED),
        "graph_counts": (counted, COUNTED),
        "trigger_edges": (triggered, "SELECT event_type AS dst, 'TRIGGERED_BY' AS rel, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1"),
        "base_features_summary": (base_summary, _base_sql()),
        "clean_bars": (clean_bars, _clean_sql()),
        "composite_scores": (experiments, COMPOSITE),
        "series_provenance": (provenance, PROVENANCE),
        "feature_colours": (coloured, picked(f"SELECT asset, ts, greatest(least((close - 1000) / 1003 * 2 - 1, 1), -1) AS ranged, (exp(2 * (close / 1003 - 1.5)) - 1) / (exp(2 * (close / 1003 - 1.5)) + 1) AS squashed FROM ({BARS})", ["asset", "ts"], ["ranged", "squashed"])),
        "named_symbols": (named_symbols, NAMED_SYMBOLS),
        "shown_features": (shown, _shown_sql()),
        "rolling_probability": (rolling_probability, _rolling_sql()),
        "backtest_short": (short_backtest, _short_sql()),
        "rolling_folds": (rolling_folds, _rolling_folds_sql()),
        "article_mood": (article_mood, _mood_sql()),
        "significant_exposures": (significant, None),
    }
