"""Queries of lists, windows of events, exported tensors, registers as files, and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import discovery, features, filters, intelligence, mentions, records, scores
from tidemark.plans.catalogue import NORMALISED, SCORED, scored_candidates
from tidemark.plans.feeding import OBSERVATIONS, observations
from tidemark.plans.listing import DISCOVERIES, discoveries
from tidemark.plans.market import bars, rounded
from tidemark.plans.modelling import brand_closes
from tidemark.plans.registry import TENSORS
from tidemark.plans.registry import tensors as graph_tensors
from tidemark.plans.sql import BARS, S, picked
from tidemark.sources import registries, sinks
from tidemark.sources.tables import table

TODAY = "1996-06-15"


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as reports of parts in a window of days, of parts of a size, with how far they are off."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber")
    universe = table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("symbol"))
    near = records.due(found, TODAY, universe=universe)
    return near.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


DUE = f"SELECT l_partkey AS symbol, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 10 AND CAST(l_shipdate AS DATE) BETWEEN DATE '{TODAY}' - 7 AND DATE '{TODAY}' + 14 GROUP BY 1"


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest mean price of each nation for the first four of six priorities and states."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("country")), "o_custkey")
    values = orders.groupBy("country", F.col("o_orderpriority").alias("indicator"), F.trunc("o_orderdate", "year").alias("ts")).agg(F.avg("o_totalprice").alias("value"))
    return rounded(records.context(values, ["5-LOW", "1-URGENT", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]), ["country", "indicator", "ts"], ["value"])


CONTEXT = picked("SELECT country, indicator, ts, value FROM (SELECT c_nationkey AS country, o_orderpriority AS indicator, CAST(date_trunc('year', o_orderdate) AS DATE) AS ts, avg(o_totalprice) AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY country, indicator ORDER BY ts DESC) = 1", ["country", "indicator", "ts"], ["value"])


def window_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 300 bars of each asset as inputs of a model; a half year in a short series is padded."""
    made = bars(spark, sf_dir).where("asset <> 'NF' or ts >= '2001-06-01'")
    step = features.returns(made, (1,)).select("asset", "ts", "ret_1d", (F.col("volume") / 100).alias("volume"), (F.col("high") / F.col("low")).alias("range"))
    found = records.window_tensors(step, ["ret_1d", "volume", "range"], 300)
    total = lambda k: F.aggregate("tensor", F.lit(0.0), lambda s, r: s + r[k])
    return rounded(found.select("asset", "n_real", F.size("tensor").alias("steps"), total(0).alias("ret"), total(1).alias("volume"), total(2).alias("range"), F.element_at("tensor", -1)[2].alias("last")), ["asset", "n_real", "steps"], ["ret", "volume", "range", "last"])


WINDOW_TENSORS = picked(f"SELECT asset, CAST(count(*) AS INT) AS n_real, CAST(300 AS INT) AS steps, sum(coalesce(ret, 0)) AS ret, sum(volume / 100) AS volume, sum(high / low) AS range, arg_max(high / low, ts) AS last FROM (SELECT *, close / lag(close) OVER ({S}) - 1 AS ret, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS k FROM ({BARS}) WHERE asset <> 'NF' OR ts >= DATE '2001-06-01') WHERE k <= 300 GROUP BY 1", ["asset", "n_real", "steps"], ["ret", "volume", "range", "last"])


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's tensors written to a file and read again, by type."""
    path = sinks.new_folder(spark, "tensors")
    graph_tensors(spark, sf_dir).write.partitionBy("type").parquet(path)
    return rounded(spark.read.parquet(path).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"), F.sum("weight").alias("weight")), ["type", "n", "n_src"], ["weight"])


def kept_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings appended to a table by run, numbers to six places, and read again."""
    path = sinks.new_folder(spark, "discoveries")
    sinks.append(rounded(discoveries(spark, sf_dir), ["a", "b", "run_id", "strength"], ["pearson_r", "granger_p"]), path, ["run_id"])
    return spark.read.parquet(path).groupBy("run_id", "strength").agg(F.count("*").alias("n"), F.round(F.sum("pearson_r"), 3).alias("r"))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates kept as a register of JSON: written, changed and read again."""
    path, schema = sinks.new_folder(spark, "register"), "source_id string, category string, cadence string, problem string"
    made = scored_candidates(spark, sf_dir).select("source_id", "category", "cadence", "problem")
    registries.rewritten(made, path)
    registries.rewritten(registries.current(spark, path, schema).withColumn("cadence", F.upper("cadence")), path)
    return registries.current(spark, path, schema)


def daily_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a cadence that offer a type of data."""
    found = filters.matching(scored_candidates(spark, sf_dir), {"cadence": "daily"}, {"data_types": "ohlcv"})
    return found.select("source_id", "category")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty candidates of the highest score."""
    return rounded(filters.ordered(scored_candidates(spark, sf_dir).where("problem is null").withColumn("s", F.round("score", 9)), "s", tie="source_id", limit=20), ["source_id"], ["score"])


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a universe with how many members they have and the first three."""
    made = table(spark, sf_dir, "part").select(F.split("p_type", " ")[0].alias("class"), F.col("p_name").alias("member"), "p_partkey")
    k = F.row_number().over(Window.partitionBy("class").orderBy("member", "p_partkey"))
    return made.withColumn("k", k).groupBy("class").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "member")))), lambda r: r["member"]), "; ").alias("first"))


UNIVERSE = "SELECT class, count(*) AS n, string_agg(CASE WHEN k <= 3 THEN p_name END, '; ' ORDER BY k) AS first FROM (SELECT *, split_part(p_type, ' ', 1) AS class, row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY p_name, p_partkey) AS k FROM part) GROUP BY 1"


def odd_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest anomalies of each asset's closes among its last 252, by their size."""
    found = intelligence.rolling_anomalies(bars(spark, sf_dir).select(F.col("asset").alias("node"), "ts", F.col("close").alias("value")), threshold=1.5)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.round(F.abs("z"), 9)), "ts"))
    return rounded(found.withColumn("rank", rank).where("rank <= 10"), ["node", "ts", "rank"], ["z"])


ODD_NODES = picked(f"SELECT node, ts, CAST(rank AS INT) AS rank, z FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(abs(z), 9) DESC, ts) AS rank FROM (SELECT asset AS node, ts, count(close) OVER w AS seen, (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) AS z FROM ({BARS}) WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE seen >= 20 AND abs(z) > 1.5) WHERE rank <= 10", ["node", "ts", "rank"], ["z"])


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and tests of each page's address."""
    url = scores.plain_url("url")
    return table(spark, sf_dir, "pages").select("page_id", F.upper(F.substring(url, 1, 5)).alias("head"), F.replace(url, F.lit("https://"), F.lit("")).alias("bare"), F.startswith(url, F.lit("https")).alias("safe"), F.endswith(url, F.lit(".html")).alias("is_html"), F.length(F.trim("url")).alias("n"), F.initcap(F.element_at(F.split(url, "/"), -1)).alias("title"))


ADDRESSES = "SELECT page_id, upper(u[1:5]) AS head, replace(u, 'https://', '') AS bare, starts_with(u, 'https') AS safe, ends_with(u, '.html') AS is_html, CAST(length(trim(url)) AS INT) AS n, upper(p[1:1]) || lower(p[2:]) AS title FROM (SELECT *, list_last(string_split(u, '/')) AS p FROM (SELECT *, regexp_replace(lower(trim(url)), '/+$', '') AS u FROM pages))"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols named in notes on parts: with a sign, and after a word."""
    word = F.substring(F.upper("p_type"), 1, 4)
    note = F.concat(F.lit("The stock "), word, F.lit(" rose, $"), F.substring(F.upper("p_type"), 1, 3), F.lit(" too; shares CEO and ticker lower"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), note.alias("text"))
    return mentions.symbols(docs).groupBy("symbol").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


SYMBOLS = "SELECT symbol, count(*) AS n, min(p_partkey) AS first FROM (SELECT DISTINCT p_partkey, unnest([upper(p_type)[1:4], upper(p_type)[1:3]]) AS symbol FROM part) WHERE regexp_full_match(symbol, '[A-Z]{1,5}') GROUP BY 1"


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the digest of the set of columns of some tables."""
    one = lambda n, df: df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.lit(scores.columns_digest(df)).alias("digest"))
    made = [one(n, table(spark, sf_dir, n)) for n in ("orders", "customer", "events", "documents")]
    return made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])


DIGESTS = " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n, sha256((SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE SELECT * FROM {n}))) AS digest" for n in ("orders", "customer", "events", "documents"))


def factor_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' monthly returns on the changes of the eight factor groups, which the first eight monthly series stand for."""
    monthly = observations(spark, sf_dir).where("indicator not like '%/P'")
    names = monthly.select("indicator").distinct().withColumn("i", F.row_number().over(Window.orderBy("indicator")))  # a handful of series
    group = F.element_at(F.array(*map(F.lit, records.FACTORS)), F.col("i"))
    factors = monthly.join(F.broadcast(names.where(F.col("i") <= len(records.FACTORS))), "indicator").select(group.alias("factor"), "ts", (F.col("value") / 100000).alias("value"))
    closes = brand_closes(spark, sf_dir).groupBy("asset", F.trunc("ts", "month").alias("ts")).agg(F.avg("close").alias("close"))
    rets = features.returns(closes, (1,)).select("asset", "ts", F.col("ret_1d").alias("ret")).dropna()
    return rounded(records.factor_exposures(rets, factors), ["asset", "factor", "n"], ["beta", "r2"])


def _exposures_sql() -> str:
    from tidemark.plans.modelling import BRAND_CLOSES

    groups = "[" + ", ".join(f"'{g}'" for g in records.FACTORS) + "]"
    monthly = f"SELECT * FROM ({OBSERVATIONS}) WHERE indicator NOT LIKE '%/P'"
    factors = f"SELECT ({groups})[i] AS factor, ts, (value - lag(value) OVER (PARTITION BY indicator ORDER BY ts)) / 100000 AS x FROM (SELECT *, dense_rank() OVER (ORDER BY indicator) AS i FROM ({monthly})) WHERE i <= {len(records.FACTORS)}"
    rets = f"SELECT asset, ts, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM (SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS ts, avg(close) AS close FROM ({BRAND_CLOSES}) GROUP BY 1, 2)"
    return picked(f"SELECT asset, factor, count(*) AS n, regr_slope(ret, x) AS beta, regr_r2(ret, x) AS r2 FROM ({rets}) JOIN ({factors}) USING (ts) WHERE ret IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 24", ["asset", "factor", "n"], ["beta", "r2"])


def top_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the components of the bars' features are made of."""
    made = bars(spark, sf_dir).transform(features.returns).transform(features.volatility)
    names = ["ret_1d", "ret_5d", "ret_21d", "realized_vol_5d", "realized_vol_21d", "atr_ratio"]
    return rounded(records.top_loadings(discovery.components(made, names, 3), 2), ["component", "side", "place", "column"], ["loading"])


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    return {
        "reports_due": (due, DUE),
        "country_context": (context, CONTEXT),
        "window_tensors": (window_tensors, WINDOW_TENSORS),
        "exported_tensors": (exported, f"SELECT type, count(*) AS n, count(DISTINCT src) AS n_src, round(sum(weight), 6) AS weight FROM ({TENSORS}) GROUP BY 1"),
        "kept_discoveries": (kept_discoveries, f"SELECT run_id, strength, count(*) AS n, round(sum(round(pearson_r, 6)), 3) AS r FROM ({DISCOVERIES}) GROUP BY 1, 2"),
        "json_register": (register, f"SELECT source_id, category, upper(cadence) AS cadence, problem FROM ({NORMALISED})"),
        "daily_sources": (daily_sources, f"SELECT source_id, category FROM ({NORMALISED}) WHERE cadence = 'daily' AND data_types LIKE '%ohlcv%'"),
        "best_candidates": (best_candidates, f"SELECT source_id, round(score, 6) + 0.0 AS score FROM ({SCORED}) ORDER BY round(score, 9) DESC, source_id LIMIT 20"),
        "universe_by_class": (universe, UNIVERSE),
        "largest_anomalies": (odd_nodes, ODD_NODES),
        "page_addresses": (addresses, ADDRESSES),
        "symbols_in_notes": (symbols, SYMBOLS),
        "column_digests": (digests, DIGESTS),
        "group_exposures": (factor_exposures, _exposures_sql()),
        "top_loadings": (top_loadings, None),
    }
