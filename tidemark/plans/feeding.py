"""Queries of feeds: macro series with checks and scores, company facts, profiles, and runs of connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.market import bars, rounded
from tidemark.plans.sql import BARS, picked
from tidemark.sources import feeds, payloads
from tidemark.sources.sinks import new_folder
from tidemark.sources.tables import table
from tidemark.streaming import sinks

AS_OF = "1998-12-01"
#: How often each series is published, by its priority.
OFTEN = {"1-URGENT": "daily", "2-HIGH": "weekly", "3-MEDIUM": "monthly", "4-NOT SPECIFIED": "quarterly", "5-LOW": "event"}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(indicator, ts, value): a series for each priority and status, the mean price of its orders each month (P: of each day)."""
    day = F.to_date("o_orderdate")
    ts = F.when(F.col("o_orderstatus") == "P", day).otherwise(F.trunc("o_orderdate", "month"))
    return table(spark, sf_dir, "orders").groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("indicator"), ts.alias("ts")).agg(F.avg("o_totalprice").alias("value"))


OBSERVATIONS = "SELECT o_orderpriority || '/' || o_orderstatus AS indicator, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wanted, by JSON answers that describe each series; one has no observations."""
    names = observations(spark, sf_dir).select("indicator").distinct().unionAll(spark.createDataFrame([("none/X",)], "indicator string"))
    often = F.coalesce(*(F.when(F.col("indicator").startswith(k), v.upper()) for k, v in OFTEN.items()), F.lit("Daily"))
    entry = F.struct(F.col("indicator").alias("id"), F.concat(F.lit("Orders "), "indicator").alias("title"), F.lit("usd").alias("units"), often.alias("frequency"), F.lit("1998-12-01").alias("last_updated"))
    return feeds.described(names.select(F.to_json(F.struct(F.array(entry).alias("seriess"))).alias("body")))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.ingested(observations(spark, sf_dir), series(spark, sf_dir), AS_OF)


def _ingested_sql() -> str:
    often = f"CASE split_part(indicator, '/', 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in OFTEN.items())} ELSE 'daily' END"
    found = f"SELECT indicator, {often} AS frequency, count(ts) AS n, min(ts) AS a, max(ts) AS b FROM (SELECT * FROM ({OBSERVATIONS}) UNION ALL SELECT 'none/X', NULL, NULL) GROUP BY 1"
    least = "CASE frequency WHEN 'event' THEN 2 WHEN 'monthly' THEN 10 WHEN 'quarterly' THEN 5 ELSE 10 END"
    stale = "CASE WHEN frequency IN ('event', 'monthly', 'quarterly') THEN 100 ELSE 10 END"
    return f"SELECT indicator, CASE frequency WHEN 'daily' THEN 'd' WHEN 'weekly' THEN 'w' WHEN 'monthly' THEN 'm' WHEN 'quarterly' THEN 'q' END AS code, n AS n_fetched, CASE WHEN n >= {least} THEN n ELSE 0 END AS n_written, CASE WHEN n >= {least} THEN a END AS first, CASE WHEN n >= {least} THEN b END AS last, CASE WHEN n = 0 THEN 'empty' WHEN n < {least} THEN '1 checks failed' END AS error, date_diff('day', b, DATE '{AS_OF}') > {stale} AS stale FROM ({found})"


def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored observations, kept by series in a table that is written twice: the second time with the last years again."""
    path, made = new_folder(spark, "macro"), feeds.scored(observations(spark, sf_dir), {"z_1y": 24, "z_3y": 48}).withColumns({"part": sinks.bucket("indicator", 4), "version": F.lit(1)})
    keys = ["indicator", "ts", "part"]
    sinks.upsert_partitions(made.withColumn("value", F.when(F.col("ts") >= "1997-01-01", 0.0).otherwise(F.col("value"))), path, keys, ["version"], "part")
    sinks.upsert_partitions(made.where("ts >= '1997-01-01'").withColumn("version", F.lit(2)), path, keys, ["version"], "part")
    return rounded(spark.read.parquet(path), ["indicator", "ts", "z_1y", "z_3y"], ["value"])


def _scores_sql() -> str:
    z = lambda n: f"CASE WHEN count(value) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = least({n}, all_) AND all_ > 1 THEN round(coalesce((value - avg(value) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) / nullif(stddev_samp(value) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0), 0), 3) + 0.0 END"
    return f"SELECT indicator, ts, {z(24)} AS z_1y, {z(48)} AS z_3y, round(value, 6) + 0.0 AS value FROM (SELECT *, count(value) OVER (PARTITION BY indicator) AS all_ FROM ({OBSERVATIONS})) WINDOW w AS (PARTITION BY indicator ORDER BY ts)"


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feeds.recent(observations(spark, sf_dir), "1995-01-01", "1998-01-01", 12), ["indicator", "ts"], ["value"])


#: Concepts and units that stand for line numbers and flags of order lines.
AS_CONCEPTS = ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "Assets", "LongTermDebt", "LongTermDebtNoncurrent", "EarningsPerShareBasic", "NoSuchConcept")


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = F.element_at(F.array(*map(F.lit, AS_CONCEPTS)), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    unit = F.when(F.col("l_returnflag") == "A", "shares").when(F.col("l_returnflag") == "R", "USD").otherwise("EUR")
    form = F.when(F.col("l_quantity") > 25, "10-K").when(F.col("l_quantity") > 10, "10-Q").otherwise("8-K")
    facts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey") % 97).alias("symbol"), concept.alias("concept"), unit.alias("unit"), F.last_day("l_shipdate").alias("end"), F.col("l_extendedprice").alias("val"), form.alias("form"), F.to_date("l_shipdate").alias("filed"))
    return feeds.company_facts(facts)


def _facts_sql() -> str:
    names = "[" + ", ".join(f"'{feeds.CONCEPTS.get(c, '')}'" for c in AS_CONCEPTS) + "]"
    places = "[" + ", ".join(str(list(feeds.CONCEPTS).index(c)) if c in feeds.CONCEPTS else "-1" for c in AS_CONCEPTS) + "]"
    rows = f"SELECT 'S' || l_suppkey % 97 AS symbol, ({names})[(l_linenumber - 1) % 7 + 1] AS label, ({places})[(l_linenumber - 1) % 7 + 1] AS place, CASE l_returnflag WHEN 'R' THEN 1 ELSE 3 END AS u, last_day(l_shipdate) AS \"end\", l_extendedprice AS val, CASE WHEN l_quantity > 25 THEN '10-K' ELSE '10-Q' END AS form, CAST(l_shipdate AS DATE) AS filed FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity > 10"
    kept = f"SELECT * FROM ({rows}) WHERE label <> '' QUALIFY (place, -u) = max((place, -u)) OVER (PARTITION BY symbol, label)"
    return f"SELECT symbol, label, \"end\", r.val AS val, r.filed AS filed, r.form AS form FROM (SELECT symbol, label, \"end\", max({{'filed': filed, 'val': val, 'form': form}}) AS r FROM ({kept}) GROUP BY 1, 2, 3)"


def ciks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names against a directory of suppliers' with the same number."""
    tickers = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("symbol"))
    directory = table(spark, sf_dir, "supplier").select(F.concat(F.lit("K"), "s_suppkey").alias("ticker"), (F.col("s_suppkey") * 31).alias("cik_str"))
    return feeds.with_ciks(tickers, directory)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies: key figures from JSON, the last four orders as reports, the six largest as holders, entries of a feed."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    symbol = F.col("c_custkey").cast("string").alias("symbol")
    info = customers.select(symbol, F.to_json(F.struct(F.col("c_acctbal").alias("marketCap"), F.col("c_nationkey").alias("beta"), F.col("c_name").alias("ebitda"))).alias("body"))
    stats = feeds.key_stats(info).select("symbol", F.lit(1).alias("place"), "market_cap", "beta", "ebitda", "52w_low")
    mine = orders.select(F.col("o_custkey").cast("string").alias("symbol"), "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    eps = feeds.first_rows(mine, "symbol", [F.desc("day"), "o_orderkey"], 4)
    holders = feeds.first_rows(mine, "symbol", [F.desc("o_totalprice"), "o_orderkey"], 6)
    entry = F.concat(F.lit('<entry><category scheme="x" term="'), "o_orderpriority", F.lit('"/>\n<updated>'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00</updated><filing-href> u/"), "o_orderkey", F.lit(" </filing-href></entry>"))
    atom = orders.groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
    made = feeds.profiles(customers.select(symbol), {"stats": stats, "eps": eps, "holders": holders, "filings": feeds.atom_filings(atom, 4)})
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return made.select("symbol", F.col("stats")[0]["market_cap"].alias("market_cap"), F.col("stats")[0]["beta"].alias("beta"), F.col("stats")[0]["ebitda"].alias("ebitda"), joined("eps", lambda r: r["o_orderkey"].cast("string")).alias("eps"), joined("holders", lambda r: r["o_orderkey"].cast("string")).alias("holders"), joined("filings", lambda r: F.concat_ws(" ", r["form"], r["filed"].cast("string"), r["url"])).alias("filings"))


PROFILES = """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS p, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS f FROM orders),
 e AS (SELECT c, string_agg(k, ',' ORDER BY r) AS eps FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC, k) AS r FROM o) WHERE r <= 4 GROUP BY 1),
 h AS (SELECT c, string_agg(k, ',' ORDER BY r) AS holders FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p DESC, k) AS r FROM o) WHERE r <= 6 GROUP BY 1),
 a AS (SELECT c, string_agg(f || ' ' || d || ' u/' || k, ',' ORDER BY r) AS filings FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) AS r FROM o) WHERE r <= 4 GROUP BY 1)
 SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_acctbal AS market_cap, CAST(c_nationkey AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS ebitda, coalesce(eps, '') AS eps, coalesce(holders, '') AS holders, coalesce(filings, '') AS filings FROM customer LEFT JOIN e ON e.c = c_custkey LEFT JOIN h ON h.c = c_custkey LEFT JOIN a ON a.c = c_custkey"""


def training_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bars of a raw pull in a zone of its own, without a volume in March."""
    price, at = F.col("o_totalprice"), F.col("o_orderdate")
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Key"), (at + F.expr("INTERVAL 1 HOUR")).alias("Date"), price.alias("Open"), price.alias("Close"), F.when(F.month(at) != 3, price / 10).alias("Volume"))
    return payloads.training_bars(raw, "Date", "+02:00").groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("close"))


TRAINING_BARS = "SELECT CAST(o_orderdate AS DATE) - 1 AS date, count(*) AS n, round(sum(o_totalprice), 2) AS close FROM orders WHERE month(o_orderdate) <> 3 GROUP BY 1"


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of two connectors: macro series, and bars of assets that need a year of days."""
    prices = bars(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n_written"), F.when(F.count("*") < 800, "too few").alias("error"))
    return feeds.run_summary({"macro": ingested(spark, sf_dir), "prices": prices})


def _run_sql() -> str:
    each = f"SELECT 'macro' AS connector, count(*) AS n_series, count(error) AS n_failed, coalesce(sum(n_written) FILTER (WHERE error IS NULL), 0) AS n_written FROM ({_ingested_sql()}) UNION ALL SELECT 'prices', count(*), count(*) FILTER (WHERE n < 800), coalesce(sum(n) FILTER (WHERE n >= 800), 0) FROM (SELECT asset, count(*) AS n FROM ({BARS}) GROUP BY 1)"
    return f"WITH e AS ({each}) SELECT connector, CAST(n_series AS BIGINT) AS n_series, CAST(n_failed AS BIGINT) AS n_failed, CAST(n_written AS BIGINT) AS n_written FROM (SELECT * FROM e UNION ALL SELECT 'total', sum(n_series), sum(n_failed), sum(n_written) FROM e)"


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.planned({"macro": series(spark, sf_dir).select(F.col("indicator").alias("name")), "parts": table(spark, sf_dir, "part").select(F.col("p_type").alias("name"))}, 3)


PLANNED = f"""SELECT 'parts' AS connector, count(DISTINCT p_type) AS n, (SELECT string_agg(t, ', ' ORDER BY t) FROM (SELECT DISTINCT p_type AS t FROM part ORDER BY 1 LIMIT 3)) AS first FROM part
 UNION ALL SELECT 'macro', count(DISTINCT i), (SELECT string_agg(t, ', ' ORDER BY t) FROM (SELECT DISTINCT indicator AS t FROM ({OBSERVATIONS}) ORDER BY 1 LIMIT 3)) FROM (SELECT indicator AS i FROM ({OBSERVATIONS}) UNION ALL SELECT 'none/X')"""


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    return {
        "macro_ingest": (ingested, _ingested_sql()),
        "training_bars": (training_bars, TRAINING_BARS),
        "macro_scores": (macro_scores, _scores_sql()),
        "macro_recent": (recent, picked(f"SELECT * FROM ({OBSERVATIONS}) WHERE ts BETWEEN DATE '1995-01-01' AND DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY ts DESC) <= 12", ["indicator", "ts"], ["value"])),
        "company_facts": (company_facts, _facts_sql()),
        "ticker_ciks": (ciks, "SELECT 'k' || c_custkey AS symbol, lpad(CAST(s_suppkey * 31 AS VARCHAR), 10, '0') AS cik FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"),
        "company_profiles": (profiles, PROFILES),
        "connector_run": (run_summary, _run_sql()),
        "connector_plan": (planned, PLANNED),
    }
