"""Queries over landed payloads: bodies are made of the tables, parsed again, and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.market import bars, rounded
from tidemark.plans.sql import BARS, MACRO, picked
from tidemark.sources import payloads, tables

OHLC = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.macro(table(spark, sf_dir, "lineitem"))


def ohlc_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = F.array((F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).cast("double"), *OHLC)
    raw = bars(spark, sf_dir).groupBy("asset").agg(F.to_json(F.collect_list(bar)).alias("body"))
    return payloads.ohlc_arrays(raw).withColumn("ts", F.to_date("ts"))


def daily_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.struct(F.col("ts").cast("string").alias("k"), F.struct(*(F.col(c).cast("string").alias(c) for c in OHLC), F.col("volume").cast("string").alias("volume")).alias("v"))
    raw = bars(spark, sf_dir).groupBy("asset").agg(F.to_json(F.map_from_entries(F.collect_list(day))).alias("body"))
    return payloads.daily_map(raw)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("ts").cast("string").alias("date"), F.when(F.month("ts") % 4 == 0, ".").otherwise(F.col("value").cast("string")).alias("value"))
    raw = series(spark, sf_dir).groupBy("indicator").agg(F.to_json(F.collect_list(one)).alias("body"))
    return payloads.observations(raw)


def sdmx(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.month("ts") == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM"))
    line = F.concat_ws(",", F.lit("K"), t, F.when(F.month("ts") == 6, "").when(F.month("ts") == 7, "n/a").otherwise(F.col("value").cast("string")))
    raw = series(spark, sf_dir).groupBy("indicator").agg(F.concat(F.lit("KEY,TIME_PERIOD,OBS_VALUE\r\n"), F.array_join(F.collect_list(line), "\r\n")).alias("body"))
    return payloads.sdmx(raw)


def country_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.struct(F.col("n_name").alias("id")).alias("country"), F.lit("1998").alias("date"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") * 1.5).alias("value"))
    raw = table(spark, sf_dir, "nation").agg(F.lit("gdp").alias("indicator"), F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list(one), {"ignoreNullFields": "false"}), F.lit("]")).alias("body"))
    return payloads.country_values(raw, ["FRANCE", "GERMANY", "JAPAN", "NATION_1", "NATION_2", "NATION_5", "CHINA"])


def _xml(spark: SparkSession, sf_dir: str, block, head) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("symbol")).agg(F.concat(F.lit("<doc>"), head, F.array_join(F.collect_list(block), "\n"), F.lit("</doc>")).alias("body"))


def info_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("<ns1:infoTable>\n<ns1:nameOfIssuer> "), "s_name", F.lit(" </ns1:nameOfIssuer><ns1:value>"), F.format_number("s_suppkey", 0), F.lit(",000</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>"), F.col("s_suppkey").cast("string"), F.lit("</ns1:sshPrnamt></ns1:shrsOrPrnAmt></ns1:infoTable>"))
    return payloads.info_tables(_xml(spark, sf_dir, block, F.lit("")))


def insider_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda tag, x: F.concat(F.lit(f"<{tag}>\n <value>"), x, F.lit(f"</value></{tag}>"))
    code = F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("D")
    block = F.concat(F.lit("<nonDerivativeTransaction>"), value("transactionShares", F.col("s_suppkey").cast("string")), value("transactionPricePerShare", F.lit("12.5")), value("transactionAcquiredDisposedCode", code), F.lit("</nonDerivativeTransaction>"))
    return payloads.insider_trades(_xml(spark, sf_dir, block, F.lit("<rptOwnerName> Owner </rptOwnerName>")))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("symbol"), F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "8-K").otherwise("10-Q").alias("form"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accession"))
    raw = made.groupBy("symbol").agg(F.collect_list(F.struct("form", "filed", "accession")).alias("x")).select("symbol", *(F.col(f"x.{c}").alias(c) for c in ("form", "filed", "accession")))
    return payloads.filings(raw, ["10-K", "10-Q"])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("symbol"), F.col("l_returnflag").alias("label"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("unit_rank"), F.trunc("l_shipdate", "quarter").alias("end"), F.to_date("l_shipdate").alias("filed"), F.col("l_extendedprice").alias("val"), F.when(F.col("l_linenumber") % 3 == 0, "8-K").otherwise("10-Q").alias("form"))
    return payloads.latest_facts(made)


FACTS = "SELECT CAST(l_suppkey % 10 AS VARCHAR) AS symbol, l_returnflag AS label, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS unit_rank, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS \"end\", CAST(l_shipdate AS DATE) AS filed, l_extendedprice AS val FROM lineitem WHERE l_linenumber % 3 <> 0"


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports of customers: the price is what came, a round estimate what was thought."""
    made = table(spark, sf_dir, "orders").where(F.to_date("o_orderdate").between("1996-06-08", "1996-06-29"))
    made = made.join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    raw = made.select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 100).alias("eps"), F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") / 10000) * 100).cast("double").alias("eps_estimate"))
    return payloads.earnings(raw).select("event_id", "eps_surprise", "eps_surprise_pct", "has_actuals")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even and odd keys as two feeds."""
    orders = table(spark, sf_dir, "orders")
    house = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderpriority").alias("symbol"), F.col("o_custkey").cast("string").alias("member"), F.to_date("o_orderdate").alias("traded"), F.col("o_totalprice").alias("amount"))
    senate = orders.where("o_orderkey % 2 = 1").select(F.col("o_orderpriority").alias("symbol"), F.col("o_custkey").cast("string").alias("member"), F.to_date("o_orderdate").alias("traded"), F.col("o_orderstatus").alias("kind"))
    return payloads.trades_of_both(house, senate)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select(F.col("ts").alias("created"), F.concat(F.lit("about "), "event_type").alias("title"), (F.col("user_id") % 10 - 2).alias("votes"), (F.col("value") / 100 - 0.4).alias("sentiment"))
    return rounded(payloads.post_sentiment(made, "2024-01-20 12:00:00", "click"), ["mentions", "label"], ["score"])


POSTS = "SELECT value / 100 - 0.4 AS s, greatest(user_id % 10 - 2, 1) AS w FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-19 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00' AND contains(upper('about ' || event_type), 'CLICK')"


def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(payloads.interest(series(spark, sf_dir).withColumnRenamed("indicator", "term")), ["term", "trend"], ["mean", "current", "recent"])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = F.when(F.col("value") > 55, F.lit('{"basic":"Bullish"}')).when(F.col("value") < 45, F.lit('{"basic":"Bearish"}')).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"entities":{"sentiment":'), mood, F.lit("}}"))
    return rounded(payloads.message_ratio(table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), body.alias("body"))), ["symbol", "bulls", "bears", "label"], ["ratio"])


def mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.when(F.col("value") > 40, "bullish").when(F.col("value") < 20, "bearish").alias("label"))
    return rounded(payloads.composite_mood(labels), ["symbol", "overall"], ["score"])


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.when(F.col("p_partkey") % 3 == 0, "put").otherwise("call").alias("kind"), F.col("p_size").alias("volume"), (F.col("p_retailprice") / 4001).alias("iv"), (F.col("p_size") + 5).alias("days"))
    made = payloads.options_summary(chain).withColumn("signal", payloads.put_call_signal("ratio"))
    return rounded(made, ["symbol", "calls", "puts", "days", "signal"], ["iv", "ratio", "implied_move"])


OPTIONS = "SELECT p_brand AS symbol, CAST(sum(CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END) AS BIGINT) AS puts, CAST(min(p_size + 5) AS INT) AS days, quantile_cont(p_retailprice / 4001, 0.5) AS iv FROM part GROUP BY 1"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.concat(F.lit("http://x/"), "p_partkey").alias("link"), F.lit("5").alias("providerPublishTime"))
    nested = F.struct(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.struct(F.concat(F.lit("http://y/"), "p_partkey").alias("url")).alias("canonicalUrl"), F.lit("6").alias("pubDate")).alias("content"))
    body = F.when(F.col("p_partkey") % 3 == 0, F.to_json(named)).when(F.col("p_partkey") % 3 == 1, F.to_json(nested)).otherwise(F.lit('{"other": 1}'))
    return payloads.news(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), body.alias("body")), 8)


def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of one of five kinds for each customer, of the customer's orders."""
    one = F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("k"))
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("x"))
    lines = lambda f: F.array_join(F.transform("x", f), "\n")
    key = F.col("o_custkey") % 5
    body = F.when(key == 0, F.to_json("x")).when(key == 1, lines(lambda r: F.to_json(r))).when(key == 2, F.concat(F.lit('{"meta": {"a": 1}, "data": '), F.to_json("x"), F.lit("}"))).when(key == 3, F.concat(F.lit("name,k\n"), lines(lambda r: F.concat_ws(",", r["name"], r["k"])))).otherwise(F.lit("plain words"))
    found = payloads.sniffed(made.select(F.col("o_custkey").alias("id"), body.alias("body")), 3)
    return found.select("id", "format", F.size("rows").alias("n"), F.size(F.filter("rows", lambda r: r["name"].isNotNull() & r["k"].isNotNull())).alias("whole"))


SNIFFED = """SELECT id, CASE WHEN n = 0 THEN 'unknown' ELSE (['json', 'ndjson', 'json_object', 'csv', 'unknown'])[id % 5 + 1] END AS format, n, n AS whole
 FROM (SELECT o_custkey AS id, CAST(CASE WHEN o_custkey % 5 = 4 OR (o_custkey % 5 = 1 AND count(*) = 1) THEN 0 ELSE least(count(*), 3) END AS INT) AS n FROM orders GROUP BY 1)"""
#: The kind of event that an order's priority stands for.
KINDS = {"1-URGENT": "FOMC", "2-HIGH": "CPI", "3-MEDIUM": "NFP"}


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each priority and month as a known date."""
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in KINDS.items()), F.lit("OTHER"))
    known = table(spark, sf_dir, "orders").groupBy(kind.alias("kind"), F.trunc("o_orderdate", "month").alias("m")).agg(F.min(F.to_date("o_orderdate")).alias("date")).drop("m")
    return payloads.macro_calendar(spark, 1996, known)


def _calendar_sql() -> str:
    rule = " UNION ALL ".join(f"SELECT '{k}' AS kind, make_date(1996, m, {d}) AS date FROM (SELECT unnest({list(months)}) AS m)" for k, months, d in payloads.RULES)
    kind = f"CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'OTHER' END"
    known = f"SELECT {kind} AS kind, CAST(min(o_orderdate) AS DATE) AS date FROM orders WHERE year(o_orderdate) = 1996 GROUP BY {kind}, month(o_orderdate)"
    made = f"SELECT kind, CAST(date + CAST(CASE WHEN isodow(date) > 5 THEN 8 - isodow(date) ELSE 0 END AS INT) AS DATE) AS date FROM ({rule}) WHERE kind NOT IN (SELECT kind FROM ({known})) UNION ALL {known}"
    return f"SELECT kind || '_' || date AS event_id, kind, date FROM ({made})"


def pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bars of their customers, those in process without a high, against all customers that are wanted."""
    price = F.col("o_totalprice")
    got = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.to_date("o_orderdate").alias("ts"), price.alias("open"), F.when(F.col("o_orderstatus") != "P", price).alias("high"), price.alias("low"), price.alias("close"))
    return payloads.pull_summary(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset")), payloads.complete_bars(got))


PULLED = "SELECT CASE WHEN rows > 0 THEN 'success' ELSE 'failure' END AS status, count(*) AS assets, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT c_custkey, count(o_orderkey) AS rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1) GROUP BY 1"


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = series(spark, sf_dir)
    return payloads.spread(made, "A", "N", "a_minus_n", 6).unionAll(payloads.spread(made, "A", "R", "a_to_r", 6, ratio=True)).select("indicator", "ts", (F.col("value") + F.lit(0.0)).alias("value"))


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    suppliers = "SELECT CAST(s_nationkey AS VARCHAR) AS symbol, * FROM supplier"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY ts DESC) AS k FROM ({MACRO})"
    return {
        "landed_ohlc_arrays": (ohlc_arrays, f"SELECT asset, ts, open, high, low, close, CAST(0 AS DOUBLE) AS volume FROM ({BARS})"),
        "landed_daily_map": (daily_map, f"SELECT asset, ts, open, high, low, close, volume FROM ({BARS})"),
        "landed_observations": (observations, f"SELECT * FROM ({MACRO}) WHERE month(ts) % 4 <> 0"),
        "landed_sdmx": (sdmx, f"SELECT * FROM ({MACRO}) WHERE month(ts) NOT IN (6, 7)"),
        "landed_country_values": (country_values, "SELECT 'gdp' AS indicator, n_name AS country, DATE '1998-01-01' AS ts, n_nationkey * 1.5::DOUBLE AS value FROM nation WHERE n_nationkey % 5 <> 0 AND n_name IN ('FRANCE', 'GERMANY', 'JAPAN', 'NATION_1', 'NATION_2', 'NATION_5', 'CHINA')"),
        "landed_info_tables": (info_tables, f"SELECT symbol, s_name AS issuer, CAST(s_suppkey * 1000 AS DOUBLE) AS value, CAST(s_suppkey AS DOUBLE) AS shares FROM ({suppliers})"),
        "landed_insider_trades": (insider_trades, f"SELECT symbol, 'Owner' AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(s_suppkey AS DOUBLE) AS shares, 12.5::DOUBLE AS price FROM ({suppliers})"),
        "landed_filings": (filings, "SELECT CAST(o_custkey % 50 AS VARCHAR) AS symbol, CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form, CAST(o_orderdate AS DATE) AS filed, o_orderkey AS accession FROM orders WHERE o_orderstatus <> 'O'"),
        "landed_facts": (facts, f"SELECT symbol, label, \"end\", arg_max(val, (filed, val)) AS val, max(filed) AS filed FROM ({FACTS}) JOIN (SELECT symbol, label, min(unit_rank) AS unit_rank FROM ({FACTS}) GROUP BY 1, 2) USING (symbol, label, unit_rank) GROUP BY 1, 2, 3"),
        "landed_earnings": (earnings, "SELECT o_orderkey AS event_id, round(eps - est, 4) AS eps_surprise, round((eps - est) / nullif(abs(est), 0) * 100, 2) AS eps_surprise_pct, eps IS NOT NULL AS has_actuals FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 100 END AS eps, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 10000) * 100 AS DOUBLE) END AS est FROM orders) WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-08' AND DATE '1996-06-29' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
        "landed_trades": (trades, "SELECT o_orderpriority AS symbol, CAST(o_custkey AS VARCHAR) AS member, CAST(o_orderdate AS DATE) AS traded, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS kind FROM orders"),
        "post_sentiment": (posts, f"SELECT count(*) AS mentions, CASE WHEN sum(s * w) / sum(w) > 0.05 THEN 'bullish' WHEN sum(s * w) / sum(w) < -0.05 THEN 'bearish' ELSE 'neutral' END AS label, round(sum(s * w) / sum(w), 6) AS score FROM ({POSTS})"),
        "search_interest": (interest, picked(f"SELECT *, CASE WHEN recent > mean * 1.1 THEN 'rising' WHEN recent < mean * 0.9 THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT indicator AS term, avg(value) AS mean, max(value) FILTER (WHERE k = 1) AS current, avg(value) FILTER (WHERE k <= 4) AS recent FROM ({ranked}) GROUP BY 1)", ["term", "trend"], ["mean", "current", "recent"])),
        "message_ratio": (messages, picked("SELECT *, CASE WHEN bulls > 1.3 * bears THEN 'bullish' WHEN bears > 1.3 * bulls THEN 'bearish' ELSE 'neutral' END AS label, bulls / nullif(bulls + bears, 0) AS ratio FROM (SELECT event_type AS symbol, count(*) FILTER (WHERE value > 55) AS bulls, count(*) FILTER (WHERE value < 45) AS bears FROM events GROUP BY 1)", ["symbol", "bulls", "bears", "label"], ["ratio"])),
        "composite_mood": (mood, picked("SELECT *, CASE WHEN score > 0.2 THEN 'bullish' WHEN score < -0.2 THEN 'bearish' ELSE 'neutral' END AS overall FROM (SELECT event_type AS symbol, avg(CASE WHEN value > 40 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END) AS score FROM events GROUP BY 1)", ["symbol", "overall"], ["score"])),
        "options_summary": (options, picked(f"SELECT *, CASE WHEN ratio > 1.2 THEN 'extreme_fear' WHEN ratio > 1.0 THEN 'fear' WHEN ratio > 0.8 THEN 'neutral' WHEN ratio > 0.6 THEN 'greed' ELSE 'extreme_greed' END AS signal, iv * sqrt(days / 365) * 100 AS implied_move FROM (SELECT *, puts / greatest(calls, 1) AS ratio FROM ({OPTIONS}))", ["symbol", "calls", "puts", "days", "signal"], ["iv", "ratio", "implied_move"])),
        "landed_news": (news, "SELECT p_partkey AS id, p_name AS title, p_type[1:8] AS summary, CASE WHEN p_partkey % 3 = 0 THEN 'http://x/' ELSE 'http://y/' END || p_partkey AS link, CASE WHEN p_partkey % 3 = 0 THEN '5' ELSE '6' END AS published FROM part WHERE p_partkey % 3 < 2"),
        "sniffed_formats": (sniffed, SNIFFED),
        "macro_calendar": (calendar, _calendar_sql()),
        "pull_summary": (pulled, PULLED),
        "wide_series": (lambda s, d: payloads.wide(series(s, d), ["A", "N", "R"]), f"SELECT ts, max(value) FILTER (WHERE indicator = 'A') AS \"A\", max(value) FILTER (WHERE indicator = 'N') AS \"N\", max(value) FILTER (WHERE indicator = 'R') AS \"R\" FROM ({MACRO}) GROUP BY 1"),
        "series_spread": (spreads, f"WITH w AS (SELECT ts, max(value) FILTER (WHERE indicator = 'A') AS a, max(value) FILTER (WHERE indicator = 'N') AS n, max(value) FILTER (WHERE indicator = 'R') AS r FROM ({MACRO}) GROUP BY 1) SELECT 'a_minus_n' AS indicator, ts, round(a - n, 6) + 0.0 AS value FROM w WHERE a IS NOT NULL AND n IS NOT NULL UNION ALL SELECT 'a_to_r', ts, round(a / r, 6) + 0.0 FROM w WHERE a IS NOT NULL AND r IS NOT NULL"),
        "search_hits": (lambda s, d: payloads.search_hits(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "the", 60), "SELECT item_id AS id, substring(text, CAST(greatest(strpos(lower(text), 'the') - 40, 1) AS INT), 60) AS snippet FROM benchmark WHERE strpos(lower(text), 'the') > 0"),
        "padded_keys": (lambda s, d: table(s, d, "supplier").select("s_suppkey", payloads.zero_padded("s_suppkey").alias("cik")), "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier"),
    }
