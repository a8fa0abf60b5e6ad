"""Feeds as a whole: macro series with their checks and scores, facts of companies, profiles, and what a run of connectors has done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.payloads import number, zero_padded

#: The letter of a frequency.
FREQUENCIES = {"daily": "d", "weekly": "w", "monthly": "m", "quarterly": "q"}
#: Least rows and most days since the last, by frequency, and for all others.
LIMITS = {"event": (2, 100), "monthly": (10, 100), "quarterly": (5, 100)}
OTHERS = (10, 10)


def described(raw: DataFrame, body: str = "body") -> DataFrame:
    """(indicator, title, units, frequency, updated) of a JSON answer that lists series: the first of each."""
    found = F.get(F.from_json(body, "struct<seriess:array<struct<id:string,title:string,units:string,frequency:string,last_updated:string>>>")["seriess"], F.lit(0))
    return raw.select(found.alias("s")).where("s.id is not null").select(F.col("s.id").alias("indicator"), "s.title", "s.units", F.lower("s.frequency").alias("frequency"), F.col("s.last_updated").alias("updated"))


def recent(observations: DataFrame, start: str | None = None, end: str | None = None, most: int = 10000) -> DataFrame:
    """Observations (indicator, ts, value) from start to end, of each series the ``most`` latest, the newest first; the filter reaches the scan."""
    kept = observations.where("value is not null")
    kept = kept.where(F.col("ts") >= F.lit(start).cast("date")) if start else kept
    kept = kept.where(F.col("ts") <= F.lit(end).cast("date")) if end else kept
    rank = F.row_number().over(Window.partitionBy("indicator").orderBy(F.desc("ts"), F.desc("value")))
    return kept.withColumn("_k", rank).where(F.col("_k") <= most).orderBy("indicator", "_k").drop("_k")


def ingested(observations: DataFrame, series: DataFrame, as_of: str) -> DataFrame:
    """One row a wanted series (indicator, frequency): code, n_fetched, n_written, first, last, error, stale.

    A series is written whole or not at all: it needs the least rows of its frequency and no day twice; nulls are no rows. A last day
    that is too long ago is a warning.
    """
    limit = lambda k: F.coalesce(*(F.when(F.col("frequency") == f, v[k]) for f, v in LIMITS.items()), F.lit(OTHERS[k]))
    letter = F.coalesce(*(F.when(F.col("frequency") == f, c) for f, c in FREQUENCIES.items()), F.lit(None).cast("string"))
    days = observations.where("value is not null").groupBy("indicator", "ts").agg(F.count("*").alias("c"))
    found = days.groupBy("indicator").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 1).alias("twice"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    done = series.select("indicator", "frequency").join(found, "indicator", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    errors = (F.col("n") < limit(0)).cast("int") + F.coalesce((F.col("twice") > 0).cast("int"), F.lit(0))
    error = F.when(F.col("n") == 0, "empty").when(errors > 0, F.format_string("%d checks failed", errors))
    good = error.isNull()
    return done.select("indicator", letter.alias("code"), F.col("n").alias("n_fetched"), F.when(good, F.col("n")).otherwise(0).alias("n_written"), F.when(good, F.col("first")).alias("first"), F.when(good, F.col("last")).alias("last"), error.alias("error"), (F.datediff(F.lit(as_of).cast("date"), "last") > limit(1)).alias("stale"))


#: Values that a score looks back on.
WINDOWS = {"z_1y": 252, "z_3y": 756}


def scored(observations: DataFrame, windows: dict[str, int] | None = None, places: int = 3) -> DataFrame:
    """Adds to (indicator, ts, value) the z of each value among the last ones of its series, itself included: null until the window is full (that of a shorter series is all of it), 0 without variation. A series is bounded by the calendar."""
    one = Window.partitionBy("indicator")
    done = observations.withColumn("_n", F.count("value").over(one))
    for name, size in (windows or WINDOWS).items():
        w = one.orderBy("ts").rowsBetween(-(size - 1), 0)
        z = F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w)), F.lit(0.0))
        done = done.withColumn(name, F.when((F.count("value").over(w) == F.least(F.lit(size), F.col("_n"))) & (F.col("_n") > 1), F.round(z, places) + F.lit(0.0)))
    return done.drop("_n")


def with_ciks(tickers: DataFrame, directory: DataFrame) -> DataFrame:
    """Tickers (symbol) with ``cik`` of ten digits by a directory (ticker, cik_str), in either case; null where there is none, the smallest of several."""
    known = directory.groupBy(F.upper("ticker").alias("_s")).agg(F.min("cik_str").alias("cik_str"))
    return tickers.join(known, F.upper("symbol") == F.col("_s"), "left").drop("_s").withColumn("cik", zero_padded("cik_str")).drop("cik_str")


#: Concepts of company facts and their labels. Of several concepts with a label the last one with facts holds.
CONCEPTS = {
    "Revenues": "revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "GrossProfit": "gross_profit",
    "OperatingIncomeLoss": "operating_income",
    "NetIncomeLoss": "net_income",
    "EarningsPerShareDiluted": "eps_diluted",
    "EarningsPerShareBasic": "eps_basic",
    "ResearchAndDevelopmentExpense": "r_and_d",
    "SellingGeneralAndAdministrativeExpense": "sga",
    "DepreciationAndAmortization": "depreciation",
    "InterestExpense": "interest_expense",
    "IncomeTaxExpenseBenefit": "tax_expense",
    "Assets": "total_assets",
    "Liabilities": "total_liabilities",
    "StockholdersEquity": "stockholders_equity",
    "CashAndCashEquivalentsAtCarryingValue": "cash",
    "ShortTermInvestments": "short_term_investments",
    "InventoryNet": "inventory",
    "AccountsReceivableNetCurrent": "accounts_receivable",
    "LongTermDebt": "long_term_debt",
    "LongTermDebtNoncurrent": "long_term_debt",
    "CommonStockSharesOutstanding": "shares_outstanding",
    "NetCashProvidedByUsedInOperatingActivities": "operating_cash_flow",
    "NetCashProvidedByUsedInInvestingActivities": "investing_cash_flow",
    "NetCashProvidedByUsedInFinancingActivities": "financing_cash_flow",
    "CapitalExpendituresContinuingOperations": "capex",
    "PaymentsForRepurchaseOfCommonStock": "buybacks",
    "PaymentsOfDividendsCommonStock": "dividends_paid",
    "BookValuePerShareBasic": "book_value_per_share",
}
#: Units, the preferred first, and the forms that count.
UNITS, FORMS = ("USD", "USD/shares", "shares", "pure"), ("10-K", "10-Q")


def company_facts(facts: DataFrame) -> DataFrame:
    """(symbol, label, end, val, filed, form) of facts (symbol, concept, unit, end, val, form, filed): one concept and unit a label, the latest filing a period (ties: the greatest value)."""
    table = F.create_map(*(F.lit(x) for i, (c, label) in enumerate(CONCEPTS.items()) for x in (c, f"{i:02d} {label}")))
    named = F.try_element_at(table, F.col("concept"))
    unit = F.array_position(F.array(*map(F.lit, UNITS)), F.col("unit"))
    kept = facts.withColumns({"_n": named, "_u": unit}).where(named.isNotNull() & (unit > 0) & F.col("form").isin(*FORMS) & F.col("end").isNotNull() & F.col("val").isNotNull())
    kept = kept.withColumns({"label": F.substring("_n", 4, 100), "_place": F.substring("_n", 1, 2).cast("int")})
    best = kept.groupBy("symbol", "label").agg(F.max(F.struct("_place", -F.col("_u"))).alias("b"))
    rows = kept.join(best, ["symbol", "label"]).where((F.col("_place") == F.col("b._place")) & (F.col("_u") == -F.col("b.col2")))
    return rows.groupBy("symbol", "label", "end").agg(F.max(F.struct("filed", "val", "form")).alias("r")).select("symbol", "label", "end", "r.val", "r.filed", "r.form")


#: Key figures of a profile and the fields that they come from.
STATS = {
    "market_cap": "marketCap", "enterprise_value": "enterpriseValue", "revenue_ttm": "totalRevenue", "gross_profit_ttm": "grossProfits", "ebitda": "ebitda", "net_income": "netIncomeToCommon", "free_cash_flow": "freeCashflow",
    "debt_to_equity": "debtToEquity", "current_ratio": "currentRatio", "return_on_equity": "returnOnEquity", "return_on_assets": "returnOnAssets", "profit_margin": "profitMargins", "revenue_growth_yoy": "revenueGrowth",
    "earnings_growth_yoy": "earningsGrowth", "short_ratio": "shortRatio", "short_pct_float": "shortPercentOfFloat", "beta": "beta", "52w_high": "fiftyTwoWeekHigh", "52w_low": "fiftyTwoWeekLow", "avg_volume_10d": "averageVolume10days",
    "dividend_yield": "dividendYield", "price_to_book": "priceToBook", "ev_to_revenue": "enterpriseToRevenue", "ev_to_ebitda": "enterpriseToEbitda",
}


def key_stats(raw: DataFrame, body: str = "body") -> DataFrame:
    """(symbol, a column for each key figure) of JSON objects; what is no number is null."""
    return raw.select("symbol", *(number(F.get_json_object(body, f"$.{field}")).alias(name) for name, field in STATS.items()))


def atom_filings(raw: DataFrame, most: int = 5, body: str = "body") -> DataFrame:
    """(symbol, place, form, filed, url): the first ``most`` entries of an Atom feed, in its order."""
    entry = r"(?s)<category[^>]*term=\"([^\"]+)\".*?<updated>([^<]+)</updated>.*?<filing-href>([^<]+)</filing-href>"
    part = lambda k: F.regexp_extract_all(body, F.lit(entry), k)
    rows = raw.select("symbol", F.posexplode(F.slice(F.arrays_zip(part(1).alias("form"), part(2).alias("filed"), part(3).alias("url")), 1, most)).alias("place", "e"))
    return rows.select("symbol", (F.col("place") + 1).alias("place"), "e.form", F.substring("e.filed", 1, 10).try_cast("date").alias("filed"), F.trim("e.url").alias("url"))


def first_rows(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order, with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def profiles(symbols: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row a symbol with the rows (symbol, place, ...) of each part as an array in their order; empty where there are none. Parts are short lists."""
    out = symbols.select("symbol").distinct()
    for name, rows in parts.items():
        rest = [c for c in rows.columns if c not in ("symbol", "place")]
        listed = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias(name))
        out = out.join(listed, "symbol", "left").withColumn(name, F.coalesce(F.col(name), F.array()))
    return out


def run_summary(results: dict[str, DataFrame]) -> DataFrame:
    """(connector, n_series, n_failed, n_written) of each connector's results (n_written, error), and their total."""
    one = lambda name, rows: rows.agg(F.lit(name).alias("connector"), F.count("*").alias("n_series"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n_written"))), F.lit(0)).alias("n_written"))
    each = reduce(DataFrame.unionAll, (one(n, r) for n, r in results.items()))
    return each.unionAll(each.agg(F.lit("total").alias("connector"), *(F.sum(c).alias(c) for c in ("n_series", "n_failed", "n_written"))))


def planned(wanted: dict[str, DataFrame], most: int = 5) -> DataFrame:
    """(connector, n, first) of what a run would fetch: how many names (name) and the first ``most`` of them."""
    one = lambda kind, rows: rows.agg(F.lit(kind).alias("connector"), F.count_distinct("name").alias("n")).crossJoin(rows.select("name").distinct().orderBy("name").limit(most).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("first")))
    return reduce(DataFrame.unionAll, (one(k, r) for k, r in wanted.items()))
