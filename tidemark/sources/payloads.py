"""Landed raw payloads to rows: each takes a DataFrame with the payload in a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(text: str | Column) -> Column:
    """A number with thousands separators; null where it is none (``.`` and blanks included)."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def ohlc_arrays(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows of a JSON array of [milliseconds, open, high, low, close]; volume is 0."""
    rows = raw.select("*", F.explode(F.from_json(body, "array<array<double>>")).alias("bar")).where(F.size("bar") >= 5)
    return rows.select("asset", F.timestamp_millis(F.col("bar")[0].cast("long")).alias("ts"), *(F.col("bar")[i + 1].alias(n) for i, n in enumerate(("open", "high", "low", "close"))), F.lit(0.0).alias("volume"))


def daily_map(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows of a JSON map from date to a bar of strings; bars without a positive close are left out."""
    fields = ("open", "high", "low", "close", "volume")
    days = raw.select("asset", F.explode(F.from_json(body, "map<string,map<string,string>>")).alias("day", "bar"))
    return days.select("asset", F.to_date("day").alias("ts"), *(number(F.col("bar")[f]).alias(f) for f in fields)).where("close > 0")


def observations(raw: DataFrame, body: str = "body") -> DataFrame:
    """(indicator, ts, value) of a JSON list of {date, value}; a value that is no number is missing and left out."""
    seen = raw.select("indicator", F.explode(F.from_json(body, "array<struct<date:string,value:string>>")).alias("o"))
    return seen.select("indicator", F.to_date("o.date").alias("ts"), number(F.col("o.value")).alias("value")).where("value is not null")


def earnings(raw: DataFrame) -> DataFrame:
    """Adds eps_surprise, eps_surprise_pct (of the absolute estimate) and has_actuals to rows with eps and eps_estimate."""
    gap = F.col("eps") - F.col("eps_estimate")
    return raw.withColumns({"eps_surprise": F.round(gap, 4), "eps_surprise_pct": F.round(F.try_divide(gap, F.abs("eps_estimate")) * 100, 2), "has_actuals": F.col("eps").isNotNull()})


def filings(raw: DataFrame, forms: list[str]) -> DataFrame:
    """Rows of parallel arrays (form, filed, accession), of these forms."""
    return raw.select("symbol", F.inline(F.arrays_zip("form", "filed", "accession"))).where(F.col("form").isin(forms))


def latest_facts(facts: DataFrame) -> DataFrame:
    """Of facts (label, unit_rank, end, filed, val, form): annual and quarterly ones in the best unit, the latest filing of each period."""
    kept = facts.where(F.col("form").isin("10-K", "10-Q"))
    best = kept.groupBy("symbol", "label").agg(F.min("unit_rank").alias("unit_rank"))
    return kept.join(best, ["symbol", "label", "unit_rank"]).groupBy("symbol", "label", "end").agg(F.max_by("val", F.struct("filed", "val")).alias("val"), F.max("filed").alias("filed"))


def info_tables(raw: DataFrame, body: str = "body") -> DataFrame:
    """Holdings (issuer, value, shares) of XML with infoTable elements, in any namespace."""
    blocks = raw.select("symbol", F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<(?:\w+:)?infoTable>(.*?)</(?:\w+:)?infoTable>"), 1)).alias("block"))
    field = lambda n: F.regexp_extract("block", rf"<(?:\w+:)?{n}>\s*([^<]*?)\s*</", 1)
    return blocks.select("symbol", field("nameOfIssuer").alias("issuer"), number(field("value")).alias("value"), number(field("sshPrnamt")).alias("shares"))


def put_call_signal(ratio: str | Column) -> Column:
    """A contrarian reading of the put/call ratio."""
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(r > 1.2, "extreme_fear").when(r > 1.0, "fear").when(r > 0.8, "neutral").when(r > 0.6, "greed").otherwise("extreme_greed")


def complete_bars(raw: DataFrame) -> DataFrame:
    """Bars with all four prices, in UTC days, with adj_close beside close."""
    return raw.dropna(subset=["open", "high", "low", "close"]).withColumn("adj_close", F.col("close"))


def training_bars(raw: DataFrame, time: str = "Date", zone: str = "UTC") -> DataFrame:
    """Bars under lower-case names without a row that lacks anything (not-a-numbers included), their times as days of UTC; columns whose names differ in case alone are an error."""
    names = [c.lower() for c in raw.columns]
    if len(set(names)) < len(names):
        raise ValueError("columns whose names differ in case alone")
    day = F.to_date(F.to_utc_timestamp(F.col(time.lower()), zone))
    return raw.toDF(*names).dropna("any").withColumn(time.lower(), day)


def pull_summary(wanted: DataFrame, pulled: DataFrame) -> DataFrame:
    """(status, assets, rows) of the assets wanted (asset): those with rows, and those without."""
    found = wanted.join(pulled.groupBy("asset").agg(F.count("*").alias("rows")), "asset", "left")
    return found.groupBy(F.when(F.col("rows") > 0, "success").otherwise("failure").alias("status")).agg(F.count("*").alias("assets"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def sdmx(raw: DataFrame, body: str = "body") -> DataFrame:
    """(indicator, ts, value) of CSV with the columns TIME_PERIOD and OBS_VALUE at any place; days, months, quarters or years; blanks and text left out."""
    lines = F.split(F.regexp_replace(body, "\r", ""), "\n")
    step = raw.select("indicator", F.transform(F.split(lines[0], ","), lambda c: F.trim(c)).alias("names"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    at = lambda name: F.try_element_at(F.split("line", ","), F.array_position("names", name).cast("int"))
    step = step.where(F.array_contains("names", "TIME_PERIOD") & F.array_contains("names", "OBS_VALUE")).select("indicator", F.trim(at("TIME_PERIOD")).alias("t"), number(F.trim(at("OBS_VALUE"))).alias("value"))
    quarter = F.make_date(F.substring("t", 1, 4).try_cast("int"), F.substring("t", 7, 1).try_cast("int") * 3 - 2, F.lit(1))
    when = F.when(F.col("t").rlike(r"^\d{4}-Q[1-4]$"), quarter).when(F.col("t").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("t").try_cast("date")).when(F.col("t").rlike(r"^\d{4}-\d{2}$"), F.concat("t", F.lit("-01")).try_cast("date")).when(F.col("t").rlike(r"^\d{4}$"), F.concat("t", F.lit("-01-01")).try_cast("date"))
    return step.select("indicator", when.alias("ts"), "value").dropna()


def country_values(raw: DataFrame, countries: list[str], body: str = "body") -> DataFrame:
    """(country, ts, value) of a JSON pair of a header and a list of {country.id, date, value}, for some countries."""
    second = F.get_json_object(body, "$[1]")
    seen = raw.select("indicator", F.explode(F.from_json(second, "array<struct<country:struct<id:string>,date:string,value:double>>")).alias("o"))
    return seen.select("indicator", F.col("o.country.id").alias("country"), F.make_date(F.col("o.date").try_cast("int"), F.lit(1), F.lit(1)).alias("ts"), F.col("o.value").alias("value")).where(F.col("country").isin(countries) & F.col("value").isNotNull())


def insider_trades(raw: DataFrame, body: str = "body") -> DataFrame:
    """(symbol, owner, side, shares, price) of ownership XML: A is a buy, D a sale."""
    owner = F.regexp_extract(body, r"<rptOwnerName>\s*([^<]*?)\s*</", 1)
    blocks = raw.select("symbol", owner.alias("owner"), F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<nonDerivativeTransaction>(.*?)</nonDerivativeTransaction>"), 1)).alias("block"))
    field = lambda n: F.regexp_extract("block", rf"(?s)<{n}>\s*<value>\s*([^<]*?)\s*</value>", 1)
    code = field("transactionAcquiredDisposedCode")
    return blocks.select("symbol", "owner", F.when(code == "A", "buy").when(code == "D", "sell").alias("side"), number(field("transactionShares")).alias("shares"), number(field("transactionPricePerShare")).alias("price"))


def trades_of_both(house: DataFrame, senate: DataFrame, symbol: str | None = None, top: int | None = None) -> DataFrame:
    """Two feeds with different columns as one, the newest first; of one symbol, and only the ``top``, if they are given."""
    both = house.withColumn("chamber", F.lit("house")).unionByName(senate.withColumn("chamber", F.lit("senate")), allowMissingColumns=True)
    kept = (both.where(F.col("symbol") == symbol) if symbol else both).orderBy(F.desc("traded"), "chamber", "symbol", "member")
    return kept.limit(top) if top else kept


def zero_padded(cik: str) -> Column:
    return F.lpad(F.col(cik).cast("string"), 10, "0")


def search_hits(filings_: DataFrame, words: str, most: int = 200) -> DataFrame:
    """Filings (id, text) with the words in any case, and the text around the first place, ``most`` characters at most."""
    at = F.instr(F.lower("text"), words.lower())
    return filings_.where(at > 0).select("id", F.substring(F.col("text"), F.greatest(at - 40, F.lit(1)), F.lit(most)).alias("snippet"))


def lean(score: Column, limit: float, names: tuple[str, str, str] = ("bullish", "bearish", "neutral")) -> Column:
    return F.when(score > limit, names[0]).when(score < -limit, names[1]).otherwise(names[2])


def post_sentiment(posts: DataFrame, now: str, symbol: str) -> DataFrame:
    """mentions, score (weighted by votes, one at least) and label of posts (created, title, votes, sentiment) of the last day that name the symbol."""
    fresh = posts.where((F.col("created") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 24 HOURS")) & (F.col("created") <= F.lit(now).cast("timestamp")) & F.contains(F.upper("title"), F.lit(symbol.upper())))
    weight = F.greatest(F.col("votes"), F.lit(1))
    done = fresh.agg(F.count("*").alias("mentions"), F.coalesce(F.try_divide(F.sum(F.col("sentiment") * weight), F.sum(weight)), F.lit(0.0)).alias("score"))
    return done.withColumn("label", lean(F.col("score"), 0.05))


def interest(series: DataFrame) -> DataFrame:
    """mean, current, recent (mean of the last four) and trend (rising or falling by a tenth of the mean) of (term, ts, value)."""
    from pyspark.sql import Window

    w = Window.partitionBy("term").orderBy(F.desc("ts"))
    ranked = series.withColumn("_k", F.row_number().over(w))
    done = ranked.groupBy("term").agg(F.avg("value").alias("mean"), F.max(F.when(F.col("_k") == 1, F.col("value"))).alias("current"), F.avg(F.when(F.col("_k") <= 4, F.col("value"))).alias("recent"))
    return done.withColumn("trend", F.when(F.col("recent") > F.col("mean") * 1.1, "rising").when(F.col("recent") < F.col("mean") * 0.9, "falling").otherwise("stable"))


def message_ratio(messages: DataFrame) -> DataFrame:
    """bulls, bears, ratio (of bulls among both) and label (1.3 times as many) of messages (symbol, body: JSON with entities.sentiment.basic)."""
    mood = F.get_json_object("body", "$.entities.sentiment.basic")
    done = messages.groupBy("symbol").agg(F.count_if(mood == "Bullish").alias("bulls"), F.count_if(mood == "Bearish").alias("bears"))
    label = F.when(F.col("bulls") > 1.3 * F.col("bears"), "bullish").when(F.col("bears") > 1.3 * F.col("bulls"), "bearish").otherwise("neutral")
    return done.withColumns({"ratio": F.try_divide("bulls", F.col("bulls") + F.col("bears")), "label": label})


def composite_mood(labels: DataFrame) -> DataFrame:
    """score and label of all labels (symbol, label) of a symbol: bullish 1, bearish -1, others 0."""
    sign = F.when(F.col("label") == "bullish", 1).when(F.col("label") == "bearish", -1).otherwise(0)
    return labels.groupBy("symbol").agg(F.avg(sign).alias("score")).withColumn("overall", lean(F.col("score"), 0.2))


def options_summary(chain: DataFrame) -> DataFrame:
    """calls, puts (volumes), ratio, median implied volatility and implied move in percent of (symbol, kind, volume, iv, days)."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("volume"))), F.lit(0))
    done = chain.groupBy("symbol").agg(side("call").alias("calls"), side("put").alias("puts"), F.percentile("iv", F.lit(0.5)).alias("iv"), F.min("days").alias("days"))
    return done.withColumns({"ratio": F.col("puts") / F.greatest(F.col("calls"), F.lit(1)), "implied_move": F.col("iv") * F.sqrt(F.col("days") / 365) * 100})


def news(raw: DataFrame, most: int = 300) -> DataFrame:
    """(id, title, summary, link, published) of JSON articles whose fields stand at the top or under ``content``; summaries are cut to ``most`` characters."""
    first = lambda *paths: F.coalesce(*(F.get_json_object("body", f"$.{p}") for p in paths))
    made = raw.select("id", first("title", "content.title").alias("title"), F.substring(F.coalesce(first("summary", "content.summary", "content.description"), F.lit("")), 1, most).alias("summary"), first("link", "content.canonicalUrl.url", "content.clickThroughUrl.url").alias("link"), first("providerPublishTime", "content.pubDate").alias("published"))
    return made.where("title is not null")


def sniffed(raw: DataFrame, most: int = 50) -> DataFrame:
    """(id, format, rows): what a body is - a JSON array, an object with a list of objects, one object a line, CSV - and its first ``most`` rows as maps of text."""
    text, row = F.trim("body"), "map<string,string>"
    array = F.when(text.startswith("["), F.try_parse_json(text)).isNotNull()
    listed = F.regexp_extract(text, r'(?s)^\{.*?"\w+"\s*:\s*(\[\s*\{.*\}\s*\])', 1)
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    each_line = F.transform(lines, lambda x: F.when(F.trim(x).startswith("{"), F.from_json(x, row)))
    nd = (F.size(lines) > 1) & F.forall(each_line, lambda x: x.isNotNull())
    names = F.split(lines[0], ",")
    cells = F.transform(F.slice(lines, 2, F.lit(most)), lambda x: F.map_from_arrays(names, F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.get(F.split(x, ","), i))))
    kind = F.when(array, "json").when(nd, "ndjson").when(listed != "", "json_object").when((F.size(lines) > 1) & (F.size(names) > 1), "csv").otherwise("unknown")
    rows = F.when(kind == "json", F.from_json(text, f"array<{row}>")).when(kind == "ndjson", each_line).when(kind == "json_object", F.from_json(listed, f"array<{row}>")).when(kind == "csv", cells)
    return raw.select("id", kind.alias("format"), F.coalesce(F.slice(rows, 1, most), F.array().cast(f"array<{row}>")).alias("rows"))


#: Monthly and quarterly events of a calendar made by rule: name, months, day (fixed values).
RULES = (("CPI", tuple(range(1, 13)), 12), ("NFP", tuple(range(1, 13)), 5), ("PPI", tuple(range(1, 13)), 14), ("RETAIL", tuple(range(1, 13)), 15), ("GDP", (1, 4, 7, 10), 28), ("FOMC", (1, 3, 5, 6, 7, 9, 11, 12), 18))


def macro_calendar(spark, year: int, known: DataFrame | None = None) -> DataFrame:
    """(event_id, kind, date) of a year: known dates (kind, date) of a kind stand for its rule; a weekend moves to the Monday after."""
    rules = spark.createDataFrame([(k, list(m), d) for k, m, d in RULES], "kind string, months array<int>, day int")
    rules = rules.join(known.where(F.year("date") == year).select("kind").distinct(), "kind", "left_anti") if known is not None else rules
    day = F.make_date(F.lit(year), F.col("month"), F.col("day"))
    made = rules.select("kind", F.explode("months").alias("month"), "day").select("kind", F.date_add(day, F.when(F.weekday(day) > 4, 7 - F.weekday(day)).otherwise(0)).alias("date"))
    made = made.unionByName(known.where(F.year("date") == year).select("kind", "date")) if known is not None else made
    return made.select(F.concat_ws("_", "kind", F.col("date").cast("string")).alias("event_id"), "kind", "date")


def wide(series: DataFrame, names: list[str]) -> DataFrame:
    """(ts, a column for each series) of (indicator, ts, value): the full outer join of all, as one aggregate."""
    return series.groupBy("ts").agg(*(F.max(F.when(F.col("indicator") == n, F.col("value"))).alias(n) for n in names))


def spread(series: DataFrame, a: str, b: str, name: str, places: int = 4, ratio: bool = False) -> DataFrame:
    """The difference (or ratio) of two series on the days that both have, as a series of its own."""
    both = wide(series, [a, b]).dropna()
    value = F.try_divide(F.col(a), F.col(b)) if ratio else F.col(a) - F.col(b)
    return both.select(F.lit(name).alias("indicator"), "ts", F.round(value, places).alias("value")).where("value is not null")
