"""Registers and their records: sources by id or address, experiments by data set, logs, collections of vectors, names that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scores import namespaced, plain_url

#: Words of a rising and of a falling mood.
RISING = (
    "beat", "beats", "surges", "soars", "jumps", "rallies", "gains", "record", "upgrades", "upgrade", "buy", "outperform", "strong", "bullish", "growth", "positive", "profit", "higher", "rises", "rose", "climbs", "breakout",
    "partnership", "deal", "revenue", "earnings beat", "raised guidance", "expanding", "acquisition", "approved", "launches", "breakthrough",
)
FALLING = (
    "misses", "miss", "falls", "drops", "plunges", "slides", "slumps", "cuts", "downgrade", "downgrades", "sell", "underperform", "weak", "bearish", "loss", "lower", "decline", "declines", "layoffs", "lawsuit", "fine", "recall",
    "bankruptcy", "fraud", "investigation", "warning", "risk", "missed guidance", "guidance cut", "disappointing", "slowing",
)
#: The status of an edge that stands for a claim.
EDGE_STATUS = {"supported": "active", "proposed": "proposed", "weak": "weak", "rejected": "rejected", "archived": "archived"}
#: Factor groups and the series that stands for each.
FACTORS = {"rate": "GS10", "inflation": "T10YIE", "dollar": "DTWEXBGS", "oil": "DCOILWTICO", "volatility": "VIXCLS", "credit": "BAMLH0A0HYM2", "liquidity": "WALCL", "financial_stress": "STLFSI4"}
#: Columns of bars that are no features.
NOT_FEATURES = ("open", "high", "low", "close", "volume", "adj_close", "dividends", "stock_splits")


def matched(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates (source_id, url) with ``known_id``: the record (source_id, url) of their id, else the first by id with their address (case and last slashes aside); null for new ones, and ``by``."""
    ids = registry.select(F.col("source_id").alias("_id")).distinct()
    urls = registry.where("url is not null").groupBy(plain_url("url").alias("_url")).agg(F.min("source_id").alias("_by_url"))
    found = candidates.join(ids, F.col("source_id") == F.col("_id"), "left").join(urls, plain_url("url") == F.col("_url"), "left")
    return found.withColumns({"known_id": F.coalesce("_id", "_by_url"), "by": F.when(F.col("_id").isNotNull(), "id").when(F.col("_by_url").isNotNull(), "url")}).drop("_id", "_url", "_by_url")


def comparable(experiments: DataFrame, version: str) -> DataFrame:
    """Experiments (dataset_version, comparison_version, created, experiment_id) made on a data set's version, or compared by it; the newest first."""
    return experiments.where((F.col("dataset_version") == version) | (F.col("comparison_version") == version)).orderBy(F.desc("created"), "experiment_id")


def groups_of_versions(experiments: DataFrame) -> DataFrame:
    """(version, n, n_models, best): how many experiments can be compared under each version, counting one that names it twice once; best by score, then id."""
    each = experiments.select("experiment_id", "model_type", "score", F.explode(F.array_distinct(F.array("dataset_version", "comparison_version"))).alias("version")).where("version is not null")
    return each.groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("model_type").alias("n_models"), F.min_by("experiment_id", F.struct(-F.col("score"), "experiment_id")).alias("best"))


def listed(log: DataFrame, agent: str, action: str, most: int = 10) -> DataFrame:
    """The latest entries of a log (agent, action, created, entry_id, ...) of one agent and action."""
    return log.where((F.col("agent") == agent) & (F.col("action") == action)).orderBy(F.desc("created"), "entry_id").limit(most)


def collection_info(points: DataFrame) -> DataFrame:
    """(collection, n_points, dims, n_other): the points (collection, vector) of each collection, its commonest length (the longest of equally common), and how many points have another."""
    each = points.groupBy("collection", F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    best = each.groupBy("collection").agg(F.sum("n").alias("n_points"), F.max_by(F.struct("d", "n"), F.struct("n", "d")).alias("b"))
    return best.select("collection", "n_points", F.col("b.d").alias("dims"), (F.col("n_points") - F.col("b.n")).alias("n_other"))


def claim_graph(claims: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, label, n_claims) of both ends of claims (claim_id, subject, predicate, object, confidence, status), and an edge for each claim with its status; an unknown status is proposed."""
    ends = claims.select(F.explode(F.array("subject", "object")).alias("node")).where("node is not null")
    nodes = ends.groupBy("node").agg(F.count("*").alias("n_claims")).withColumn("k", namespaced("node", kinds)).select("node", "k.kind", "k.label", "n_claims")
    status = F.coalesce(*(F.when(F.col("status") == a, b) for a, b in EDGE_STATUS.items()), F.lit("proposed"))
    return nodes, claims.where("subject is not null and object is not null").select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("rel"), status.alias("status"), "confidence", "claim_id")


def feature_names(columns: list[str]) -> list[str]:
    """Columns that are features, each once, in their order."""
    return [c for c in dict.fromkeys(columns) if c.lower() not in NOT_FEATURES and c not in ("asset", "ts")]


def names_due(made: list[str], expected: list[str]) -> dict[str, list[str]]:
    """Names that are missing and those that nobody expects."""
    return {"missing": [c for c in expected if c not in made], "unexpected": [c for c in made if c not in expected]}


def reindexed(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ts, value, since) for each day of a calendar (ts): the last value of a series (ts, value) on or before it; null before the first. Both are bounded by the calendar."""
    rows = calendar.select("ts", F.lit(None).cast("double").alias("value"), F.lit(True).alias("_want")).distinct().unionAll(series.where("value is not null").select("ts", F.col("value").cast("double"), F.lit(False)))
    each = rows.groupBy("ts").agg(F.max("value").alias("value"), F.max("_want").alias("_want"))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one series over days
    seen = lambda c: F.last(F.when(F.col("value").isNotNull(), c), ignorenulls=True).over(w)
    return each.withColumns({"_v": seen(F.col("value")), "since": seen(F.col("ts"))}).where("_want").select("ts", F.col("_v").alias("value"), "since")


def normalised_with(rows: DataFrame, columns: list[str], method: str = "zscore") -> tuple[DataFrame, DataFrame]:
    """Columns scaled over all rows, and the parameters (name, low, width) that scale new rows alike; one that does not vary stays, with 0 and 1."""
    low, width = (F.avg, F.stddev_samp) if method == "zscore" else (F.min, lambda c: F.max(c) - F.min(c))
    flat = lambda c: F.coalesce(width(c), F.lit(0.0)) == 0
    cells = [F.struct(F.lit(c).alias("name"), F.when(flat(c), 0.0).otherwise(low(c).cast("double")).alias("low"), F.when(flat(c), 1.0).otherwise(width(c).cast("double")).alias("width")) for c in columns]
    found = rows.agg(F.array(*cells).alias("p")).select(F.inline("p"))
    return scaled_by(rows, found, columns), found


def scaled_by(rows: DataFrame, parameters: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of (other) rows scaled by the parameters of ``normalised_with``."""
    one = parameters.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("low", "width")))).alias("_p"))  # one row, an entry a column
    value = lambda c: (F.col(c) - F.col("_p")[c]["low"]) / F.col("_p")[c]["width"]
    return rows.crossJoin(F.broadcast(one)).withColumns({c: value(c) for c in columns}).drop("_p")


def spread_of(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, metric, n, low, high, total, mean, n_null) of the columns of each group."""
    stats = [F.struct(F.lit(c).alias("metric"), F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.sum(c).cast("double").alias("total"), F.avg(c).alias("mean"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in columns]
    return metrics.groupBy(*by).agg(F.array(*stats).alias("m")).select(*by, F.inline("m"))


def sequences_split(sequences: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Sequences (asset, ts, ...) with their part by their place among their asset's sequences in time."""
    w = Window.partitionBy("asset")
    i, n = F.row_number().over(w.orderBy("ts")), F.count("*").over(w)
    a, b = F.floor(n * train), F.floor(n * (train + val))
    return sequences.withColumn("part", F.when(i <= a, "train").when(i <= b, "val").otherwise("test"))


def capped_pairs(names: DataFrame, most: int) -> DataFrame:
    """(a, b, k) of the first ``most`` pairs of names (name), in the order of the first name and then of the second: what a run with a budget tests.

    The k-th pair is told by counting, so no more than ``most`` pairs are made.
    """
    ordered = names.select("name").distinct().orderBy("name").limit(most + 1)  # no more names can be in ``most`` pairs
    numbered = ordered.withColumn("i", F.row_number().over(Window.orderBy("name")))
    n = numbered.agg(F.count("*").alias("n"))
    first = numbered.crossJoin(F.broadcast(n)).withColumn("before", (F.col("i") - 1) * F.col("n") - F.expr("i * (i - 1) / 2")).where(F.col("before") < most)
    pairs = first.select(F.col("name").alias("a"), "i", "before").join(numbered.select(F.col("name").alias("b"), F.col("i").alias("j")), F.col("i") < F.col("j"))
    return pairs.withColumn("k", (F.col("before") + F.col("j") - F.col("i")).cast("long")).where(F.col("k") <= most).select("a", "b", "k")


def mood(text: str) -> Column:
    """Struct score, label, rising, falling of the words of both moods in a text; phrases of two words are found as such."""
    has = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.regexp_like(F.lower(text), F.concat(F.lit(r"(^|\W)"), w, F.lit(r"($|\W)")))))
    up, down = has(RISING), has(FALLING)
    score = F.coalesce(F.round(F.try_divide(up - down, up + down), 3), F.lit(0.0))
    return F.struct(score.alias("score"), F.when(score > 0.1, "bullish").when(score < -0.1, "bearish").otherwise("neutral").alias("label"), up.alias("rising"), down.alias("falling"))


def due(events: DataFrame, today: str, back: int = 7, ahead: int = 14, universe: DataFrame | None = None) -> DataFrame:
    """Events (symbol, date, ...) from ``back`` days before today to ``ahead`` days after, of the symbols of a universe (symbol), if given."""
    day = F.lit(today).cast("date")
    near = events.where(F.col("date").between(F.date_sub(day, back), F.date_add(day, ahead)))
    return near.join(universe.select("symbol").distinct(), "symbol", "left_semi") if universe is not None else near


def context(values: DataFrame, indicators: list[str], most: int = 4) -> DataFrame:
    """(country, indicator, ts, value): of (country, indicator, ts, value) the latest value of each country for the first ``most`` of a list of indicators."""
    few = list(dict.fromkeys(indicators))[:most]
    kept = values.where(F.col("indicator").isin(few) & F.col("value").isNotNull())
    return kept.groupBy("country", "indicator").agg(F.max(F.struct("ts", "value")).alias("l")).select("country", "indicator", "l.*")


def window_tensors(rows: DataFrame, columns: list[str], steps: int) -> DataFrame:
    """(asset, n_real, tensor): the last ``steps`` rows of each asset in time as a list of rows of ``columns``, nulls as 0, with rows of 0 in front where there are fewer."""
    w = Window.partitionBy("asset").orderBy(F.desc("ts"))
    last = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= steps)
    cell = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    made = last.groupBy("asset").agg(F.count("*").cast("int").alias("n_real"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), F.array(*map(cell, columns)).alias("x")))), lambda r: r["x"]).alias("t"))
    return made.select("asset", "n_real", F.concat(F.array_repeat(F.array_repeat(F.lit(0.0), len(columns)), F.lit(steps) - F.col("n_real")), "t").alias("tensor"))


def top_loadings(components: DataFrame, n: int = 5) -> DataFrame:
    """(component, side, place, column, loading): of each component the ``n`` largest loadings above zero and the ``n`` smallest below."""
    side = F.when(F.col("loading") > 0, "up").when(F.col("loading") < 0, "down")
    w = Window.partitionBy("component", "side").orderBy(F.desc(F.abs("loading")), "column")
    return components.withColumn("side", side).where("side is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("component", "side", "place", "column", "loading")


def factor_exposures(returns: DataFrame, factors: DataFrame, least_rows: int = 24) -> DataFrame:
    """(asset, factor, n, beta, r2): slope of returns (asset, ts, ret) on the changes of factor series (factor, ts, value) from one of their days to the next, on days that both have."""
    moved = factors.withColumn("x", F.col("value") - F.lag("value").over(Window.partitionBy("factor").orderBy("ts"))).where("x is not null").select("factor", "ts", "x")
    both = returns.join(moved, "ts")
    fits = both.groupBy("asset", "factor").agg(F.count("*").alias("n"), F.regr_slope("ret", "x").alias("beta"), F.regr_r2("ret", "x").alias("r2"))
    return fits.where(F.col("n") >= least_rows)
