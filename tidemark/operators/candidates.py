"""Candidates for sources: brought to one form, what a connector for them would need, and evidence and claims made of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scores import proposal_priority

#: Categories, and the category of each type of asset.
CATEGORIES = ("price", "macro", "fundamental", "alternative", "news", "sentiment", "crypto", "forex", "commodity")
ASSET_CATEGORIES = {"equity": "price", "etf": "price", "crypto": "crypto", "forex": "forex", "commodity": "commodity", "macro": "macro", "bond": "macro", "futures": "price"}
#: Other names of cadences.
CADENCES = {
    "rt": "realtime", "real-time": "realtime", "real_time": "realtime", "live": "realtime", "1d": "daily", "eod": "daily", "end of day": "daily", "1w": "weekly", "1m": "monthly", "mo": "monthly",
    "q": "quarterly", "qtr": "quarterly",
}
#: The fields that each type of data comes with.
FIELDS = {
    "ohlcv": ("date", "open", "high", "low", "close", "volume"),
    "yields": ("date", "maturity", "yield_pct"),
    "inflation": ("date", "series_id", "value"),
    "gdp": ("date", "country", "value", "unit"),
    "employment": ("date", "series_id", "value"),
    "wages": ("date", "series_id", "value"),
    "cpi": ("date", "series_id", "value"),
    "exchange_rates": ("date", "base", "target", "rate"),
    "macro_series": ("date", "series_id", "value", "unit"),
    "fundamentals": ("ticker", "period", "metric", "value"),
    "earnings": ("ticker", "period", "eps", "revenue"),
    "balance_sheet": ("ticker", "period", "assets", "liabilities", "equity"),
    "cash_flow": ("ticker", "period", "operating", "investing", "financing"),
    "volatility": ("date", "index", "value"),
    "news": ("published_at", "title", "url", "source"),
    "sentiment": ("date", "entity", "score", "source"),
    "market_cap": ("date", "ticker", "market_cap", "circulating_supply"),
    "money_supply": ("date", "series_id", "value", "unit"),
    "trade": ("date", "country", "export_value", "import_value"),
}
#: When a source of each cadence is read.
SCHEDULES = {"realtime": "every few minutes", "hourly": "0 * * * *", "daily": "0 20 * * 1-5", "weekly": "0 6 * * 1", "monthly": "0 6 2 * *", "quarterly": "after the reports of a quarter", "annual": "by hand, on a fixed date"}
#: Fixed value: characters of an id made of a name.
ID_CHARS = 64


def looked_up(table: dict, key: Column) -> Column:
    pairs = (x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)))
    return F.try_element_at(F.create_map(*pairs), key)


def slug(name: Column) -> Column:
    """Letters and digits in lower case, anything else as one _, none at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, ID_CHARS)


def listed(items: Column) -> Column:
    """Distinct entries in lower case without blanks around them, in their order; nulls and empty ones left out."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x != "", F.lit(False))))


def normalised(raw: DataFrame) -> DataFrame:
    """Candidates (name, url, source_id, category, asset_types, data_types, method, cadence, auth, free, official, clarity) in one form, with ``problem`` where name or url is missing.

    A missing id is made of the name; a category that is not known is that of the first known type of asset, else unknown; other names of a
    cadence become its own; clarity is 1 to 5. What is missing: method api, cadence unknown, no auth, free, not official, clarity 3.
    """
    text = lambda c, other: F.lower(F.trim(F.coalesce(c, F.lit(other))))
    name, url, assets, own = F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("url", F.lit(""))), listed(F.col("asset_types")), text("category", "")
    known = F.filter(F.transform(assets, lambda a: looked_up(ASSET_CATEGORIES, a)), lambda c: c.isNotNull())
    cadence = text("cadence", "unknown")
    return raw.select(
        F.coalesce("source_id", slug(name)).alias("source_id"), name.alias("name"), url.alias("url"), F.when(own.isin(*CATEGORIES), own).otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit("unknown"))).alias("category"),
        text("method", "api").alias("method"), F.coalesce(looked_up(CADENCES, cadence), cadence).alias("cadence"), F.coalesce("auth", F.lit(False)).alias("auth"), F.coalesce("free", F.lit(True)).alias("free"), F.coalesce("official", F.lit(False)).alias("official"),
        assets.alias("asset_types"), listed(F.col("data_types")).alias("data_types"), F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("clarity", F.lit(3)))).cast("int").alias("clarity"),
        F.when(name == "", "no name").when(url == "", "no url").alias("problem"),
    )


def proposals(candidates: DataFrame) -> DataFrame:
    """(source_id, priority, method, fields, schedule, access, checks) of normalised candidates with a score: what their connector would read, when, with which access, and what to check."""
    shape = F.array_distinct(F.flatten(F.transform("data_types", lambda t: F.coalesce(looked_up(FIELDS, t), F.array(F.concat(F.lit("field_"), t))))))
    has = lambda *types: F.arrays_overlap("data_types", F.array(*map(F.lit, types)))
    key = F.concat(F.upper("source_id"), F.lit("_API_KEY"))
    checks = [
        F.when(has("ohlcv"), "prices between low and high, some volume"), F.when(has("yields", "inflation", "gdp", "cpi"), "values in their usual range"), F.when(has("news", "sentiment"), "one row a url, times that can be read"),
        F.when(F.col("method") == "file_download", "size and checksum"), F.when(F.col("method").isin("api", "sdk"), "status, limits of rate"), F.lit("nulls below 5 percent"),
    ]
    access = F.when(~F.col("auth"), "none").when(F.col("free"), F.concat(F.lit("free key "), key)).otherwise(F.concat(F.lit("paid key "), key))
    return candidates.where("problem is null").select(
        "source_id", proposal_priority("score").alias("priority"), "method", F.when(F.size(shape) > 0, shape).otherwise(F.array(F.lit("date"), F.lit("value"))).alias("fields"),
        F.coalesce(looked_up(SCHEDULES, F.col("cadence")), F.lit("not known")).alias("schedule"), access.alias("access"), F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("checks"),
    )


# claims: (claim_type, subject, predicate, object, confidence, tags, counterpoints, notes), all of them proposed; the forms of subjects and objects are fixed values
def claim(kind: str, subject: Column, predicate: str, obj: Column, confidence: Column, tags: list[Column], notes: Column, counterpoints: list[Column] | None = None) -> list[Column]:
    some = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")
    number = F.round(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), 4)
    return [F.lit(kind).alias("claim_type"), subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), number.alias("confidence"), F.lit("proposed").alias("status"), some(tags).alias("tags"), some(counterpoints or []).alias("counterpoints"), notes.alias("notes")]


def source_claims(candidates: DataFrame) -> DataFrame:
    """That a scored candidate is useful for its category; as sure as its score."""
    return candidates.where("problem is null").select(*claim("source_usefulness", F.concat(F.lit("source:"), "source_id"), "is_useful_for", F.concat(F.lit("domain:"), "category"), F.col("score"), [F.lit("scout"), F.col("category"), F.col("method")], F.concat(F.col("name"), F.lit(": by its description alone"))))


def feature_claims(found: DataFrame) -> DataFrame:
    """Of (feature, model, dataset, gain, confidence): that a feature improves a model on a data set."""
    return found.select(*claim("feature_usefulness", F.concat(F.lit("feature:"), "feature"), "improves_accuracy_on", F.concat(F.lit("model:"), "model", F.lit("_dataset:"), "dataset"), F.col("confidence"), [F.col("model")], F.format_string("accuracy %+.4f", "gain")))


def relationship_claims(pairs: DataFrame, criterion: str) -> DataFrame:
    """Of (a, b, r): that two assets are correlated under a criterion; as sure as |r|."""
    return pairs.select(*claim("relationship", F.concat(F.lit("asset:"), "a"), "is_correlated_with", F.concat(F.lit("asset:"), "b", F.lit(f"_criterion:{criterion}")), F.abs("r"), [F.lit("correlation")], F.format_string("r %+.4f", "r")))


def performance_claims(results: DataFrame, metric: str, threshold: float, confidence: float = 0.5) -> DataFrame:
    """Of (model, symbol, dataset, ``metric``): that the model meets the threshold; only those that do."""
    met = results.where(F.col(metric) >= threshold)
    return met.select(*claim("performance", F.concat(F.lit("model:"), "model", F.lit("_on_"), "symbol"), "meets_performance_bar", F.concat(F.lit(f"metric:{metric}_threshold:{threshold:.4f}_dataset:"), "dataset"), F.lit(confidence), [F.col("symbol"), F.col("model")], F.format_string(f"{metric} %.4f of {threshold:.4f}", metric)))


def fold_claims(summary: DataFrame) -> DataFrame:
    """Of each model's folds (symbol, model, n_folds, mean_accuracy, std_accuracy, n_beat, overall): the accuracy that it reaches, and that the best of a symbol leads the others.

    Fixed values: 0.70 for a model that passes its gates, 0.58 from a mean of 0.52 if it beats the market on most folds, else 0.42; 0.60 for the leader (mean accuracy, ties by name).
    """
    most = F.col("n_beat") >= F.floor((F.col("n_folds") + 1) / 2)
    sure = F.when(F.col("overall"), 0.70).when((F.col("mean_accuracy") >= 0.52) & most, 0.58).otherwise(0.42)
    subject = F.concat(F.lit("model:"), "model", F.lit("_on_"), F.upper("symbol"))
    against = [F.when(F.col("std_accuracy") > 0.06, F.format_string("accuracy varies over folds by %.3f", "std_accuracy")), F.when(~most, F.format_string("beats the market on %d of %d folds", "n_beat", "n_folds"))]
    each = summary.select(*claim("performance", subject, "achieves_wf_mean_accuracy", F.format_string("acc:%.4f_folds:%d", "mean_accuracy", "n_folds"), sure, [F.lit("walk_forward"), F.upper("symbol"), F.col("model"), F.when(F.col("overall"), "wf_promoted").otherwise("wf_not_promoted")], F.format_string("mean %.3f, deviation %.3f", "mean_accuracy", "std_accuracy"), against))
    w = Window.partitionBy("symbol")
    order = w.orderBy(F.desc(F.round("mean_accuracy", 9)), "model")
    ranked = summary.withColumns({"_k": F.row_number().over(order), "_all": F.array_sort(F.collect_list("model").over(w))}).where("_k = 1 and size(_all) > 1")  # a handful of models
    others = F.array_join(F.array_remove("_all", F.col("model")), "+")
    lead = ranked.select(*claim("performance", subject, "leads_walk_forward_comparison", F.concat(F.lit("vs:"), others), F.lit(0.60), [F.lit("wf_comparison_winner"), F.lit("walk_forward"), F.upper("symbol"), F.col("model")], F.format_string("mean %.3f", "mean_accuracy"), [F.lit("differences may be small beside those between folds")]))
    return each.unionAll(lead)


def probe_evidence(probes: DataFrame) -> DataFrame:
    """Evidence (evidence_id, source_type, source_ref, summary) of probes (source_id, name, url, ok, http_status, method, latency_ms, probed_at)."""
    ref = F.concat(F.lit("probe:"), "source_id", F.lit(":"), F.date_format("probed_at", "yyyy-MM-dd"))
    told = F.concat(F.col("name"), F.lit(" at "), F.col("url"), F.when(F.col("ok"), " is there").otherwise(" is not there"), F.lit(", status "), F.coalesce(F.col("http_status").cast("string"), F.lit("n/a")), F.lit(" by "), F.col("method"), F.format_string(", %.0f ms", "latency_ms"))
    return probes.select(F.substring(F.sha2(ref, 256), 1, 12).alias("evidence_id"), F.lit("source_registry").alias("source_type"), ref.alias("source_ref"), told.alias("summary"))


def source_evidence(candidates: DataFrame) -> DataFrame:
    """Evidence (evidence_id, source_type, source_ref, summary) of scored candidates: what they are by their description."""
    ref = F.concat(F.lit("scout:"), "source_id")
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    told = F.concat(F.col("name"), F.format_string(", score %.2f, ", "score"), F.col("category"), F.lit(", official "), yes("official"), F.lit(", free "), yes("free"), F.lit(", by "), F.col("method"))
    return candidates.where("problem is null").select(F.substring(F.sha2(ref, 256), 1, 12).alias("evidence_id"), F.lit("source_registry").alias("source_type"), ref.alias("source_ref"), told.alias("summary"))


def answered(heads: DataFrame, gets: DataFrame) -> DataFrame:
    """Probes (source_id, http_status, latency_ms): a HEAD, or where that is refused (405, 501) the GET; ``method`` says which."""
    refused = F.col("http_status").isin(405, 501)
    again = heads.where(refused).select("source_id").join(gets, "source_id").withColumn("method", F.lit("GET"))
    kept = heads.join(again.select("source_id"), "source_id", "left_anti").withColumn("method", F.lit("HEAD"))
    return kept.unionByName(again)


def probe_summary(probes: DataFrame, n_known: int | Column) -> DataFrame:
    """total, attempted, reachable, failed, skipped, avg_latency_ms (of answers of real requests that took time) and success_rate of probes (ok, method, latency_ms)."""
    total = F.lit(n_known) if isinstance(n_known, int) else n_known
    timed = F.when(F.col("ok") & (F.col("method") != "NONE") & (F.col("latency_ms") > 0), F.col("latency_ms"))
    done = probes.agg(F.count("*").alias("attempted"), F.count_if("ok").alias("reachable"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg(timed), 1).alias("avg_latency_ms"))
    return done.select(total.alias("total"), "attempted", "reachable", "failed", (total - F.col("attempted")).alias("skipped"), "avg_latency_ms", F.try_divide(F.col("reachable").cast("double"), "attempted").alias("success_rate"))
