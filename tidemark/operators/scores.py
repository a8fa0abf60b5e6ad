"""Scores and labels of single rows, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Floor of each categorical strength, and of all others (fixed values).
STRENGTHS = {"strong": 1.0, "moderate": 0.6, "weak": 0.3}
OTHER_STRENGTH = 0.3
#: What makes a source useful (fixed values).
CADENCES = ("realtime", "daily", "weekly", "monthly", "quarterly", "annual", "hourly")
VALUED_TYPES = ("ohlcv", "yields", "inflation", "employment", "gdp", "earnings", "fundamentals", "balance_sheet", "cash_flow", "volatility", "macro_series", "exchange_rates", "market_cap")
FINANCIAL = ("price", "macro", "fundamental", "crypto", "forex", "commodity", "alternative")
#: Level of a macro series that is assumed where there is none (fixed values).
USUAL = {"T10Y2Y": 0.0, "CPIAUCSL": 2.0, "T10YIE": 2.0, "BAMLH0A0HYM2": 4.0, "STLFSI4": 0.0, "VIXCLS": 20.0}


def finite(x: Column, places: int = 6) -> Column:
    """Rounded; null where it is not a number or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.round(x, places))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def share(x: Column, full: float) -> Column:
    """|x| as a share of what counts as full, at most 1; 0 where it is missing."""
    return F.least(F.abs(F.coalesce(x, F.lit(0.0))) / full, F.lit(1.0))


def significance(p: Column, unknown: float) -> Column:
    return F.coalesce(F.greatest(1 - p / 0.10, F.lit(0.0)), F.lit(unknown))


def strength_floor(strength: Column) -> Column:
    return reduce(lambda other, kv: F.when(strength == kv[0], kv[1]).otherwise(other), STRENGTHS.items(), F.lit(OTHER_STRENGTH))


def edge_confidence(relation: str = "rel_type", places: int | None = 4) -> Column:
    """0..1 by relation: sensitivity (t, beta, fit), cause (significance first) or correlation; from pearson_r, granger_p, mutual_info, beta, t_stat, p_value, r_squared, strength.

    A fit of 0 counts as unknown.
    """
    c, floor = F.col, strength_floor(F.col("strength"))
    shared = share(c("mutual_info"), 0.3) * 0.15 + floor * 0.15
    correlation = share(c("pearson_r"), 0.8) * 0.40 + significance(c("granger_p"), 0.4) * 0.30 + shared
    cause = significance(c("granger_p"), 0.3) * 0.45 + share(c("pearson_r"), 0.8) * 0.25 + shared
    t = F.coalesce(F.least(F.abs(c("t_stat")) / 4, F.lit(1.0)), F.greatest(1 - c("p_value") / 0.10, F.lit(0.0)), F.lit(0.4))
    fit = F.least(F.coalesce(F.nullif(c("r_squared"), F.lit(0.0)), F.lit(0.1)), F.lit(1.0))
    sensitivity = t * 0.35 + share(c("beta"), 1.0) * 0.25 + fit * 0.20 + floor * 0.20
    score = unit(F.when(c(relation) == "SENSITIVE_TO", sensitivity).when(c(relation) == "CAUSES", cause).otherwise(correlation))
    return score if places is None else F.round(score, places)


def usefulness() -> Column:
    """0..1 of a source (official, free, auth, cadence, schema_clarity 1..5, category, data_types, asset_types)."""
    yes = lambda c, w: F.coalesce(c, F.lit(False)).cast("int") * w
    valued = F.size(F.array_intersect("data_types", F.array(*map(F.lit, VALUED_TYPES))))
    relevance = yes(F.col("category").isin(*FINANCIAL), 0.5) + F.when(valued >= 3, 0.5).when(valued >= 1, 0.25 * F.least(valued, F.lit(2))).otherwise(0.0)
    broad = F.least((F.size("asset_types") + F.size("data_types")) / 8, F.lit(1.0))
    total = yes(F.col("official"), 0.20) + yes(F.col("free"), 0.15) + yes(~F.col("auth"), 0.08) + yes(F.col("cadence").isin(*CADENCES), 0.10) + 0.15 * (F.col("schema_clarity") - 1) / 4 + 0.20 * F.least(relevance, F.lit(1.0)) + 0.12 * broad
    return F.round(F.least(total, F.lit(1.0)), 4)


def proposal_priority(score: str) -> Column:
    return F.when(F.col(score) >= 0.65, "high").when(F.col(score) >= 0.40, "medium").otherwise("low")


def votes(oversold: float = 30, overbought: float = 70) -> Column:
    """Array of 1 (buy), -1 (sell) and 0 of rsi_14, macd, bb_pct and ema_9_21_cross; indicators that are missing have no vote."""
    rsi, bb = F.col("rsi_14"), F.col("bb_pct")
    each = [F.when(rsi < oversold, 1).when(rsi > overbought, -1).when(rsi.isNotNull(), 0), F.when(F.col("macd") > F.col("macd_signal"), 1).when(F.col("macd").isNotNull() & F.col("macd_signal").isNotNull(), -1), F.when(bb < 0.2, 1).when(bb > 0.8, -1).when(bb.isNotNull(), 0), F.when(F.col("ema_9_21_cross") == 1, 1).when(F.col("ema_9_21_cross").isNotNull(), -1)]
    return F.filter(F.array(*each), lambda v: v.isNotNull())


def consensus() -> Column:
    """Struct overall, score (percent of all votes, the trend's among them), bull, bear: a side wins by two votes."""
    v, adx = votes(), F.col("adx_14").isNotNull().cast("int")
    bull, bear = F.size(F.filter(v, lambda x: x == 1)), F.size(F.filter(v, lambda x: x == -1))
    overall = F.when(bull > bear + 1, "bullish").when(bear > bull + 1, "bearish").otherwise("neutral")
    return F.struct(overall.alias("overall"), F.round((bull - bear) / F.greatest(F.size(v) + adx, F.lit(1)) * 100, 1).alias("score"), bull.alias("bull"), bear.alias("bear"))


def quick_signal() -> Column:
    """bullish or bearish by a plain majority of rsi_14 (35 and 65), macd and crossing; a missing macd counts against."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    macd, cross = F.coalesce("macd", F.lit(0.0)) > F.coalesce("macd_signal", F.lit(0.0)), F.col("ema_9_21_cross")
    bull = one(F.col("rsi_14") < 35) + one(macd) + one(cross == 1)
    bear = one(F.col("rsi_14") > 65) + one(~macd) + one(cross != 1)
    return F.when(bull > bear, "bullish").when(bear > bull, "bearish").otherwise("neutral")


def rule_probability() -> Column:
    """Mean of the votes of rsi_14, macd, bb_pct, ema_9_21_cross and rolling_sharpe_21."""
    rsi, bb, cross, sharpe = (F.col(c) for c in ("rsi_14", "bb_pct", "ema_9_21_cross", "rolling_sharpe_21"))
    each = F.array(
        F.when(rsi < 30, 1.0).when(rsi > 70, 0.0).when(rsi.isNotNull(), 0.5), F.when(F.coalesce("macd", F.lit(0.0)) > F.coalesce("macd_signal", F.lit(0.0)), 0.65).otherwise(0.35),
        F.when(bb < 0.2, 0.72).when(bb > 0.8, 0.28).when(bb.isNotNull(), 0.5), F.when(cross == 1, 0.68).when(cross == -1, 0.32), F.when(sharpe > 0.5, 0.62).when(sharpe < -0.5, 0.38),
    )
    there = F.filter(each, lambda v: v.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda a, b: a + b) / F.size(there)


def direction(p: str) -> Column:
    return F.when(F.col(p) > 0.55, "bullish").when(F.col(p) < 0.45, "bearish").otherwise("neutral")


def certainty(p: str) -> Column:
    away = F.abs(F.col(p) - 0.5)
    return F.when(away > 0.15, "high").when(away > 0.07, "medium").otherwise("low")


def macro_regime(latest: DataFrame) -> DataFrame:
    """growth, inflation, credit, risk (-1, 0, 1) and quadrant of rows with a column for each series of ``USUAL``; missing levels are usual."""
    level = lambda s: F.coalesce(F.col(s), F.lit(USUAL[s]))
    curve, cpi, expected, spread, tension, fear = (level(s) for s in USUAL)
    done = latest.withColumns(
        {
            "growth": F.when(curve > 0.5, 1).when(curve < -0.25, -1).otherwise(0), "inflation": F.when((cpi > 4) | (expected > 3), 1).when((cpi < 1.5) | (expected < 1.5), -1).otherwise(0),
            "credit": F.when((spread > 6) | (tension > 1.5), -1).when((spread < 3) & (tension < -0.5), 1).otherwise(0), "risk": F.when(fear > 30, -1).when(fear < 15, 1).otherwise(0),
        }
    )
    up, hot = F.col("growth") >= 0, F.col("inflation") > 0
    return done.withColumn("quadrant", F.when(up & hot, "reflation").when(up, "goldilocks").when(hot, "stagflation").otherwise("deflation_risk"))


def namespaced(node: str, kinds: dict[str, str]) -> Column:
    """Struct kind, label of ``prefix:label``; without a known prefix the kind is unknown and the label the whole."""
    prefix = F.substring_index(node, ":", 1)
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), prefix)
    return F.struct(F.coalesce(kind, F.lit("unknown")).alias("kind"), F.when(kind.isNotNull() & F.contains(F.col(node), F.lit(":")), F.substring(F.col(node), F.length(prefix) + 2, F.length(node))).otherwise(F.col(node)).alias("label"))


def plain_url(url: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(url)), "/+$", "")


def columns_digest(df: DataFrame) -> str:
    """A digest of the set of column names that is the same in every process."""
    import hashlib

    return hashlib.sha256(",".join(sorted(df.columns)).encode()).hexdigest()


def colour(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """-1..1: by its range where there is one, else by tanh."""
    return F.tanh(x) if low is None else F.greatest(F.least((x - low) / (high - low) * 2 - 1, F.lit(1.0)), F.lit(-1.0))
