"""The expanded feature set over bars (asset, ts, open, high, low, close, volume), by groups.

Each group adds columns; ``feature_matrix`` chains the chosen ones. Formulas differ from the base set where
the names do not (rsi is by plain means here). Divisors of 0 give null. A crossing is the change of a sign,
from -2 to 2, and 0 on the first bar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import ewm, flag, in_time, lag, last_rows, roll, rolled, so_far, span
from tidemark.operators.asof import asof, event_distance
from tidemark.operators.features import YEAR, true_range

#: Column and key of the fundamental statistics (fixed values).
FUNDAMENTALS = {
    "pe_ratio": "trailingPE", "forward_pe": "forwardPE", "ps_ratio": "priceToSalesTrailing12Months", "pb_ratio": "priceToBook", "ev_ebitda": "enterpriseToEbitda", "peg_ratio": "pegRatio",
    "profit_margin": "profitMargins", "oper_margin": "operatingMargins", "roa": "returnOnAssets", "roe": "returnOnEquity", "gross_margin": "grossMargins",
    "rev_growth": "revenueGrowth", "earn_growth": "earningsGrowth", "earn_qtr_growth": "earningsQuarterlyGrowth",
    "debt_equity": "debtToEquity", "current_ratio": "currentRatio", "quick_ratio": "quickRatio", "free_cashflow": "freeCashflow",
    "short_ratio": "shortRatio", "short_pct": "shortPercentOfFloat", "beta_fund": "beta", "div_yield": "dividendYield",
}
#: Flag, macro series, side and threshold (fixed values).
MACRO_FLAGS = (
    ("yield_curve_inverted", "t10y2y", "<", 0.0), ("yield_curve_stress", "t10y2y", "<", -0.5), ("credit_stress", "bamlh0a0hym2", ">", 5.0), ("credit_crisis", "bamlh0a0hym2", ">", 8.0),
    ("high_vol_regime", "vixcls", ">", 25.0), ("panic_regime", "vixcls", ">", 35.0),
)


def sign_change(x: Column) -> Column:
    return F.coalesce(F.signum(x) - F.lag(F.signum(x)).over(in_time()), F.lit(0.0))


def momentum(bars: DataFrame) -> DataFrame:
    """rsi_{7,14,21,63} of plain means (null without losses), ret_{1,5,10,21,63,126,252}d."""
    move = F.col("close") - lag("close")
    step = bars.withColumns({"_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))})
    rsi = {f"rsi_{n}": 100 - 100 / (1 + F.try_divide(roll(F.avg, "_gain", n), roll(F.avg, "_loss", n))) for n in (7, 14, 21, 63)}
    return step.withColumns(rsi | {f"ret_{n}d": F.try_divide("close", lag("close", n)) - 1 for n in (1, 5, 10, 21, 63, 126, 252)}).drop("_gain", "_loss")


def trend(bars: DataFrame) -> DataFrame:
    """macd, macd_signal, macd_hist, macd_cross; ema_{8,20,50,100,200}, above_ema*, their crossings and distances."""
    means = {f"ema_{n}": ("close", span(n)) for n in (8, 12, 20, 26, 50, 100, 200)} | {"macd_signal": (("ema_12", "ema_26"), span(9))}
    step = ewm(bars, means).withColumn("macd", F.col("ema_12") - F.col("ema_26")).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    above = {f"above_ema{n}": flag(F.col("close") > F.col(f"ema_{n}")) for n in (20, 50, 200)}
    away = {f"dist_ema{n}": F.try_divide(F.col("close") - F.col(f"ema_{n}"), F.col(f"ema_{n}")) for n in (20, 200)}
    cross = {"macd_cross": sign_change(F.col("macd_hist")), "ema20_50_cross": sign_change(F.col("ema_20") - F.col("ema_50")), "ema50_200_cross": sign_change(F.col("ema_50") - F.col("ema_200"))}
    return step.withColumns(above | away | cross).drop("ema_12", "ema_26")


def volatility(bars: DataFrame) -> DataFrame:
    """atr, atr_norm, vol_{5,10,21,63}d, vol_of_vol, vol_ratio."""
    step = bars.withColumns({"_log": F.ln(F.try_divide("close", lag("close"))), "_tr": true_range()})
    step = step.withColumns({f"vol_{n}d": roll(F.stddev_samp, "_log", n) * YEAR for n in (5, 10, 21, 63)} | {"atr": roll(F.avg, "_tr", 14)})
    return step.withColumns({"vol_of_vol": roll(F.stddev_samp, "vol_21d", 21), "vol_ratio": F.try_divide("vol_5d", "vol_63d"), "atr_norm": F.try_divide("atr", "close")}).drop("_log", "_tr")


def volatility_regime(bars: DataFrame) -> DataFrame:
    """vol_regime 0..3 by right-closed bins, vol_pct_rank in the last 252 bars, vol_expanding, variance_ratio, vol_breakout; needs ``volatility``."""
    vol = F.col("vol_21d")
    regime = F.when((vol > 0) & (vol <= 0.15), 0).when((vol > 0.15) & (vol <= 0.25), 1).when((vol > 0.25) & (vol <= 0.35), 2).when((vol > 0.35) & (vol <= 10), 3)
    ratio = F.try_divide(F.pow("vol_5d", 2), F.pow("vol_63d", 2))
    return rolled(bars, {"vol_pct_rank": ("rank", 252, ("vol_21d",))}).withColumns({"vol_regime": regime, "vol_expanding": flag(F.col("vol_5d") > vol), "variance_ratio": ratio, "vol_breakout": flag(ratio > 2)})


def bands(bars: DataFrame) -> DataFrame:
    """bb_mid, bb_upper, bb_lower, bb_pct, bb_width, bb_squeeze (below the lower quartile of 125 bars), stoch_k, stoch_d, stoch_od."""
    mid, off = roll(F.avg, "close", 20), 2 * roll(F.stddev_samp, "close", 20)
    low, high = roll(F.min, "low", 14), roll(F.max, "high", 14)
    step = bars.withColumns({"bb_mid": mid, "bb_upper": mid + off, "bb_lower": mid - off, "stoch_k": 100 * F.try_divide(F.col("close") - low, high - low)})
    step = step.withColumns({"bb_pct": F.try_divide(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), "bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")), "stoch_d": roll(F.avg, "stoch_k", 3)})
    quartile = F.when(F.count("bb_width").over(last_rows(125)) == 125, F.percentile("bb_width", F.lit(0.25)).over(last_rows(125)))
    return step.withColumns({"bb_squeeze": flag(F.col("bb_width") < quartile), "stoch_od": flag(F.col("stoch_k") > F.col("stoch_d"))})


def volume(bars: DataFrame) -> DataFrame:
    """obv, obv_ema20 (weights of the whole past), obv_slope; rel_volume, vwap_20, dist_vwap, ad_line (null where high equals low); rolling_high, rolling_low, dist_to_high, dist_to_low, range_position."""
    clv = F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    step = bars.withColumns({"_signed": F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume"), "_tv": typical * F.col("volume"), "_flow": clv * F.col("volume")})
    step = step.withColumns({"obv": F.sum("_signed").over(so_far()), "vwap_20": F.try_divide(roll(F.sum, "_tv", 20), roll(F.sum, "volume", 20)), "rel_volume": F.try_divide("volume", roll(F.avg, "volume", 20)),
                             "ad_line": F.when(F.col("_flow").isNotNull(), F.sum("_flow").over(so_far())), "rolling_high": roll(F.max, "high", 20), "rolling_low": roll(F.min, "low", 20)})
    step = step.withColumns({"obv_slope": (F.col("obv") - lag("obv", 5)) / 5, "dist_vwap": F.try_divide(F.col("close") - F.col("vwap_20"), F.col("vwap_20")), "dist_to_high": F.try_divide(F.col("rolling_high") - F.col("close"), "close"), "dist_to_low": F.try_divide(F.col("close") - F.col("rolling_low"), "close")})
    step = step.withColumn("range_position", F.try_divide("dist_to_low", F.col("dist_to_high") + F.col("dist_to_low"))).drop("_signed", "_tv", "_flow")
    return ewm(step, {"obv_ema20": ("obv", span(20))}, adjust=("obv_ema20",))


def references(bars: DataFrame, assets: dict[str, str], column: str) -> DataFrame:
    """(ts, one column for each name): a value of some assets, a row a day."""
    return bars.where(F.col("asset").isin(*assets.values())).groupBy("ts").agg(*(F.max(F.when(F.col("asset") == a, F.col(column))).alias(n) for n, a in assets.items()))


def cross_asset(bars: DataFrame, peers: dict[str, str], benchmark: str) -> DataFrame:
    """corr_{peer}_{21,63}d with each peer, beta_{21,63,252}d and rel_strength_{21,63,126,252}d to the benchmark's bars of the same days."""
    step = bars.withColumn("_ret", F.try_divide("close", lag("close")) - 1)
    names = {f"_r_{n}": a for n, a in peers.items()} | {"_r_bench": benchmark}
    step = step.join(references(step, names, "_ret"), "ts", "left").join(references(bars, {"_bench": benchmark}, "close"), "ts", "left")
    corr = {f"corr_{p}_{n}d": ("corr", n, ("_ret", f"_r_{p}")) for p in peers for n in (21, 63)}
    beta = {f"beta_{n}d": ("beta", n, ("_ret", "_r_bench")) for n in (21, 63, 252)}
    strength = {f"rel_strength_{n}d": F.try_divide("close", lag("close", n)) - F.try_divide("_bench", lag("_bench", n)) for n in (21, 63, 126, 252)}
    return rolled(step, corr | beta).withColumns(strength).drop("_ret", "_bench", *names)


def aligned(bars: DataFrame, series: DataFrame, names: list[str], prefix: str, skip_nulls: bool = True) -> DataFrame:
    """``bars`` with the latest value of each series (indicator, ts, value) at or before the day, as {prefix}{name}.

    Values are aligned to the days of the calendar, then joined to the bars by day.
    """
    days = bars.select("ts").distinct().withColumn("indicator", F.explode(F.array(*map(F.lit, names))))
    found = asof(days, series.where(F.col("indicator").isin(*names)), "indicator", "value", skip_nulls)
    wide = found.groupBy("ts").agg(*(F.max(F.when(F.col("indicator") == n, F.col("value"))).alias(f"{prefix}{n.lower()}") for n in names))
    return bars.join(wide, "ts", "left")


def macro(bars: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """macro_{series}, the flags of ``MACRO_FLAGS`` whose series is there, macro_{series}_chg{21,63}d over bars."""
    step = aligned(bars, series, names, "macro_")
    have = {n.lower() for n in names}
    flags = {c: flag(F.col(f"macro_{n}") < at if side == "<" else F.col(f"macro_{n}") > at) for c, n, side, at in MACRO_FLAGS if n in have}
    return step.withColumns(flags | {f"macro_{n}_chg{k}d": F.col(f"macro_{n}") - lag(f"macro_{n}", k) for n in sorted(have) for k in (21, 63)})


def macro_lags(bars: DataFrame, series: DataFrame, names: list[str], slope: tuple[str, str] | None = None) -> DataFrame:
    """{name}_lag{1,5,21} of the latest row, null or not; yield_curve_slope: the lagged difference of two of them."""
    step = aligned(bars, series, names, "_m_", skip_nulls=False)
    lags = {f"{n}_lag{k}": lag(f"_m_{n.lower()}", k) for n in names for k in (1, 5, 21)}
    step = step.withColumns(lags | ({"yield_curve_slope": lag(f"_m_{slope[0].lower()}") - lag(f"_m_{slope[1].lower()}")} if slope else {}))
    return step.drop(*(f"_m_{n.lower()}" for n in names))


def sentiment(bars: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """sent_{name} and its change over five bars."""
    step = aligned(bars, series, names, "sent_")
    return step.withColumns({f"sent_{n.lower()}_5d_chg": F.col(f"sent_{n.lower()}") - lag(f"sent_{n.lower()}", 5) for n in names})


def fundamentals(bars: DataFrame, stats: DataFrame) -> DataFrame:
    """The 22 statistics of each asset on all its bars; ``stats`` (asset, stats: map of string to double)."""
    wide = stats.select("asset", *(F.col("stats")[key].alias(c) for c, key in FUNDAMENTALS.items()))
    return bars.join(wide, "asset", "left")


def calendar(bars: DataFrame) -> DataFrame:
    """day_of_week (Monday is 0), month, quarter, day_of_month, week_of_year (ISO), near_opex (Fridays from the 14th to the 22nd), season flags."""
    day, month, week = F.dayofmonth("ts"), F.month("ts"), F.weekday("ts")
    flags = {"near_opex": day.between(14, 22) & (week == 4), "is_january": month == 1, "is_december": month == 12, "sell_in_may": month.between(5, 10), "is_monday": week == 0, "is_friday": week == 4, "end_of_quarter": (month % 3 == 0) & (day >= 25)}
    return bars.withColumns({"day_of_week": week, "month": month, "quarter": F.quarter("ts"), "day_of_month": day, "week_of_year": F.weekofyear("ts")} | {n: flag(c) for n, c in flags.items()})


def earnings(bars: DataFrame, dates: list[str]) -> DataFrame:
    """earnings_days_until, earnings_days_since, within_earnings_window (five days before to two after); without dates null, null and 0."""
    if not dates:
        return bars.withColumns({"earnings_days_until": F.lit(None).cast("int"), "earnings_days_since": F.lit(None).cast("int"), "within_earnings_window": F.lit(0)})
    done = event_distance(bars, dates).withColumnsRenamed({"days_until": "earnings_days_until", "days_since": "earnings_days_since"}).drop("days_nearest", "near_event")
    return done.withColumn("within_earnings_window", flag(F.col("earnings_days_until") <= 5).bitwiseOR(flag(F.col("earnings_days_since") <= 2)))


def events(bars: DataFrame, fomc: list[str], cpi: list[str]) -> DataFrame:
    """days_to_fomc, near_fomc (within three days), days_to_cpi, near_cpi (within two): to the nearest date on either side."""
    for name, dates, within in (("fomc", fomc, 3), ("cpi", cpi, 2)):
        bars = event_distance(bars, dates).withColumnRenamed("days_nearest", f"days_to_{name}").drop("days_until", "days_since", "near_event").withColumn(f"near_{name}", flag(F.col(f"days_to_{name}") <= within))
    return bars


#: Groups that need bars alone; the others are passed as functions.
GROUPS: dict[str, Callable[[DataFrame], DataFrame]] = {"momentum": momentum, "trend": trend, "volatility": volatility, "volatility_regime": volatility_regime, "bands": bands, "volume": volume, "calendar": calendar}


def feature_matrix(bars: DataFrame, groups: dict[str, Callable[[DataFrame], DataFrame]] = GROUPS, keep: float = 0.5) -> DataFrame:
    """All columns of the chosen groups; rows stay if at least int(columns - keep * features) values are there (ts and asset are the index)."""
    done = bars
    for group in groups.values():
        done = done.transform(group)
    columns = [c for c in done.columns if c not in ("asset", "ts")]
    n_features = len(columns) - len([c for c in bars.columns if c not in ("asset", "ts")])
    there = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return done.where(there >= int(len(columns) - keep * n_features))


def sequences(bars: DataFrame, columns: list[str], length: int, horizon: int = 1, target: str = "close") -> DataFrame:
    """(asset, ts, steps: the ``length`` rows before, target ``horizon`` - 1 rows on); only where all of them are there."""
    rows = F.collect_list(F.array(*columns)).over(in_time().rowsBetween(-length, -1))
    ahead = F.lead(target, horizon - 1).over(in_time()) if horizon > 1 else F.col(target)
    made = bars.select("asset", "ts", rows.alias("steps"), ahead.alias("target"), F.lead(target, horizon).over(in_time()).alias("_more"))
    return made.where((F.size("steps") == length) & F.col("_more").isNotNull()).drop("_more")


def trailing_z(series: DataFrame, window: int, places: int = 3) -> DataFrame:
    """z of (indicator, ts, value) over min(window, length of the series) rows; 0 without variation."""
    from pyspark.sql import Window

    order = Window.partitionBy("indicator").orderBy("ts")
    w, rows = order.rowsBetween(-(window - 1), 0), F.count("value").over(Window.partitionBy("indicator"))
    full = F.count("value").over(w) == F.least(F.lit(window), rows)
    sd = F.stddev_samp("value").over(w)
    return series.withColumn("z", F.when(full, F.round(F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(w), sd), F.lit(0.0)), places)))


def scaled_levels(series: DataFrame) -> DataFrame:
    """First differences of (indicator, ts, value) on business days, over their standard deviation.

    A weekend's value counts on the Friday before; days without a value carry the last one.
    """
    from pyspark.sql import Window

    friday = F.date_sub("ts", F.greatest(F.weekday("ts") - 4, F.lit(0)))
    daily = series.groupBy("indicator", friday.alias("day")).agg(F.max_by("value", "ts").alias("value"))
    ends = daily.groupBy("indicator").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select("indicator", F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    order = Window.partitionBy("indicator").orderBy("day")
    level = days.join(daily, ["indicator", "day"], "left").withColumn("level", F.last("value", ignorenulls=True).over(order))
    step = level.withColumn("step", F.col("level") - F.lag("level").over(order)).where("step is not null")
    return step.select("indicator", F.col("day").alias("ts"), F.try_divide("step", F.stddev_samp("step").over(Window.partitionBy("indicator"))).alias("value"))


def price_tape(bars: DataFrame) -> DataFrame:
    """change_pct to the bar before, high_252 and low_252 of the bars there are."""
    return bars.withColumns({"change_pct": (F.try_divide("close", lag("close")) - 1) * 100, "high_252": F.max("close").over(last_rows(252)), "low_252": F.min("close").over(last_rows(252))})


def latest_returns(bars: DataFrame) -> DataFrame:
    """ret_1d, ret_5d, ret_21d, ret_63d, ret_ytd (252 bars) of each asset's last bar, in percent."""
    step = bars.withColumns({f"ret_{n}": (F.try_divide("close", lag("close", k)) - 1) * 100 for n, k in (("1d", 1), ("5d", 5), ("21d", 21), ("63d", 63), ("ytd", 252))})
    last = step.withColumn("_k", F.lead("ts").over(in_time())).where("_k is null").drop("_k")
    return last.select("asset", "ts", *(f"ret_{n}" for n in ("1d", "5d", "21d", "63d", "ytd")))
