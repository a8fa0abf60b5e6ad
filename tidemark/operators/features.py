"""Features of bars (asset, ts, open, high, low, close, volume); each function adds columns.

Where the full window is not there yet, a feature is null. Names of base_* functions and exp_* functions
can carry different formulas (rsi by Wilder or by plain means), so they are not mixed.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import ewm, flag, in_time, lag, last_rows, roll, rolled, rolling_corr, so_far, span

YEAR = sqrt(252)
#: Months with a rate decision and months of earnings reports (fixed values).
FOMC_MONTHS, EARNINGS_MONTHS = (1, 3, 5, 6, 7, 9, 10, 11, 12), (2, 5, 8, 11)
TINY = 1e-9


def returns(bars: DataFrame, periods: tuple[int, ...] = (1, 5, 10, 21, 63)) -> DataFrame:
    """ret_{n}d, log_ret_1d, log_ret_5d, cum_ret_21d, cum_ret_63d."""
    done = bars.withColumns({f"ret_{n}d": F.try_divide("close", lag("close", n)) - 1 for n in periods} | {f"log_ret_{n}d": F.ln(F.try_divide("close", lag("close", n))) for n in (1, 5)})
    return done.withColumns({f"cum_ret_{n}d": roll(F.product, 1 + F.col("ret_1d"), n) - 1 for n in (21, 63)})


def true_range() -> Column:
    """The first bar has no previous close; its range is high - low."""
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def volatility(bars: DataFrame) -> DataFrame:
    """realized_vol_5d, realized_vol_21d, garman_klass_vol (a mean variance), atr_14, atr_ratio."""
    step = bars.withColumns({"_log": F.ln(F.try_divide("close", lag("close"))), "_tr": true_range(), "_gk": 0.5 * F.pow(F.ln(F.col("high") / F.col("low")), 2) - (2 * log(2) - 1) * F.pow(F.ln(F.col("close") / F.col("open")), 2)})
    done = step.withColumns({f"realized_vol_{n}d": roll(F.stddev_samp, "_log", n) * YEAR for n in (5, 21)} | {"garman_klass_vol": roll(F.avg, "_gk", 21), "atr_14": roll(F.avg, "_tr", 14)})
    return done.withColumn("atr_ratio", F.try_divide("atr_14", "close")).drop("_log", "_tr", "_gk")


def moving_averages(bars: DataFrame) -> DataFrame:
    """rsi_14, rsi_28 (Wilder; null without losses), macd, macd_signal, macd_hist, ema_{9,21,50,200} and their crosses."""
    move = F.col("close") - lag("close")
    step = bars.withColumns({"_gain": F.greatest(move, F.lit(0.0)), "_loss": F.greatest(-move, F.lit(0.0))}).withColumns({c: F.when(lag("close").isNotNull(), F.col(c)) for c in ("_gain", "_loss")})
    means = {f"_g{n}": ("_gain", 1 / n) for n in (14, 28)} | {f"_l{n}": ("_loss", 1 / n) for n in (14, 28)} | {f"ema_{n}": ("close", span(n)) for n in (9, 12, 21, 26, 50, 200)} | {"macd_signal": (("ema_12", "ema_26"), span(9))}
    done = ewm(step, means).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    rsi = {f"rsi_{n}": 100 - 100 / (1 + F.col(f"_g{n}") / F.nullif(F.col(f"_l{n}"), F.lit(0.0))) for n in (14, 28)}
    done = done.withColumns(rsi | {"macd_hist": F.col("macd") - F.col("macd_signal"), "ema_9_21_cross": flag(F.col("ema_9") > F.col("ema_21")), "ema_21_50_cross": flag(F.col("ema_21") > F.col("ema_50"))})
    return done.drop("_gain", "_loss", *(f"_{k}{n}" for k in "gl" for n in (14, 28)), "ema_12", "ema_26")


def oscillators(bars: DataFrame) -> DataFrame:
    """stoch_k, stoch_d, williams_r_14, roc_10, roc_21."""
    low, high = roll(F.min, "low", 14), roll(F.max, "high", 14)
    step = bars.withColumns({"stoch_k": 100 * (F.col("close") - low) / (high - low + TINY), "williams_r_14": -100 * (high - F.col("close")) / (high - low + TINY)} | {f"roc_{n}": (F.try_divide("close", lag("close", n)) - 1) * 100 for n in (10, 21)})
    return step.withColumn("stoch_d", roll(F.avg, "stoch_k", 3))


def bands(bars: DataFrame) -> DataFrame:
    """bb_mid, bb_upper, bb_lower, bb_width, bb_pct: 20 bars, two standard deviations."""
    mid, off = roll(F.avg, "close", 20), 2 * roll(F.stddev_samp, "close", 20)
    step = bars.withColumns({"bb_mid": mid, "bb_upper": mid + off, "bb_lower": mid - off})
    return step.withColumns({"bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")), "bb_pct": (F.col("close") - F.col("bb_lower")) / (F.col("bb_upper") - F.col("bb_lower") + TINY)})


def directional(bars: DataFrame) -> DataFrame:
    """adx_14 of clipped moves, without the test of which is larger."""
    up, down = F.greatest(F.col("high") - lag("high"), F.lit(0.0)), F.greatest(lag("low") - F.col("low"), F.lit(0.0))
    there = lag("close").isNotNull()
    step = bars.withColumns({"_tr": true_range(), "_up": F.when(there, up), "_down": F.when(there, down)})
    step = step.withColumns({"_atr": roll(F.avg, "_tr", 14), "_u": roll(F.avg, "_up", 14), "_d": roll(F.avg, "_down", 14)})
    step = step.withColumns({"_pos": 100 * F.try_divide("_u", "_atr"), "_neg": 100 * F.try_divide("_d", "_atr")})
    step = step.withColumn("_dx", 100 * F.abs(F.col("_pos") - F.col("_neg")) / (F.col("_pos") + F.col("_neg") + TINY))
    return step.withColumn("adx_14", roll(F.avg, "_dx", 14)).drop("_tr", "_up", "_down", "_atr", "_u", "_d", "_pos", "_neg", "_dx")


def ichimoku(bars: DataFrame) -> DataFrame:
    """ichimoku_conv, ichimoku_base, and span_a, span_b of 26 bars before."""
    middle = lambda n: (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2
    step = bars.withColumns({"ichimoku_conv": middle(9), "ichimoku_base": middle(26), "_b": middle(52)})
    return step.withColumns({"ichimoku_span_a": lag((F.col("ichimoku_conv") + F.col("ichimoku_base")) / 2, 26), "ichimoku_span_b": lag("_b", 26)}).drop("_b")


def volume(bars: DataFrame) -> DataFrame:
    """obv, vwap_21, volume_ratio_10, cmf_20."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    flow = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / (F.col("high") - F.col("low") + TINY) * F.col("volume")
    step = bars.withColumns({"_tv": typical * F.col("volume"), "_flow": flow, "_signed": F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume")})
    done = step.withColumns({"obv": F.sum("_signed").over(so_far()), "vwap_21": roll(F.sum, "_tv", 21) / (roll(F.sum, "volume", 21) + TINY), "volume_ratio_10": F.col("volume") / (roll(F.avg, "volume", 10) + TINY), "cmf_20": roll(F.sum, "_flow", 20) / (roll(F.sum, "volume", 20) + TINY)})
    return done.drop("_tv", "_flow", "_signed")


def risk(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rolling_sharpe_{21,63}, rolling_vol_21, max_drawdown_63 (from the 63-bar high), beta_21 and corr_benchmark_{21,63}.

    ``benchmark`` (ts, bench_ret) holds one row a day at most; its size is that of the calendar.
    """
    step = bars.withColumn("_ret", F.try_divide("close", lag("close")) - 1).join(benchmark, "ts", "left")
    top = roll(F.max, "close", 63)
    both = F.count(F.when(F.col("_ret").isNotNull() & F.col("bench_ret").isNotNull(), 1)).over(last_rows(21)) == 21
    beta = F.when(both, F.covar_samp("_ret", "bench_ret").over(last_rows(21)) / (F.var_samp("bench_ret").over(last_rows(21)) + TINY))
    done = step.withColumns({f"rolling_sharpe_{n}": roll(F.avg, "_ret", n) / (roll(F.stddev_samp, "_ret", n) + TINY) * YEAR for n in (21, 63)} | {"rolling_vol_21": roll(F.stddev_samp, "_ret", 21) * YEAR, "max_drawdown_63": (F.col("close") - top) / (top + TINY), "beta_21": beta} | {f"corr_benchmark_{n}": rolling_corr("_ret", "bench_ret", n) for n in (21, 63)})
    return done.drop("_ret", "bench_ret")


def benchmark_returns(bars: DataFrame, asset: str) -> DataFrame:
    """(ts, bench_ret) of one asset."""
    return bars.where(F.col("asset") == asset).select("ts", (F.try_divide("close", lag("close")) - 1).alias("bench_ret"))


def calendar(bars: DataFrame) -> DataFrame:
    """day_of_week (Monday is 0), month, quarter, ends of months and quarters by the calendar, event months."""
    month = F.month("ts")
    end = F.last_day("ts") == F.to_date("ts")
    return bars.withColumns({"day_of_week": F.weekday("ts"), "month": month, "quarter": F.quarter("ts"), "is_month_end": flag(end), "is_quarter_end": flag(end & (month % 3 == 0)), "fomc_window": flag(month.isin(*FOMC_MONTHS)), "earnings_season": flag(month.isin(*EARNINGS_MONTHS))})


def base_features(bars: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """All base features in one plan."""
    done = bars.transform(returns).transform(volatility).transform(oscillators).transform(bands).transform(directional).transform(ichimoku).transform(volume)
    done = done.transform(risk, benchmark) if benchmark is not None else done
    return done.transform(calendar).transform(moving_averages)


def exp_features(bars: DataFrame) -> DataFrame:
    """Expanded set: rsi_{7,14} of plain means, vol_21d, vol_of_vol, vol_regime, vol_pct_rank, bb_squeeze, range_position, ad_line."""
    move = F.col("close") - lag("close")
    step = bars.withColumns({"_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))), "_log": F.ln(F.try_divide("close", lag("close")))})
    clv = F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    high, low = roll(F.max, "high", 20), roll(F.min, "low", 20)
    step = step.withColumns({f"rsi_{n}": 100 - 100 / (1 + F.try_divide(roll(F.avg, "_gain", n), roll(F.avg, "_loss", n))) for n in (7, 14)} | {"vol_21d": roll(F.stddev_samp, "_log", 21) * YEAR, "bb_width": F.try_divide(4 * roll(F.stddev_samp, "close", 20), roll(F.avg, "close", 20)), "range_position": F.try_divide(F.col("close") - low, high - low), "ad_line": F.sum(clv * F.col("volume")).over(so_far())})
    vol = F.col("vol_21d")
    regime = F.when((vol > 0) & (vol <= 0.15), 0).when((vol > 0.15) & (vol <= 0.25), 1).when((vol > 0.25) & (vol <= 0.35), 2).when((vol > 0.35) & (vol <= 10), 3)
    squeeze = F.when(F.count("bb_width").over(last_rows(125)) == 125, F.percentile("bb_width", F.lit(0.25)).over(last_rows(125)))
    return rolled(step, {"vol_pct_rank": ("rank", 252, ("vol_21d",))}).withColumns({"vol_of_vol": roll(F.stddev_samp, "vol_21d", 21), "vol_regime": regime, "bb_squeeze": flag(F.col("bb_width") < squeeze)}).drop("_gain", "_loss", "_log")


def forward_label(bars: DataFrame, horizon: int = 5, threshold: float = 0.0, strict_parity: bool = True) -> DataFrame:
    """label: whether the close ``horizon`` bars on is up by more than ``threshold``; the last bars are 0, or null without strict_parity."""
    ahead = F.try_divide(F.lead("close", horizon).over(in_time()), "close") - 1
    return bars.withColumn("label", flag(ahead > threshold) if strict_parity else F.when(ahead.isNotNull(), flag(ahead > threshold)))


def normalised(df: DataFrame, columns: list[str], method: str = "zscore") -> DataFrame:
    """Columns scaled by statistics over all rows (one aggregate); those that do not vary stay."""
    low, width = (F.avg, F.stddev_samp) if method == "zscore" else (F.min, lambda c: F.max(c) - F.min(c))
    stats = df.agg(*(low(c).alias(f"m_{c}") for c in columns), *(width(c).alias(f"s_{c}") for c in columns)).first()
    return df.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in columns if stats[f"s_{c}"]})
