"""Queries over the expanded feature set, macro and sentiment alignment, dataset windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import expanded, features
from tidemark.plans import sql
from tidemark.plans.market import BENCHMARK, EVENTS, bars, rounded
from tidemark.plans.sql import BARS, MACRO, STEP, S, picked, roll
from tidemark.sources import tables

PEERS = {"rf": "RF", "af": "AF"}
#: The three monthly series under the names of macro series, scaled to their ranges.
SERIES = {"A": ("T10Y2Y", 100, -5), "N": ("BAMLH0A0HYM2", 120, 0), "R": ("VIXCLS", 600, 0)}
#: Rate decisions and inflation releases (fixed values).
FOMC = [
    "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12", "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18",
    "2025-01-29", "2025-03-19", "2025-05-07", "2025-06-18", "2025-07-30", "2025-09-17", "2025-10-29", "2025-12-10", "2026-01-28", "2026-03-18", "2026-04-29", "2026-06-17",
]
CPI = [
    "2024-01-11", "2024-02-13", "2024-03-12", "2024-04-10", "2024-05-15", "2024-06-12", "2024-07-11", "2024-08-14", "2024-09-11", "2024-10-10", "2024-11-13", "2024-12-11",
    "2025-01-15", "2025-02-12", "2025-03-12", "2025-04-10", "2025-05-13", "2025-06-11", "2025-07-15", "2025-08-13", "2025-09-10", "2025-10-09", "2025-11-13", "2025-12-10", "2026-01-14", "2026-02-12", "2026-03-12",
]
KEY = ["asset", "ts"]


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.macro(tables.table(spark, sf_dir, "lineitem"))
    value = F.lit(None).cast("double")
    for name, (_, scale, shift) in SERIES.items():
        value = F.when(F.col("indicator") == name, F.col("value") * scale + shift).otherwise(value)
    names = F.create_map(*(F.lit(x) for n, (to, _, _) in SERIES.items() for x in (n, to)))
    return found.select(names[F.col("indicator")].alias("indicator"), "ts", F.when(F.month("ts") % 5 != 0, value).alias("value"))


MACRO_SERIES = f"SELECT CASE indicator {' '.join(f"WHEN '{n}' THEN '{to}'" for n, (to, _, _) in SERIES.items())} END AS indicator, ts, CASE WHEN month(ts) % 5 <> 0 THEN CASE indicator {' '.join(f"WHEN '{n}' THEN value * {scale} + {shift}" for n, (_, scale, shift) in SERIES.items())} END END AS value FROM ({MACRO})"
MOODS = {"1-URGENT": "urgent", "5-LOW": "low"}


def mood_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(indicator, ts, value): a day's mean order value for some priorities."""
    orders = tables.table(spark, sf_dir, "orders")
    name = F.create_map(*(F.lit(x) for item in MOODS.items() for x in item))[F.col("o_orderpriority")]
    return orders.groupBy(name.alias("indicator"), F.to_date("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("value")).where("indicator is not null")


MOOD_SERIES = f"SELECT * FROM (SELECT CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MOODS.items())} END AS indicator, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2) WHERE indicator IS NOT NULL"


def aligned_sql(series: str, names: list[str], prefix: str, skip_nulls: bool = True) -> str:
    source = BARS
    for n in names:
        one = f"SELECT ts AS t, value FROM ({series}) WHERE indicator = '{n}'{' AND value IS NOT NULL' if skip_nulls else ''}"
        source = f"SELECT b.*, m.value AS {prefix}{n.lower()} FROM ({source}) b ASOF LEFT JOIN ({one}) m ON b.ts >= m.t"
    return source


def change(x: str) -> str:
    return f"coalesce(sign({x}) - lag(sign({x})) OVER ({S}), 0)"


def as_int(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INT)"


def _sql() -> dict[str, tuple[list[str], list[str], str]]:
    """name -> (exact columns, rounded columns, SQL)."""
    moves = f"SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss FROM ({STEP})"
    rsi = [f"100 - 100 / (1 + ({roll('avg', 'gain', n)}) / nullif({roll('avg', 'loss', n)}, 0)) AS rsi_{n}" for n in (7, 14, 21, 63)]
    rets = [f"close / {sql.lag('close', n)} - 1 AS ret_{n}d" for n in (1, 5, 10, 21, 63, 126, 252)]
    emas = ", ".join(f"{sql.ewm('close', 2 / (n + 1))} AS ema_{n}" for n in (8, 12, 20, 26, 50, 100, 200))
    trend = f"SELECT *, {sql.ewm('macd', 0.2)} AS macd_signal FROM (SELECT *, ema_12 - ema_26 AS macd FROM (SELECT *, {emas} FROM ({BARS})))"
    trend = f"SELECT *, macd - macd_signal AS macd_hist FROM ({trend})"
    trend = f"SELECT *, {', '.join(f'{as_int(f"close > ema_{n}")} AS above_ema{n}' for n in (20, 50, 200))}, {', '.join(f'(close - ema_{n}) / nullif(ema_{n}, 0) AS dist_ema{n}' for n in (20, 200))}, {change('macd_hist')} AS macd_cross, {change('(ema_20 - ema_50)')} AS ema20_50_cross, {change('(ema_50 - ema_200)')} AS ema50_200_cross FROM ({trend})"
    vol = f"SELECT *, {', '.join(f'({roll("stddev_samp", "lr", n)}) * sqrt(252) AS vol_{n}d' for n in (5, 10, 21, 63))}, {roll('avg', 'tr', 14)} AS atr FROM ({STEP})"
    vol = f"SELECT *, {roll('stddev_samp', 'vol_21d', 21)} AS vol_of_vol, vol_5d / nullif(vol_63d, 0) AS vol_ratio, atr / close AS atr_norm, pow(vol_5d, 2) / nullif(pow(vol_63d, 2), 0) AS variance_ratio, CASE WHEN count(vol_21d) OVER {sql.w(252)} = 252 THEN list(vol_21d) OVER {sql.w(252)} END AS year FROM ({vol})"
    vol = f"SELECT *, CAST(CASE WHEN vol_21d > 0 AND vol_21d <= 0.15 THEN 0 WHEN vol_21d > 0.15 AND vol_21d <= 0.25 THEN 1 WHEN vol_21d > 0.25 AND vol_21d <= 0.35 THEN 2 WHEN vol_21d > 0.35 AND vol_21d <= 10 THEN 3 END AS INT) AS vol_regime, (len(list_filter(year, lambda v: v < vol_21d)) + (len(list_filter(year, lambda v: v = vol_21d)) + 1) / 2) / 252 AS vol_pct_rank, {as_int('vol_5d > vol_21d')} AS vol_expanding, {as_int('variance_ratio > 2')} AS vol_breakout FROM ({vol})"
    band = f"SELECT *, {roll('avg', 'close', 20)} AS bb_mid, 2 * ({roll('stddev_samp', 'close', 20)}) AS d, 100 * (close - ({roll('min', 'low', 14)})) / nullif(({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}), 0) AS stoch_k FROM ({BARS})"
    band = f"SELECT *, bb_mid + d AS bb_upper, bb_mid - d AS bb_lower, (close - (bb_mid - d)) / nullif((bb_mid + d) - (bb_mid - d), 0) AS bb_pct, ((bb_mid + d) - (bb_mid - d)) / nullif(bb_mid, 0) AS bb_width, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM ({band})"
    band = f"SELECT *, {as_int(f'bb_width < CASE WHEN count(bb_width) OVER {sql.w(125)} = 125 THEN quantile_cont(bb_width, 0.25) OVER {sql.w(125)} END')} AS bb_squeeze, {as_int('stoch_k > stoch_d')} AS stoch_od FROM ({band})"
    flow = f"SELECT *, coalesce(sign(close - pc), 0) * volume AS signed, (high + low + close) / 3 * volume AS tv, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS flow FROM ({STEP})"
    flow = f"SELECT *, sum(signed) OVER ({S} ROWS UNBOUNDED PRECEDING) AS obv, ({roll('sum', 'tv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS vwap_20, volume / nullif({roll('avg', 'volume', 20)}, 0) AS rel_volume, CASE WHEN flow IS NOT NULL THEN sum(flow) OVER ({S} ROWS UNBOUNDED PRECEDING) END AS ad_line, {roll('max', 'high', 20)} AS rolling_high, {roll('min', 'low', 20)} AS rolling_low, list(signed) OVER ({S} ROWS UNBOUNDED PRECEDING) AS past FROM ({flow})"
    flow = f"SELECT *, (obv - {sql.lag('obv', 5)}) / 5 AS obv_slope, (close - vwap_20) / nullif(vwap_20, 0) AS dist_vwap, (rolling_high - close) / close AS dist_to_high, (close - rolling_low) / close AS dist_to_low FROM ({flow})"
    weights = f"list(obv) OVER ({S} ROWS UNBOUNDED PRECEDING)"
    decay = f"list_reduce({weights}, lambda a, b: a * {19 / 21!r} + b)"
    ones = f"(1 - pow({19 / 21!r}, count(*) OVER ({S} ROWS UNBOUNDED PRECEDING))) / {2 / 21!r}"
    flow = f"SELECT *, dist_to_low / nullif(dist_to_high + dist_to_low, 0) AS range_position, {decay} / ({ones}) AS obv_ema20 FROM ({flow})"
    cross = f"SELECT s.*, {', '.join(f'{p}.ret AS r_{p}' for p in PEERS)}, bench.ret AS r_bench, bench.close AS c_bench FROM ({STEP}) s {' '.join(f"LEFT JOIN (SELECT ts, ret FROM ({STEP}) WHERE asset = '{a}') {p} USING (ts)" for p, a in PEERS.items())} LEFT JOIN (SELECT ts, ret, close FROM ({STEP}) WHERE asset = '{BENCHMARK}') bench USING (ts)"
    cross = f"SELECT *, {', '.join(f'CASE WHEN r_{p} IS NOT NULL THEN ret END AS x_{p}, CASE WHEN ret IS NOT NULL THEN r_{p} END AS y_{p}' for p in (*PEERS, 'bench'))} FROM ({cross})"
    corr = ", ".join(f"CASE WHEN count(x_{p}) OVER {sql.w(n)} = {n} THEN covar_pop(x_{p}, y_{p}) OVER {sql.w(n)} / nullif(sqrt(var_pop(x_{p}) OVER {sql.w(n)} * var_pop(y_{p}) OVER {sql.w(n)}), 0) END AS corr_{p}_{n}d" for p in PEERS for n in (21, 63))
    beta = ", ".join(f"CASE WHEN count(x_bench) OVER {sql.w(n)} = {n} THEN covar_samp(x_bench, y_bench) OVER {sql.w(n)} / nullif(var_samp(y_bench) OVER {sql.w(n)}, 0) END AS beta_{n}d" for n in (21, 63, 252))
    strength = ", ".join(f"close / {sql.lag('close', n)} - c_bench / nullif({sql.lag('c_bench', n)}, 0) AS rel_strength_{n}d" for n in (21, 63, 126, 252))
    series = [to for to, _, _ in SERIES.values()]
    flags = ", ".join(f"{as_int(f'macro_{n} {side} {at}')} AS {c}" for c, n, side, at in expanded.MACRO_FLAGS)
    changes = ", ".join(f"macro_{n.lower()} - {sql.lag(f'macro_{n.lower()}', k)} AS macro_{n.lower()}_chg{k}d" for n in series for k in (21, 63))
    lags = ", ".join(f"{sql.lag(f'm_{n.lower()}', k)} AS {n}_lag{k}" for n in series for k in (1, 5, 21))
    gaps = lambda dates: f"list_transform({dates}::DATE[], lambda e: e - ts)"
    until, since = (f"CAST(list_min(list_filter({gaps(EVENTS)}, lambda v: v >= 0)) AS INT)", f"CAST(-list_max(list_filter({gaps(EVENTS)}, lambda v: v <= 0)) AS INT)")
    near = lambda dates: f"CAST(list_min(list_transform({gaps(dates)}, lambda v: abs(v))) AS INT)"
    week = "(dayofweek(ts) + 6) % 7"
    return {
        "expanded_momentum": (KEY, [f"rsi_{n}" for n in (7, 14, 21, 63)] + [f"ret_{n}d" for n in (1, 5, 10, 21, 63, 126, 252)], f"SELECT *, {', '.join(rsi + rets)} FROM ({moves})"),
        "expanded_trend": ([*KEY, "above_ema20", "above_ema50", "above_ema200", "macd_cross", "ema20_50_cross", "ema50_200_cross"], ["macd", "macd_signal", "macd_hist", *(f"ema_{n}" for n in (8, 20, 50, 100, 200)), "dist_ema20", "dist_ema200"], trend),
        "expanded_volatility": ([*KEY, "vol_regime", "vol_expanding", "vol_breakout"], ["atr", "atr_norm", "vol_5d", "vol_10d", "vol_21d", "vol_63d", "vol_of_vol", "vol_ratio", "vol_pct_rank", "variance_ratio"], vol),
        "expanded_bands": ([*KEY, "bb_squeeze", "stoch_od"], ["bb_mid", "bb_upper", "bb_lower", "bb_pct", "bb_width", "stoch_k", "stoch_d"], band),
        "expanded_volume": (KEY, ["obv", "obv_ema20", "obv_slope", "rel_volume", "vwap_20", "dist_vwap", "ad_line", "rolling_high", "rolling_low", "dist_to_high", "dist_to_low", "range_position"], flow),
        "expanded_cross_asset": (KEY, [f"corr_{p}_{n}d" for p in PEERS for n in (21, 63)] + [f"beta_{n}d" for n in (21, 63, 252)] + [f"rel_strength_{n}d" for n in (21, 63, 126, 252)], f"SELECT *, {corr}, {beta}, {strength} FROM ({cross})"),
        "expanded_macro": ([*KEY, *(c for c, _, _, _ in expanded.MACRO_FLAGS)], [f"macro_{n.lower()}" for n in series] + [f"macro_{n.lower()}_chg{k}d" for n in series for k in (21, 63)], f"SELECT *, {flags}, {changes} FROM ({aligned_sql(MACRO_SERIES, series, 'macro_')})"),
        "feature_macro_lags": (KEY, [f"{n}_lag{k}" for n in series for k in (1, 5, 21)] + ["yield_curve_slope"], f"SELECT *, {lags}, {sql.lag(f'm_{series[1].lower()}')} - {sql.lag(f'm_{series[0].lower()}')} AS yield_curve_slope FROM ({aligned_sql(MACRO_SERIES, series, 'm_', False)})"),
        "expanded_sentiment": (KEY, [c for n in MOODS.values() for c in (f"sent_{n}", f"sent_{n}_5d_chg")], f"SELECT *, {', '.join(f'sent_{n} - {sql.lag(f"sent_{n}", 5)} AS sent_{n}_5d_chg' for n in MOODS.values())} FROM ({aligned_sql(MOOD_SERIES, list(MOODS.values()), 'sent_')})"),
        "expanded_fundamentals": (KEY, list(expanded.FUNDAMENTALS), f"SELECT b.asset, b.ts, {', '.join(f'avg_close * {k} AS {c}' for k, c in enumerate(expanded.FUNDAMENTALS, 1))} FROM ({BARS}) b JOIN (SELECT asset, avg(close) AS avg_close FROM ({BARS}) GROUP BY 1) USING (asset)"),
        "expanded_calendar": ([*KEY, "day_of_week", "month", "quarter", "day_of_month", "week_of_year", "near_opex", "is_january", "is_december", "sell_in_may", "is_monday", "is_friday", "end_of_quarter"], [],
            f"SELECT asset, ts, CAST({week} AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter, CAST(day(ts) AS INT) AS day_of_month, CAST(weekofyear(ts) AS INT) AS week_of_year, {as_int(f'day(ts) BETWEEN 14 AND 22 AND {week} = 4')} AS near_opex, {as_int('month(ts) = 1')} AS is_january, {as_int('month(ts) = 12')} AS is_december, {as_int('month(ts) BETWEEN 5 AND 10')} AS sell_in_may, {as_int(f'{week} = 0')} AS is_monday, {as_int(f'{week} = 4')} AS is_friday, {as_int('month(ts) IN (3, 6, 9, 12) AND day(ts) >= 25')} AS end_of_quarter FROM ({BARS})"),
        "expanded_earnings": ([*KEY, "earnings_days_until", "earnings_days_since", "within_earnings_window"], [], f"SELECT *, {as_int('coalesce(earnings_days_until <= 5, false) OR coalesce(earnings_days_since <= 2, false)')} AS within_earnings_window FROM (SELECT *, {until} AS earnings_days_until, {since} AS earnings_days_since FROM ({BARS}))"),
        "expanded_events": ([*KEY, "days_to_fomc", "near_fomc", "days_to_cpi", "near_cpi"], [], f"SELECT *, {as_int('days_to_fomc <= 3')} AS near_fomc, {as_int('days_to_cpi <= 2')} AS near_cpi FROM (SELECT *, {near(FOMC)} AS days_to_fomc, {near(CPI)} AS days_to_cpi FROM (SELECT asset, CAST(ts + INTERVAL 9862 DAY AS DATE) AS ts FROM ({BARS})))"),
        "obv_ema_21": (KEY, ["obv_ema_21"], f"SELECT *, {sql.ewm('obv', 2 / 22)} AS obv_ema_21 FROM (SELECT *, sum(coalesce(sign(close - pc), 0) * volume) OVER ({S} ROWS UNBOUNDED PRECEDING) AS obv FROM ({STEP}))"),
        "normalised_minmax": (KEY, ["close", "volume"], f"SELECT asset, ts, (close - min(close) OVER ()) / (max(close) OVER () - min(close) OVER ()) AS close, (volume - min(volume) OVER ()) / (max(volume) OVER () - min(volume) OVER ()) AS volume FROM ({BARS})"),
        "price_tape": (KEY, ["change_pct", "high_252", "low_252"], f"SELECT *, ret * 100 AS change_pct, max(close) OVER {sql.w(252)} AS high_252, min(close) OVER {sql.w(252)} AS low_252 FROM ({STEP})"),
        "latest_returns": (KEY, [f"ret_{n}" for n in ("1d", "5d", "21d", "63d", "ytd")], f"SELECT *, {', '.join(f'(close / {sql.lag("close", k)} - 1) * 100 AS ret_{n}' for n, k in (('1d', 1), ('5d', 5), ('21d', 21), ('63d', 63), ('ytd', 252)))} FROM ({BARS}) QUALIFY lead(ts) OVER ({S}) IS NULL"),
    }


def _stats(made: DataFrame) -> DataFrame:
    """Statistics of each asset under the keys of the fundamental columns."""
    pairs = (x for k, key in enumerate(expanded.FUNDAMENTALS.values(), 1) for x in (F.lit(key), F.col("m") * k))
    return made.groupBy("asset").agg(F.avg("close").alias("m")).select("asset", F.create_map(*pairs).alias("stats"))


def _obv_ema_21(made: DataFrame) -> DataFrame:
    return features.ewm(features.volume(made), {"obv_ema_21": ("obv", features.span(21))})


MAKE = {
    "expanded_momentum": lambda s, d, b: expanded.momentum(b),
    "expanded_trend": lambda s, d, b: expanded.trend(b),
    "expanded_volatility": lambda s, d, b: expanded.volatility_regime(expanded.volatility(b)),
    "expanded_bands": lambda s, d, b: expanded.bands(b),
    "expanded_volume": lambda s, d, b: expanded.volume(b),
    "expanded_cross_asset": lambda s, d, b: expanded.cross_asset(b, PEERS, BENCHMARK),
    "expanded_macro": lambda s, d, b: expanded.macro(b, macro_series(s, d), [to for to, _, _ in SERIES.values()]),
    "feature_macro_lags": lambda s, d, b: expanded.macro_lags(b, macro_series(s, d), [to for to, _, _ in SERIES.values()], ("BAMLH0A0HYM2", "T10Y2Y")),
    "expanded_sentiment": lambda s, d, b: expanded.sentiment(b, mood_series(s, d), list(MOODS.values())),
    "expanded_fundamentals": lambda s, d, b: expanded.fundamentals(b, _stats(b)),
    "expanded_calendar": lambda s, d, b: expanded.calendar(b),
    "expanded_earnings": lambda s, d, b: expanded.earnings(b, EVENTS),
    "expanded_events": lambda s, d, b: expanded.events(b.withColumn("ts", F.date_add("ts", 9862)), FOMC, CPI),
    "obv_ema_21": lambda s, d, b: _obv_ema_21(b),
    "normalised_minmax": lambda s, d, b: features.normalised(b, ["close", "volume"], "minmax"),
    "price_tape": lambda s, d, b: expanded.price_tape(b),
    "latest_returns": lambda s, d, b: expanded.latest_returns(b),
}


def _query(make, exact, names):
    return lambda spark, sf_dir: rounded(make(spark, sf_dir, bars(spark, sf_dir)), exact, names)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = expanded.sequences(bars(spark, sf_dir), ["close", "volume"], 20)
    total = F.aggregate("steps", F.lit(0.0), lambda n, x: n + x[0])
    return rounded(made.select("asset", "ts", total.alias("sum_close"), F.element_at("steps", 1)[1].alias("first_volume"), "target"), [*KEY, "target"], ["sum_close", "first_volume"])


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the whole set keeps, by asset."""
    kept = expanded.feature_matrix(bars(spark, sf_dir).select("asset", "ts", "open", "high", "low", "close", "volume"))
    return rounded(kept.groupBy("asset").agg(F.count("*").alias("rows"), F.avg("rsi_14").alias("rsi"), F.avg("vol_21d").alias("vol"), F.min("ts").alias("first")), ["asset", "rows", "first"], ["rsi", "vol"])


def _feature_matrix_sql() -> str:
    made = _sql()
    names = ["momentum", "trend", "volatility", "bands", "volume", "calendar"]
    columns = {n: [c for c in (*made[f"expanded_{n}"][0], *made[f"expanded_{n}"][1]) if c not in KEY] for n in names}
    total = sum(len(c) for c in columns.values())
    there = " + ".join(f"CAST({n[0]}{k}.{c} IS NOT NULL AS INT)" for k, n in enumerate(names) for c in columns[n])
    joined = " ".join(f"JOIN ({made[f'expanded_{n}'][2]}) {n[0]}{k} ON {n[0]}{k}.asset = x.asset AND {n[0]}{k}.ts = x.ts" for k, n in enumerate(names))
    return f"SELECT x.asset, count(*) AS rows, min(x.ts) AS first, round(avg(m0.rsi_14), 6) AS rsi, round(avg(v2.vol_21d), 6) AS vol FROM ({BARS}) x {joined} WHERE 5 + {there} >= {int(5 + total - 0.5 * total)} GROUP BY 1"


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    made = {n: (_query(MAKE[n], exact, names), picked(text, exact, names)) for n, (exact, names, text) in _sql().items()}
    level = f"SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY indicator ORDER BY day) AS level FROM (SELECT indicator, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY 1) LEFT JOIN daily USING (indicator, day) WHERE isodow(day) < 6"
    scaled = f"WITH daily AS (SELECT indicator, CAST(ts - to_days(CAST(greatest(isodow(ts) - 5, 0) AS INT)) AS DATE) AS day, arg_max(value, ts) AS value FROM ({MACRO}) GROUP BY 1, 2), steps AS (SELECT indicator, day, level - lag(level) OVER (PARTITION BY indicator ORDER BY day) AS step FROM ({level}))"
    w = "(PARTITION BY indicator ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    z = f"CASE WHEN count(value) OVER {w} = least(12, count(value) OVER (PARTITION BY indicator)) THEN round(coalesce((value - avg(value) OVER {w}) / nullif(stddev_samp(value) OVER {w}, 0), 0), 3) END"
    steps = f"SELECT asset, ts, list(close) OVER p AS c, list(volume) OVER p AS v, close AS target, lead(close) OVER ({S}) AS more FROM ({BARS}) WINDOW p AS ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return made | {
        "sequences": (sequences, picked(f"SELECT asset, ts, list_sum(c) AS sum_close, v[1] AS first_volume, target FROM ({steps}) WHERE len(c) = 20 AND more IS NOT NULL", [*KEY, "target"], ["sum_close", "first_volume"])),
        "feature_matrix": (feature_matrix, _feature_matrix_sql()),
        "trailing_z": (lambda s, d: expanded.trailing_z(tables.macro(tables.table(s, d, "lineitem")), 12).select("indicator", "ts", (F.col("z") + F.lit(0.0)).alias("z")), f"SELECT indicator, ts, {z} + 0.0 AS z FROM ({MACRO})"),
        "scaled_levels": (lambda s, d: rounded(expanded.scaled_levels(tables.macro(tables.table(s, d, "lineitem"))), ["indicator", "ts"], ["value"]), f"{scaled} SELECT indicator, day AS ts, round(step / nullif(stddev_samp(step) OVER (PARTITION BY indicator), 0), 6) + 0.0 AS value FROM steps WHERE step IS NOT NULL"),
    }
