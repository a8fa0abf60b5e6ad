"""Queries over bars: features, alignment, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import flag, last_rows
from tidemark.operators import asof, backtest, features
from tidemark.operators.quality import last_n
from tidemark.plans import sql
from tidemark.plans.sql import BARS, MACRO, STEP, S, picked, roll
from tidemark.sources import tables

BENCHMARK = "NO"
EVENTS = ["1995-03-22", "1996-01-31", "1996-07-02", "1997-05-20", "1998-02-04", "1999-12-21"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars(tables.table(spark, sf_dir, "lineitem"))


def rounded(df: DataFrame, exact: list[str], names: list[str]) -> DataFrame:
    return df.select(*exact, *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in names))


#: name -> (operator, exact columns, rounded columns, SQL with these columns)
def _features() -> dict:
    key = ["asset", "ts"]
    gk = "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"
    emas = ", ".join(f"{sql.ewm('close', 2 / (n + 1))} AS ema_{n}" for n in (9, 12, 21, 26, 50, 200))
    moves = f"SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss FROM ({STEP})"
    wilder = ", ".join(f"100 - 100 / (1 + {sql.ewm('gain', 1 / n)} / nullif({sql.ewm('loss', 1 / n)}, 0)) AS rsi_{n}" for n in (14, 28))
    macd = f"SELECT *, ema_12 - ema_26 AS macd FROM (SELECT *, {emas}, {wilder} FROM ({moves}))"
    macd = f"SELECT *, {sql.ewm('macd', 0.2)} AS macd_signal FROM ({macd})"
    low14, high14 = roll("min", "low", 14), roll("max", "high", 14)
    stoch = f"SELECT *, 100 * (close - {low14}) / ({high14} - {low14} + 1e-9) AS stoch_k, -100 * ({high14} - close) / ({high14} - {low14} + 1e-9) AS williams_r_14, (close / {sql.lag('close', 10)} - 1) * 100 AS roc_10, (close / {sql.lag('close', 21)} - 1) * 100 AS roc_21 FROM ({BARS})"
    band = f"SELECT *, m AS bb_mid, m + d AS bb_upper, m - d AS bb_lower FROM (SELECT *, {roll('avg', 'close', 20)} AS m, 2 * ({roll('stddev_samp', 'close', 20)}) AS d FROM ({BARS}))"
    dm = f"SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - {sql.lag('high')}, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest({sql.lag('low')} - low, 0) END AS down FROM ({STEP})"
    di = f"SELECT *, 100 * ({roll('avg', 'up', 14)}) / ({roll('avg', 'tr', 14)}) AS pos, 100 * ({roll('avg', 'down', 14)}) / ({roll('avg', 'tr', 14)}) AS neg FROM ({dm})"
    dx = f"SELECT *, 100 * abs(pos - neg) / (pos + neg + 1e-9) AS dx FROM ({di})"
    mid = lambda n: f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"
    cloud = f"SELECT *, {mid(9)} AS ichimoku_conv, {mid(26)} AS ichimoku_base, {mid(52)} AS b FROM ({BARS})"
    flow = f"SELECT *, (high + low + close) / 3 * volume AS tv, ((close - low) - (high - close)) / (high - low + 1e-9) * volume AS flow, coalesce(sign(close - pc), 0) * volume AS signed FROM ({STEP})"
    bench = f"SELECT s.*, b.ret AS br FROM ({STEP}) s LEFT JOIN (SELECT ts, ret FROM ({STEP}) WHERE asset = '{BENCHMARK}') b USING (ts)"
    bench = f"SELECT *, CASE WHEN br IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN br END AS y FROM ({bench})"
    corr = lambda n: f"CASE WHEN count(x) OVER {sql.w(n)} = {n} THEN covar_pop(x, y) OVER {sql.w(n)} / nullif(sqrt(var_pop(x) OVER {sql.w(n)} * var_pop(y) OVER {sql.w(n)}), 0) END"
    simple = f"SELECT *, {', '.join(f'100 - 100 / (1 + ({roll("avg", "gain", n)}) / nullif({roll("avg", "loss", n)}, 0)) AS rsi_{n}' for n in (7, 14))}, ({roll('stddev_samp', 'lr', 21)}) * sqrt(252) AS vol_21d, 4 * ({roll('stddev_samp', 'close', 20)}) / ({roll('avg', 'close', 20)}) AS bb_width, (close - ({roll('min', 'low', 20)})) / nullif(({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}), 0) AS range_position, sum(((close - low) - (high - close)) / nullif(high - low, 0) * volume) OVER ({S} ROWS UNBOUNDED PRECEDING) AS ad_line FROM ({moves})"
    simple = f"SELECT *, {roll('stddev_samp', 'vol_21d', 21)} AS vol_of_vol, CASE WHEN count(vol_21d) OVER {sql.w(252)} = 252 THEN list(vol_21d) OVER {sql.w(252)} END AS year, CASE WHEN count(bb_width) OVER {sql.w(125)} = 125 THEN quantile_cont(bb_width, 0.25) OVER {sql.w(125)} END AS q FROM ({simple})"
    quarter_end = "last_day(ts) = ts AND month(ts) % 3 = 0"
    up = f"lead(close, 5) OVER ({S}) / close - 1 > 0"
    b = features
    return {
        "feature_returns": (b.returns, key, [f"ret_{n}d" for n in (1, 5, 10, 21, 63)] + ["log_ret_1d", "log_ret_5d", "cum_ret_21d", "cum_ret_63d"],
            f"SELECT *, {', '.join(f'close / {sql.lag("close", n)} - 1 AS ret_{n}d' for n in (1, 5, 10, 21, 63))}, lr AS log_ret_1d, ln(close / {sql.lag('close', 5)}) AS log_ret_5d, {', '.join(f'close / {sql.lag("close", n)} - 1 AS cum_ret_{n}d' for n in (21, 63))} FROM ({STEP})"),
        "feature_volatility": (b.volatility, key, ["realized_vol_5d", "realized_vol_21d", "garman_klass_vol", "atr_14", "atr_ratio"],
            f"SELECT *, ({roll('stddev_samp', 'lr', 5)}) * sqrt(252) AS realized_vol_5d, ({roll('stddev_samp', 'lr', 21)}) * sqrt(252) AS realized_vol_21d, {roll('avg', 'gk', 21)} AS garman_klass_vol, {roll('avg', 'tr', 14)} AS atr_14, ({roll('avg', 'tr', 14)}) / close AS atr_ratio FROM (SELECT *, {gk} AS gk FROM ({STEP}))"),
        "feature_moving_averages": (b.moving_averages, [*key, "ema_9_21_cross", "ema_21_50_cross"], ["rsi_14", "rsi_28", "macd", "macd_signal", "macd_hist", "ema_9", "ema_21", "ema_50", "ema_200"],
            f"SELECT *, macd - macd_signal AS macd_hist, CAST(ema_9 > ema_21 AS INT) AS ema_9_21_cross, CAST(ema_21 > ema_50 AS INT) AS ema_21_50_cross FROM ({macd})"),
        "feature_oscillators": (b.oscillators, key, ["stoch_k", "stoch_d", "williams_r_14", "roc_10", "roc_21"], f"SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM ({stoch})"),
        "feature_bands": (b.bands, key, ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct"], f"SELECT *, (bb_upper - bb_lower) / bb_mid AS bb_width, (close - bb_lower) / (bb_upper - bb_lower + 1e-9) AS bb_pct FROM ({band})"),
        "feature_adx": (b.directional, key, ["adx_14"], f"SELECT *, {roll('avg', 'dx', 14)} AS adx_14 FROM ({dx})"),
        "feature_ichimoku": (b.ichimoku, key, ["ichimoku_conv", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b"], f"SELECT *, {sql.lag('(ichimoku_conv + ichimoku_base) / 2', 26)} AS ichimoku_span_a, {sql.lag('b', 26)} AS ichimoku_span_b FROM ({cloud})"),
        "feature_volume": (b.volume, key, ["obv", "vwap_21", "volume_ratio_10", "cmf_20"],
            f"SELECT *, sum(signed) OVER ({S} ROWS UNBOUNDED PRECEDING) AS obv, ({roll('sum', 'tv', 21)}) / (({roll('sum', 'volume', 21)}) + 1e-9) AS vwap_21, volume / (({roll('avg', 'volume', 10)}) + 1e-9) AS volume_ratio_10, ({roll('sum', 'flow', 20)}) / (({roll('sum', 'volume', 20)}) + 1e-9) AS cmf_20 FROM ({flow})"),
        "feature_risk": (lambda d: b.risk(d, b.benchmark_returns(d, BENCHMARK)), key, ["rolling_sharpe_21", "rolling_sharpe_63", "rolling_vol_21", "max_drawdown_63", "beta_21", "corr_benchmark_21", "corr_benchmark_63"],
            f"SELECT *, {', '.join(f'({roll("avg", "ret", n)}) / (({roll("stddev_samp", "ret", n)}) + 1e-9) * sqrt(252) AS rolling_sharpe_{n}' for n in (21, 63))}, ({roll('stddev_samp', 'ret', 21)}) * sqrt(252) AS rolling_vol_21, (close - ({roll('max', 'close', 63)})) / (({roll('max', 'close', 63)}) + 1e-9) AS max_drawdown_63, CASE WHEN count(x) OVER {sql.w(21)} = 21 THEN covar_samp(x, y) OVER {sql.w(21)} / (var_samp(y) OVER {sql.w(21)} + 1e-9) END AS beta_21, {corr(21)} AS corr_benchmark_21, {corr(63)} AS corr_benchmark_63 FROM ({bench})"),
        "feature_calendar": (b.calendar, [*key, "day_of_week", "month", "quarter", "is_month_end", "is_quarter_end", "fomc_window", "earnings_season"], [],
            f"SELECT asset, ts, CAST((dayofweek(ts) + 6) % 7 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter, CAST(last_day(ts) = ts AS INT) AS is_month_end, CAST({quarter_end} AS INT) AS is_quarter_end, CAST(month(ts) IN (1, 3, 5, 6, 7, 9, 10, 11, 12) AS INT) AS fomc_window, CAST(month(ts) IN (2, 5, 8, 11) AS INT) AS earnings_season FROM ({BARS})"),
        "feature_expanded": (b.exp_features, [*key, "vol_regime", "bb_squeeze"], ["rsi_7", "rsi_14", "vol_21d", "bb_width", "range_position", "ad_line", "vol_of_vol", "vol_pct_rank"],
            f"SELECT *, CAST(CASE WHEN vol_21d > 0 AND vol_21d <= 0.15 THEN 0 WHEN vol_21d > 0.15 AND vol_21d <= 0.25 THEN 1 WHEN vol_21d > 0.25 AND vol_21d <= 0.35 THEN 2 WHEN vol_21d > 0.35 AND vol_21d <= 10 THEN 3 END AS INT) AS vol_regime, CAST(coalesce(bb_width < q, false) AS INT) AS bb_squeeze, (len(list_filter(year, lambda v: v < vol_21d)) + (len(list_filter(year, lambda v: v = vol_21d)) + 1) / 2) / 252 AS vol_pct_rank FROM ({simple})"),
        "forward_label": (b.forward_label, [*key, "label"], [], f"SELECT *, CAST(coalesce({up}, false) AS INT) AS label FROM ({BARS})"),
        "normalised": (lambda d: b.normalised(d, ["close", "volume"]), key, ["close", "volume"], f"SELECT asset, ts, (close - avg(close) OVER ()) / stddev_samp(close) OVER () AS close, (volume - avg(volume) OVER ()) / stddev_samp(volume) OVER () AS volume FROM ({BARS})"),
        "event_distance": (lambda d: asof.event_distance(d, EVENTS), [*key, "days_until", "days_since", "days_nearest", "near_event"], [],
            f"SELECT asset, ts, CAST(list_min(list_filter(g, lambda v: v >= 0)) AS INT) AS days_until, CAST(-list_max(list_filter(g, lambda v: v <= 0)) AS INT) AS days_since, CAST(list_min(list_transform(g, lambda v: abs(v))) AS INT) AS days_nearest, CAST(list_min(list_transform(g, lambda v: abs(v))) <= 3 AS INT) AS near_event FROM (SELECT *, list_transform({EVENTS}::DATE[], lambda e: e - ts) AS g FROM ({BARS}))"),
    }


def _feature_query(make, exact, names):
    return lambda spark, sf_dir: rounded(make(bars(spark, sf_dir)), exact, names)


def signals(prices: DataFrame) -> DataFrame:
    return prices.select("asset", "ts", flag(F.col("close") > F.avg("close").over(last_rows(20))).cast("double").alias("score"))


SIGNALS = f"SELECT *, CAST(close > avg(close) OVER {sql.w(20)} AS INT) AS want FROM ({BARS})"


def _positions_sql(delay: int) -> str:
    held = f"coalesce(lag(position) OVER ({S}), 0)" if delay == 2 else "position"
    steps = f"SELECT *, coalesce(lag(want) OVER ({S}), 0) AS position, coalesce(close / lag(close) OVER ({S}) - 1, 0) AS r FROM ({SIGNALS})"
    steps = f"SELECT *, {held} * r - abs(position - coalesce(lag(position) OVER ({S}), 0)) * 0.001 AS strategy_return FROM ({steps})"
    steps = f"SELECT *, product(greatest(1 + strategy_return, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS equity FROM ({steps})"
    return f"SELECT *, equity / max(equity) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM ({steps})"


def _summary_sql(delay: int) -> str:
    inner = f"SELECT asset, count(*) AS n_bars, product(greatest(1 + strategy_return, 0)) AS g, stddev_samp(strategy_return) AS sd, min(drawdown) AS max_drawdown FROM ({_positions_sql(delay)}) GROUP BY asset"
    return picked(f"SELECT *, g - 1 AS total_return, pow(g, 252.0 / n_bars) - 1 AS annual_return, (pow(g, 252.0 / n_bars) - 1) / (sd * sqrt(252)) AS sharpe FROM ({inner})", ["asset", "n_bars"], ["total_return", "annual_return", "sharpe", "max_drawdown"])


def _backtest(delay: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prices = bars(spark, sf_dir)
        return rounded(backtest.summary(backtest.positions(prices, signals(prices), delay=delay)), ["asset", "n_bars"], ["total_return", "annual_return", "sharpe", "max_drawdown"])

    return run


def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = bars(spark, sf_dir)
    return rounded(backtest.trades(backtest.positions(prices, signals(prices))), ["asset", "entry", "exit"], ["entry_price", "exit_price", "pnl"])


def _asof(skip_nulls: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = tables.table(spark, sf_dir, "lineitem")
        left = tables.bars(lines).select(F.substring("asset", 1, 1).alias("indicator"), "ts", "asset")
        right = tables.macro(lines).withColumn("value", F.when(F.month("ts") % 3 != 0, F.col("value")))
        return asof.asof(left, right, "indicator", "value", skip_nulls).select("asset", "ts", "value")

    return run


def _asof_sql(skip_nulls: bool) -> str:
    right = f"SELECT indicator, ts AS since, CASE WHEN month(ts) % 3 <> 0 THEN value END AS value FROM ({MACRO})"
    right = f"SELECT * FROM ({right}) WHERE value IS NOT NULL" if skip_nulls else right
    return f"SELECT b.asset, b.ts, m.value FROM ({BARS}) b ASOF LEFT JOIN ({right}) m ON b.asset[1:1] = m.indicator AND b.ts >= m.since"


def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each asset with its indicators and the consensus of their votes."""
    made = bars(spark, sf_dir).transform(features.returns).transform(features.bands).transform(features.volatility).transform(features.moving_averages)
    last = last_n(made, "asset", ["ts"], 1)
    bull = sum((flag(c) for c in (F.col("rsi_14") < 30, F.col("macd") > F.col("macd_signal"), F.col("bb_pct") < 0.2, F.col("ret_21d") > 0)), F.lit(0))
    bear = sum((flag(c) for c in (F.col("rsi_14") > 70, F.col("macd") < F.col("macd_signal"), F.col("bb_pct") > 0.8, F.col("ret_21d") < 0)), F.lit(0))
    found = last.withColumn("consensus", F.when(bull > bear + 1, "bullish").when(bear > bull + 1, "bearish").otherwise("neutral"))
    return rounded(found, ["asset", "ts", "consensus"], ["close", "ret_1d", "ret_21d", "rsi_14", "macd", "macd_signal", "bb_pct", "realized_vol_21d"]).orderBy(F.desc_nulls_last("ret_21d"), "asset")


def _screener_sql() -> str:
    made = _features()
    parts = {"f": made["feature_returns"][3], "m": made["feature_moving_averages"][3], "b": made["feature_bands"][3], "v": made["feature_volatility"][3]}
    joined = f"SELECT f.asset, f.ts, f.close, f.ret_1d, f.ret_21d, m.rsi_14, m.macd, m.macd_signal, b.bb_pct, v.realized_vol_21d FROM ({parts['f']}) f JOIN ({parts['m']}) m USING (asset, ts) JOIN ({parts['b']}) b USING (asset, ts) JOIN ({parts['v']}) v USING (asset, ts) QUALIFY row_number() OVER (PARTITION BY f.asset ORDER BY f.ts DESC) = 1"
    vote = lambda *c: " + ".join(f"CAST(coalesce({x}, false) AS INT)" for x in c)
    votes = f"SELECT *, {vote('rsi_14 < 30', 'macd > macd_signal', 'bb_pct < 0.2', 'ret_21d > 0')} AS bull, {vote('rsi_14 > 70', 'macd < macd_signal', 'bb_pct > 0.8', 'ret_21d < 0')} AS bear FROM ({joined})"
    return picked(f"SELECT *, CASE WHEN bull > bear + 1 THEN 'bullish' WHEN bear > bull + 1 THEN 'bearish' ELSE 'neutral' END AS consensus FROM ({votes})", ["asset", "ts", "consensus"], ["close", "ret_1d", "ret_21d", "rsi_14", "macd", "macd_signal", "bb_pct", "realized_vol_21d"])


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    made = {n: (_feature_query(f, exact, names), picked(text, exact, names)) for n, (f, exact, names, text) in _features().items()}
    trades = f"SELECT *, lead(ts) OVER ({S}) AS exit, lead(close) OVER ({S}) AS exit_price FROM (SELECT * FROM (SELECT *, coalesce(lag(position) OVER ({S}), 0) AS before FROM ({_positions_sql(2)})) WHERE position <> before)"
    return made | {
        "bars": (lambda s, d: rounded(bars(s, d), ["asset", "ts"], ["open", "high", "low", "close", "volume"]), picked(BARS, ["asset", "ts"], ["open", "high", "low", "close", "volume"])),
        "macro": (lambda s, d: tables.macro(tables.table(s, d, "lineitem")), MACRO),
        "price_range": (lambda s, d: rounded(tables.price_range(bars(s, d), "NO", "1996-01-01", "1996-12-31"), ["asset", "ts"], ["close", "volume"]), picked(f"SELECT * FROM ({BARS}) WHERE asset = 'NO' AND ts BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", ["asset", "ts"], ["close", "volume"])),
        "asof_row": (_asof(False), _asof_sql(False)),
        "asof_value": (_asof(True), _asof_sql(True)),
        "backtest_two_bar_delay": (_backtest(2), _summary_sql(2)),
        "backtest_one_bar_delay": (_backtest(1), _summary_sql(1)),
        "backtest_trades": (backtest_trades, picked(f"SELECT asset, ts AS entry, exit, close AS entry_price, exit_price, (exit_price / close - 1) * position - 0.001 AS pnl FROM ({trades}) WHERE position <> 0 AND exit IS NOT NULL", ["asset", "entry", "exit"], ["entry_price", "exit_price", "pnl"])),
        "screener": (screener, _screener_sql()),
    }


