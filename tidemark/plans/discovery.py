"""Queries over relationships, gates, reports and data-set splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import lag
from tidemark.operators import backtest, features, relations, validation
from tidemark.plans import sql
from tidemark.plans.market import _features, _positions_sql, bars, rounded, signals
from tidemark.plans.sql import BARS, MACRO, STEP, S, picked
from tidemark.sources import tables

RETURNS = f"SELECT asset, ts, ret FROM ({STEP}) WHERE ret IS NOT NULL"
PAIRS = f"SELECT a.asset AS a, b.asset AS b, a.ret AS x, b.ret AS y, row_number() OVER (PARTITION BY a.asset, b.asset ORDER BY a.ts) AS i FROM ({RETURNS}) a JOIN ({RETURNS}) b ON a.ts = b.ts AND a.asset < b.asset"
CORR = "covar_pop({0}, {1}) / nullif(sqrt(var_pop({0}) * var_pop({1})), 0)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("asset", "ts", (F.try_divide("close", lag("close")) - 1).alias("ret")).where("ret is not null")


def _lags(lags: str, condition: str = "true") -> str:
    moved = f"SELECT p.a, p.b, l.lag, q.x, p.y FROM ({PAIRS}) p, {lags} JOIN ({PAIRS}) q ON q.a = p.a AND q.b = p.b AND q.i = p.i + l.lag WHERE {condition}"
    return f"SELECT a, b, lag, corr(x, y) AS r, count(*) AS n FROM ({moved}) GROUP BY 1, 2, 3 HAVING count(*) >= 60"


def hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.hunted(returns(spark, sf_dir), least_r=0.03), ["a", "b", "lag", "n", "strength"], ["r"])


def _hunt_sql() -> str:
    best = f"SELECT * FROM ({_lags('(SELECT unnest(generate_series(-20, 20)) AS lag) l')}) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(r), 9) DESC, lag) = 1"
    return f"SELECT a, b, CAST(lag AS INT) AS lag, n, CASE WHEN abs(r) >= 0.65 THEN 'strong' WHEN abs(r) >= 0.45 THEN 'moderate' ELSE 'weak' END AS strength, round(r, 6) + 0.0 AS r FROM ({best}) WHERE abs(r) >= 0.03"


def leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.leading(returns(spark, sf_dir), "NO", least_r=0.01), ["series", "lag_days", "direction"], ["r"])


def _leading_sql() -> str:
    base = f"SELECT a.asset AS a, a.ret AS x, b.ret AS y, row_number() OVER (PARTITION BY a.asset ORDER BY a.ts) AS i FROM ({RETURNS}) a JOIN ({RETURNS}) b ON a.ts = b.ts WHERE a.asset <> 'NO' AND b.asset = 'NO'"
    moved = f"SELECT p.a, l.lag, q.x, p.y FROM ({base}) p, (SELECT unnest(generate_series(1, 21)) AS lag) l JOIN ({base}) q ON q.a = p.a AND q.i = p.i - l.lag"
    best = f"SELECT * FROM (SELECT a, lag, corr(x, y) AS r, count(*) AS n FROM ({moved}) GROUP BY 1, 2 HAVING count(*) >= 60) QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(abs(r), 9) DESC, lag) = 1"
    return f"SELECT a AS series, CAST(lag AS INT) AS lag_days, CASE WHEN r > 0 THEN 'positive' ELSE 'inverse' END AS direction, round(r, 6) + 0.0 AS r FROM ({best}) WHERE abs(r) >= 0.01 ORDER BY abs(r) DESC LIMIT 15"


def stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = returns(spark, sf_dir).groupBy("ts").agg(F.avg("ret").alias("value"))
    return rounded(relations.stress(days), ["ts", "stress"], ["value"])


#: Keeps shares of small tables off the middle between two printed figures.
NEAR = 0.99991
FOLDS = """SELECT l_returnflag AS model, l_linenumber AS fold, avg(CAST(l_discount >= 0.05 AS INT)) * 0.99991 AS accuracy, avg(CAST(l_tax >= 0.04 AS INT)) * 0.99991 AS hit_rate,
 avg(CAST(l_quantity > 24 AS INT)) AS auc, avg(l_discount) * 100 - 5 AS sharpe, avg(l_tax) * 0.99991 AS total_return, avg(l_discount) * 0.99991 - 0.01 AS benchmark_return FROM lineitem GROUP BY 1, 2"""


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    made = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold"))
    made = made.agg((share(F.col("l_discount") >= 0.05) * NEAR).alias("accuracy"), (share(F.col("l_tax") >= 0.04) * NEAR).alias("hit_rate"), share(F.col("l_quantity") > 24).alias("auc"), (F.avg("l_discount") * 100 - 5).alias("sharpe"), (F.avg("l_tax") * NEAR).alias("total_return"), (F.avg("l_discount") * NEAR - 0.01).alias("benchmark_return"))
    return made.withColumn("beat", F.col("total_return") > F.col("benchmark_return"))


def _gates_sql() -> str:
    mean = f"SELECT model, avg(accuracy) AS mean_accuracy, avg(hit_rate) AS mean_hit_rate, avg(auc) AS mean_auc, avg(sharpe) AS mean_sharpe, stddev_pop(accuracy) AS std_accuracy, CAST(count(*) FILTER (WHERE total_return > benchmark_return) AS DOUBLE) AS beat, ceil(count(*) / 2) AS least_beat FROM ({FOLDS}) GROUP BY 1"
    one = lambda name, value, limit, op, gate: f"SELECT model, '{name}' AS criterion, {value} AS value, CAST({limit} AS DOUBLE) AS threshold, {value} {op} {limit} AS passed, {gate} AS gate FROM m"
    rows = [one("mean_accuracy", "mean_accuracy", 0.55, ">=", "true"), one("mean_hit_rate", "mean_hit_rate", 0.52, ">=", "true"), one("folds_beat_benchmark", "beat", "least_beat", ">=", "true"), one("std_accuracy", "std_accuracy", 0.08, "<=", "false"), one("mean_auc", "mean_auc", 0.52, ">=", "false"), one("mean_sharpe", "mean_sharpe", 0.0, ">", "false")]
    return f"WITH m AS ({mean}) {' UNION ALL '.join(rows)}"


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.promotion_reasons(folds(spark, sf_dir)).select("model", "fold", "promoted", F.array_join("reasons", "; ").alias("reasons"))


REASONS = f"""SELECT model, fold, accuracy >= 0.55 AND hit_rate >= 0.52 AND total_return > benchmark_return AS promoted,
 printf('accuracy %.3f %s 0.55; hit rate %.3f %s 0.52; return %+.1f%% %s benchmark %+.1f%%', accuracy, CASE WHEN accuracy >= 0.55 THEN '>=' ELSE '<' END, hit_rate, CASE WHEN hit_rate >= 0.52 THEN '>=' ELSE '<' END,
 total_return * 100, CASE WHEN total_return > benchmark_return THEN 'beats' ELSE 'does not beat' END, benchmark_return * 100) AS reasons FROM ({FOLDS})"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_totalprice").alias("score"))
    return validation.ranked(orders, "score", top=50).select("experiment_id", "rank", "score")


def _rule_parts() -> str:
    made = _features()
    return f"SELECT m.asset, m.ts, m.close, CAST(bull > bear + 1 AS INT) AS score FROM (SELECT m.*, {_vote('m.rsi_14 < 30', 'm.macd > m.macd_signal', 'b.bb_pct < 0.2', 'm.ema_9 > m.ema_21')} AS bull, {_vote('m.rsi_14 > 70', 'm.macd < m.macd_signal', 'b.bb_pct > 0.8')} AS bear FROM ({made['feature_moving_averages'][3]}) m JOIN ({made['feature_bands'][3]}) b USING (asset, ts)) m"


def _vote(*conditions: str) -> str:
    return " + ".join(f"CAST(coalesce({c}, false) AS INT)" for c in conditions)


def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = bars(spark, sf_dir)
    made = prices.transform(features.bands).transform(features.moving_averages)
    names = ["total_return_pct", "benchmark_return_pct", "alpha_pct", "annual_return_pct", "sharpe", "sortino", "calmar", "max_drawdown_pct", "win_rate_pct", "avg_trade_pct"]
    return rounded(backtest.report(prices, backtest.rule_signals(made)), ["asset", "bars", "total_trades"], names)


def _report_sql() -> str:
    names = ["total_return_pct", "benchmark_return_pct", "alpha_pct", "annual_return_pct", "sharpe", "sortino", "calmar", "max_drawdown_pct", "win_rate_pct", "avg_trade_pct"]
    step = f"SELECT *, coalesce(close / lag(close) OVER ({S}) - 1, 0) AS ret, coalesce(lag(score) OVER ({S}), 0) AS before FROM ({_rule_parts()})"
    step = f"SELECT *, before * ret - CAST(score <> before AS INT) * 0.001 AS sr, sum(CAST(score <> before AS INT)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS run, lead(score) OVER ({S}) IS NULL AS final FROM ({step})"
    step = f"SELECT *, product(greatest(1 + sr, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS equity FROM ({step})"
    step = f"SELECT *, equity / max(equity) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM ({step})"
    trades = "SELECT asset, count(*) AS total_trades, count(*) FILTER (WHERE NOT open AND trade > 0) AS wins, count(*) FILTER (WHERE NOT open) AS closed, avg(CASE WHEN NOT open THEN trade END) AS avg_trade FROM (SELECT asset, run, sum(ret) AS trade, bool_or(final) AS open FROM step WHERE score = 1 GROUP BY 1, 2) GROUP BY 1"
    done = "SELECT asset, count(*) AS n, product(greatest(1 + sr, 0)) AS g, product(1 + ret) AS b, avg(sr) AS m, stddev_samp(sr) AS sd, stddev_samp(sr) FILTER (WHERE sr < 0) AS dd, min(drawdown) AS low FROM step GROUP BY 1"
    free = "0.05 / 252"
    out = f"SELECT asset, n AS bars, coalesce(total_trades, 0) AS total_trades, (g - 1) * 100 AS total_return_pct, (b - 1) * 100 AS benchmark_return_pct, (g - b) * 100 AS alpha_pct, (pow(g, 252.0 / n) - 1) * 100 AS annual_return_pct, (m - {free}) / (sd + 1e-9) * sqrt(252) AS sharpe, (m - {free}) / (dd + 1e-9) * sqrt(252) AS sortino, coalesce((pow(g, 252.0 / n) - 1) / nullif(abs(low), 0), 0) AS calmar, low * 100 AS max_drawdown_pct, coalesce(wins * 100.0 / nullif(closed, 0), 0) AS win_rate_pct, coalesce(avg_trade, 0) * 100 AS avg_trade_pct FROM d LEFT JOIN t USING (asset)"
    return f"WITH step AS ({step}), t AS ({trades}), d AS ({done}) {picked(out, ['asset', 'bars', 'total_trades'], names)}"


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = bars(spark, sf_dir)
    return backtest.trades(backtest.positions(prices, signals(prices)))


def _trades_sql() -> str:
    found = f"SELECT *, lead(ts) OVER ({S}) AS exit, lead(close) OVER ({S}) AS exit_price FROM (SELECT * FROM (SELECT *, coalesce(lag(position) OVER ({S}), 0) AS before FROM ({_positions_sql(2)})) WHERE position <> before)"
    return f"SELECT asset, ts AS entry, exit, (exit_price / close - 1) * position - 0.001 AS pnl FROM ({found}) WHERE position <> 0 AND exit IS NOT NULL"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), ((F.col("l_discount") + F.col("l_tax")) * 5).alias("score"))


SCORED = "SELECT CAST(l_returnflag = 'R' AS INT) AS label, (l_discount + l_tax) * 5 AS score FROM lineitem"


def _auc_sql() -> str:
    at = f"SELECT k, count(*) FILTER (WHERE label = 1 AND score >= k / 100) AS t, count(*) FILTER (WHERE label = 0 AND score >= k / 100) AS f FROM ({SCORED}), (SELECT unnest(generate_series(0, 100)) AS k) GROUP BY k"
    steps = f"SELECT t, f, lag(t) OVER (ORDER BY k DESC) AS pt, lag(f) OVER (ORDER BY k DESC) AS pf FROM ({at})"
    return f"SELECT round(sum((f - pf) * (t + pt) / 2) / ((SELECT count(*) FROM ({SCORED}) WHERE label = 1) * (SELECT count(*) FROM ({SCORED}) WHERE label = 0)), 6) AS auc FROM ({steps})"


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part of each asset's chronological split, with the share of rising labels, and the version of the data set."""
    made = validation.chronological(features.forward_label(bars(spark, sf_dir)))
    done = made.groupBy("asset", "part").agg(F.count("*").alias("rows"), F.avg("label").alias("rising"), F.min("ts").alias("first"))
    return rounded(done.withColumn("version", validation.dataset_version("all", ["close", "volume"], 5, 0.0)), ["asset", "part", "rows", "first", "version"], ["rising"])


def _dataset_sql() -> str:
    i = f"SELECT *, row_number() OVER ({S}) AS i, count(*) OVER (PARTITION BY asset) AS n, CAST(coalesce(lead(close, 5) OVER ({S}) / close - 1 > 0, false) AS INT) AS label FROM ({BARS})"
    part = "CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END"
    return f"SELECT asset, {part} AS part, count(*) AS rows, min(ts) AS first, sha256('asset=all|columns=close,volume|horizon=5|threshold=0.0')[:12] AS version, round(avg(label), 6) AS rising FROM ({i}) GROUP BY 1, 2"


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    regimes = f"SELECT *, coalesce(CASE WHEN count(x) OVER w = 63 THEN sum(x) OVER w < 0 END, false) AS bear FROM ({PAIRS}) WINDOW w AS (PARTITION BY a, b ORDER BY i ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    side = lambda c: f"CASE WHEN count(*) FILTER (WHERE {c}) >= 20 THEN corr(x, y) FILTER (WHERE {c}) END"
    rank = lambda c: f"rank() OVER (PARTITION BY a, b ORDER BY {c}) + (count(*) OVER (PARTITION BY a, b, {c}) - 1) / 2"
    stress = f"SELECT ts, value, CASE WHEN count(*) OVER w = 21 THEN avg(value) OVER w END AS m FROM (SELECT ts, avg(ret) AS value FROM ({RETURNS}) GROUP BY 1) WINDOW w AS (ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
    days = f"SELECT DISTINCT ts FROM ({BARS}) ORDER BY ts DESC LIMIT 252"
    filled = f"SELECT asset, ts, coalesce(last_value(close IGNORE NULLS) OVER ({S}), first_value(close IGNORE NULLS) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM (SELECT * FROM (SELECT DISTINCT asset FROM ({BARS})), ({days})) g LEFT JOIN ({BARS}) x USING (asset, ts)"
    moves = f"SELECT * FROM (SELECT asset, ts, close / lag(close) OVER ({S}) - 1 AS ret FROM ({filled})) WHERE ret IS NOT NULL"
    return {
        "pair_hunt": (hunt, _hunt_sql()),
        "leading_indicators": (leading, _leading_sql()),
        "regime_correlation": (lambda s, d: rounded(relations.regime_correlation(returns(s, d)), ["a", "b", "n"], ["all", "bear", "bull"]), picked(f'SELECT a, b, count(*) AS n, corr(x, y) AS "all", {side("bear")} AS bear, {side("NOT bear")} AS bull FROM ({regimes}) GROUP BY 1, 2', ["a", "b", "n"], ["bear", "bull"]).replace(" FROM (", ', round("all", 6) + 0.0 AS "all" FROM (', 1)),
        "rank_correlation": (lambda s, d: rounded(relations.rank_correlation(returns(s, d)), ["a", "b", "n"], ["spearman"]), f"SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS spearman FROM (SELECT a, b, {rank('x')} AS rx, {rank('y')} AS ry FROM ({PAIRS})) GROUP BY 1, 2"),
        "stress_regime": (stressed, f"SELECT ts, coalesce(m > (SELECT quantile_cont(m, 0.75) FROM ({stress})), false) AS stress, round(value, 6) + 0.0 AS value FROM ({stress})"),
        "correlation_edges": (lambda s, d: rounded(relations.correlation_edges(bars(s, d), least=0.01), ["a", "b"], ["r"]), f"SELECT a.asset AS a, b.asset AS b, round(corr(a.ret, b.ret), 6) + 0.0 AS r FROM ({moves}) a JOIN ({moves}) b ON a.ts = b.ts AND a.asset < b.asset GROUP BY 1, 2 HAVING abs(corr(a.ret, b.ret)) >= 0.01"),
        "promotion_gates": (lambda s, d: rounded(validation.gates(folds(s, d), ["model"]), ["model", "criterion", "passed", "gate"], ["value", "threshold"]), picked(_gates_sql(), ["model", "criterion", "passed", "gate"], ["value", "threshold"])),
        "promotion_verdict": (lambda s, d: validation.recommended(validation.gates(folds(s, d), ["model"]), ["model"]), f"SELECT model, count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n, coalesce(string_agg(CASE WHEN gate AND NOT passed THEN criterion END, ', ' ORDER BY criterion), '') AS failed, count(*) FILTER (WHERE gate AND NOT passed) = 0 AS overall FROM ({_gates_sql()}) GROUP BY 1"),
        "promotion_reasons": (reasons, REASONS),
        "experiment_ranking": (ranked, "SELECT o_orderkey AS experiment_id, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
        "rule_backtest_report": (rule_report, _report_sql()),
        "hit_rate": (lambda s, d: rounded(backtest.hit_rate(_trades(s, d)), ["asset", "n_trades"], ["hit_rate"]), f"SELECT asset, count(*) AS n_trades, round(avg(CAST(pnl > 0 AS INT)), 6) AS hit_rate FROM ({_trades_sql()}) GROUP BY 1"),
        "last_trades": (lambda s, d: rounded(backtest.last_trades(_trades(s, d)), ["asset", "entry", "exit", "days_held", "win"], ["pnl"]), picked(f"SELECT *, CAST(exit - entry AS INT) AS days_held, pnl > 0 AS win FROM ({_trades_sql()}) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY entry DESC) <= 20", ["asset", "entry", "exit", "days_held", "win"], ["pnl"])),
        "auc_by_thresholds": (lambda s, d: rounded(validation.auc_by_thresholds(scored(s, d)), [], ["auc"]), _auc_sql()),
        "dataset_split": (dataset, _dataset_sql()),
    }
