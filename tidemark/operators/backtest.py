"""Signal backtests over bars: two conventions of delay, drawdown, and trades as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import in_time, lag, so_far


def factor() -> Column:
    """Growth of a bar; costs on top of a loss take no more than all there is."""
    return F.greatest(1 + F.col("strategy_return"), F.lit(0.0))


def positions(prices: DataFrame, signals: DataFrame, threshold: float = 0.5, cost: float = 0.001, delay: int = 2, short: bool = False) -> DataFrame:
    """Bars with position, strategy return, equity and drawdown. The signal (score) acts ``delay`` bars later:

    with 2 the position is that of the bar before and its return counts from the next bar; with 1 at once.
    A missing score is 0. Costs fall due once on bars where the position changes. With ``short`` a signal below the threshold is a position of -1.
    """
    held = F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0))
    scored = prices.join(signals, ["asset", "ts"]).withColumn("_want", held * 2 - 1 if short else held)
    step = scored.withColumns({"position": F.coalesce(lag("_want"), F.lit(0)), "_ret": F.coalesce(F.try_divide("close", lag("close")) - 1, F.lit(0.0))})
    held = F.coalesce(lag("position"), F.lit(0)) if delay == 2 else F.col("position")
    step = step.withColumns({"_held": held, "_change": (F.col("position") != F.coalesce(lag("position"), F.lit(0))).cast("int")})
    step = step.withColumn("strategy_return", F.col("_held") * F.col("_ret") - F.col("_change") * cost)
    step = step.withColumn("equity", F.product(factor()).over(so_far()))
    return step.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far()) - 1).drop("_want", "_ret", "_held", "_change", "score")


def summary(bars: DataFrame) -> DataFrame:
    """Return, annual return, Sharpe ratio and largest drawdown of each asset's ``positions``."""
    done = bars.groupBy("asset").agg(F.count("*").alias("n_bars"), F.product(factor()).alias("growth"), F.stddev_samp("strategy_return").alias("sd"), F.min("drawdown").alias("max_drawdown"))
    annual = F.pow("growth", F.lit(252) / F.col("n_bars")) - 1
    return done.select("asset", "n_bars", (F.col("growth") - 1).alias("total_return"), annual.alias("annual_return"), F.coalesce(F.try_divide(annual, F.col("sd") * F.sqrt(F.lit(252.0))), F.lit(0.0)).alias("sharpe"), "max_drawdown")


def trades(bars: DataFrame, cost: float = 0.001) -> DataFrame:
    """(asset, entry, exit, entry_price, exit_price, pnl) between changes of position; a trade still open at the end is left out."""
    changes = bars.withColumn("_before", F.coalesce(lag("position"), F.lit(0))).where("position <> _before")
    islands = changes.withColumns({"exit": F.lead("ts").over(in_time()), "exit_price": F.lead("close").over(in_time())}).where("position <> 0 and exit is not null")
    pnl = (F.col("exit_price") / F.col("close") - 1) * F.col("position") - cost
    return islands.select("asset", F.col("ts").alias("entry"), "exit", F.col("close").alias("entry_price"), "exit_price", pnl.alias("pnl"))


def hit_rate(made: DataFrame) -> DataFrame:
    """(asset, n_trades, hit_rate): the share of trades with a gain. Assets without trades are not there; their rate is 0."""
    return made.groupBy("asset").agg(F.count("*").alias("n_trades"), F.avg((F.col("pnl") > 0).cast("int")).alias("hit_rate"))


def rule_signals(featured: DataFrame) -> DataFrame:
    """(asset, ts, score): 1 where votes to buy (of rsi_14, macd, bb_pct and the crossing of two means) outnumber those to sell by two or more."""
    vote = lambda *c: sum((F.coalesce(x, F.lit(False)).cast("int") for x in c), F.lit(0))
    bull = vote(F.col("rsi_14") < 30, F.col("macd") > F.col("macd_signal"), F.col("bb_pct") < 0.2, F.col("ema_9_21_cross") == 1)
    bear = vote(F.col("rsi_14") > 70, F.col("macd") < F.col("macd_signal"), F.col("bb_pct") > 0.8)
    return featured.select("asset", "ts", (bull > bear + 1).cast("int").alias("score"))


def report(prices: DataFrame, signals: DataFrame, cost: float = 0.001, risk_free: float = 0.05) -> DataFrame:
    """One row an asset: returns, alpha, Sharpe, Sortino, Calmar, drawdown, win rate and number of trades, in percent where named so.

    The signal of a bar earns the return of the next; a bar where it changes costs ``cost``. A trade's return is the sum of the
    asset's returns from its first bar to the bar before its last; an open trade has none.
    """
    step = prices.join(signals, ["asset", "ts"]).withColumn("ret", F.coalesce(F.try_divide("close", lag("close")) - 1, F.lit(0.0)))
    before = F.coalesce(lag("score"), F.lit(0))
    step = step.withColumns({"strategy_return": before * F.col("ret") - (F.col("score") != before).cast("int") * cost, "_run": F.sum((F.col("score") != before).cast("int")).over(so_far())})
    step = step.withColumns({"equity": F.product(factor()).over(so_far()), "_open": F.lead("score").over(in_time()).isNull()})
    step = step.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far()) - 1)
    won = step.where("score = 1").groupBy("asset", "_run").agg(F.sum("ret").alias("trade"), F.max(F.col("_open").cast("int")).alias("open")).groupBy("asset")
    won = won.agg(F.count("*").alias("total_trades"), F.count_if((F.col("open") == 0) & (F.col("trade") > 0)).alias("wins"), F.count_if(F.col("open") == 0).alias("closed"), F.avg(F.when(F.col("open") == 0, F.col("trade"))).alias("avg_trade"))
    free = risk_free / 252
    loss = F.when(F.col("strategy_return") < 0, F.col("strategy_return"))
    done = step.groupBy("asset").agg(F.count("*").alias("n"), F.product(factor()).alias("g"), F.product(1 + F.col("ret")).alias("b"), F.avg("strategy_return").alias("m"), F.stddev_samp("strategy_return").alias("sd"), F.stddev_samp(loss).alias("dd"), F.min("drawdown").alias("low"))
    done = done.join(won, "asset", "left").withColumn("annual", F.pow("g", F.lit(252) / F.col("n")) - 1)
    year = F.sqrt(F.lit(252.0))
    return done.select("asset", F.col("n").alias("bars"), ((F.col("g") - 1) * 100).alias("total_return_pct"), ((F.col("b") - 1) * 100).alias("benchmark_return_pct"), ((F.col("g") - F.col("b")) * 100).alias("alpha_pct"), (F.col("annual") * 100).alias("annual_return_pct"),
                       ((F.col("m") - free) / (F.col("sd") + 1e-9) * year).alias("sharpe"), ((F.col("m") - free) / (F.col("dd") + 1e-9) * year).alias("sortino"), F.coalesce(F.try_divide("annual", F.abs("low")), F.lit(0.0)).alias("calmar"), (F.col("low") * 100).alias("max_drawdown_pct"),
                       F.coalesce(F.try_divide(F.col("wins") * 100.0, "closed"), F.lit(0.0)).alias("win_rate_pct"), F.coalesce("total_trades", F.lit(0)).alias("total_trades"), (F.coalesce("avg_trade", F.lit(0.0)) * 100).alias("avg_trade_pct"))


def last_trades(made: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` trades of each asset with the days they were held and whether they won."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("entry")))
    return made.withColumn("_k", k).where(F.col("_k") <= n).drop("_k").withColumns({"days_held": F.datediff("exit", "entry"), "win": F.col("pnl") > 0})
