"""Relationships between series: lagged, regime and rank correlation, leading indicators, factor exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import safe_corr
from tidemark.operators.pairwise import average_ranks, best_lag, by_direction, correlation, correlations, pairwise


def shifted(found: DataFrame, lags: list[int]) -> DataFrame:
    """(a, b, lag, r, n) of rows (a, b, i, x, y): x at i + lag with y at i. One window over a pair gives all lags; no join."""
    w = Window.partitionBy("a", "b").orderBy("i")
    moved = [F.struct(F.lit(k).alias("lag"), (F.lead("x", k).over(w) if k > 0 else F.lag("x", -k).over(w) if k < 0 else F.col("x")).alias("x")) for k in lags]
    each = found.select("a", "b", "y", F.array(*moved).alias("each")).select("a", "b", "y", F.inline("each")).where("x is not null")
    return each.groupBy("a", "b", "lag").agg(safe_corr("x", "y").alias("r"), F.count("*").alias("n"))


def lag_sweep(series: DataFrame, most: int = 20, least_rows: int = 60) -> DataFrame:
    """Each pair's best lag: the largest |r|, of equal ones the smallest lag. x at i + lag meets y at i, so b leads for a positive lag."""
    best = pairwise(series, lambda x, y: best_lag(x, y, most, least_rows), "lag int, r double, n long")
    return best.withColumn("leader", F.when(F.col("lag") > 0, F.col("b")).when(F.col("lag") < 0, F.col("a")))


def hunted(series: DataFrame, most_pairs: int | None = None, least_r: float = 0.35, **sweep) -> DataFrame:
    """Pairs whose best lagged correlation is at least ``least_r``, the strongest first, with their strength; ``most_pairs`` is a limit on what is reported."""
    found = lag_sweep(series, **sweep).where(F.abs("r") >= least_r).withColumn("strength", strength())
    found = found.orderBy(F.desc(F.round(F.abs("r"), 9)), "a", "b")
    return found.limit(most_pairs) if most_pairs else found


def leading(series: DataFrame, target: str, most: int = 21, least_rows: int = 60, least_r: float = 0.35, top: int = 15) -> DataFrame:
    """Series that lead ``target`` by 1 to ``most`` days: their best lag, |r| of at least ``least_r``, the ``top`` strongest."""
    x = series.where(F.col("asset") != target).select("asset", "ts", F.col("ret").alias("x")).dropna()
    y = series.where(F.col("asset") == target).select("ts", F.col("ret").alias("y")).dropna()
    found = x.join(y, "ts").withColumns({"a": F.col("asset"), "b": F.lit(target)}).withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("ts")))
    r = shifted(found.select("a", "b", "x", "y", "i"), [-k for k in range(1, most + 1)]).where(F.col("n") >= least_rows)
    best = r.groupBy("a").agg(F.min_by(F.struct("lag", "r"), F.struct(-F.round(F.abs("r"), 9), -F.col("lag"))).alias("best")).select(F.col("a").alias("series"), (-F.col("best.lag")).alias("lag_days"), F.col("best.r").alias("r"))
    return best.where(F.abs("r") >= least_r).withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("inverse")).orderBy(F.desc(F.abs("r")), "series").limit(top)


def regime_correlation(series: DataFrame, least_rows: int = 60, least_regime: int = 20) -> DataFrame:
    """all, bear and bull correlation of each pair; bear: the last 63 common days of x sum below zero, the days before are bull."""
    return pairwise(series, lambda x, y: by_direction(x, y, least_rows, least_regime), "n long, all double, bear double, bull double")


def rank_correlation(series: DataFrame) -> DataFrame:
    """Spearman's r of each pair: the correlation of average ranks among the days that both have."""
    return pairwise(series, lambda x, y: [(correlation(average_ranks(x), average_ranks(y)), len(x))] if len(x) else [], "spearman double, n long")


def stress(levels: DataFrame, n: int = 21, q: float = 0.75) -> DataFrame:
    """(ts, value, stress) of a series (ts, value): whether the mean of the last n values, gaps as 0, is above its own upper quantile. One series, so its days are one window."""
    w = Window.orderBy("ts").rowsBetween(-(n - 1), 0)
    mean = levels.withColumn("_m", F.when(F.count("*").over(w) == n, F.avg(F.coalesce("value", F.lit(0.0))).over(w)))
    limit = mean.agg(F.percentile("_m", F.lit(q)).alias("_q"))
    return mean.crossJoin(F.broadcast(limit)).select("ts", "value", F.coalesce(F.col("_m") > F.col("_q"), F.lit(False)).alias("stress"))


def exposures(rows: DataFrame, by: list[str], least_rows: int = 60) -> DataFrame:
    """Least squares y on x of each group: beta, alpha, r2, se, t, n. Regimes are one more grouping column."""
    fit = rows.where("x is not null and y is not null").groupBy(*by).agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.count("*").alias("n"))
    se = F.sqrt(F.try_divide(F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0)), (F.col("n") - 2) * F.col("sxx")))
    return fit.where(F.col("n") >= least_rows).withColumn("se", se).withColumn("t", F.try_divide("beta", "se")).drop("sxx", "syy")


def significant(fits: DataFrame, least_t: float = 2.0) -> DataFrame:
    """``exposures`` with p of t (two-sided, n - 2 degrees) of at least ``least_t``, and their strength by t."""
    from tidemark.operators.baseline import t_tail

    size = F.abs("t")
    return fits.where(size >= least_t).withColumns({"p": t_tail(F.col("t"), F.col("n") - 2), "strength": F.when(size >= 4, "strong").when(size >= 2.5, "moderate").otherwise("weak")})


def bear(ret: str = "ret", n: int = 63) -> Column:
    """Days whose last n returns sum below zero; where fewer are there, false."""
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(-(n - 1), 0)
    return F.coalesce(F.when(F.count(ret).over(w) == n, F.sum(ret).over(w) < 0), F.lit(False))


def strength(r: str = "r") -> Column:
    return F.when(F.abs(r) >= 0.65, "strong").when(F.abs(r) >= 0.45, "moderate").otherwise("weak")


def correlation_edges(prices: DataFrame, days: int = 252, least: float = 0.5) -> DataFrame:
    """(a, b, r) of pairs whose returns over the last ``days`` days of the calendar correlate by ``least`` or more; gaps carry the last close, leading ones the first."""
    calendar = prices.select("ts").distinct().orderBy(F.desc("ts")).limit(days)
    grid = prices.select("asset").distinct().crossJoin(calendar).join(prices.select("asset", "ts", "close"), ["asset", "ts"], "left")
    w = Window.partitionBy("asset").orderBy("ts")
    filled = grid.withColumn("close", F.coalesce(F.last("close", ignorenulls=True).over(w), F.first("close", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    ret = filled.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1).select("asset", "ts", "ret")
    return correlations(ret).select("a", "b", "r").where(F.abs("r") >= least)
