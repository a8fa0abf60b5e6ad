"""Checks, outliers, reconciliation, quarantine and keep-latest upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def z_scores(df: DataFrame, column: str, key: str = "asset") -> DataFrame:
    """Adds z: sample z-score within the key; 0 for a single row or no variation. Statistics are aggregated, then joined."""
    stats = df.groupBy(key).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"), F.count(column).alias("_n"))
    z = F.when((F.col("_n") < 2) | (F.coalesce("_s", F.lit(0.0)) == 0), 0.0).otherwise((F.col(column) - F.col("_m")) / F.col("_s"))
    return df.join(stats, key).withColumn("z", z).drop("_m", "_s", "_n")


def flagged(bars: DataFrame, price_z: float = 4, volume_z: float = 6) -> DataFrame:
    """Bars that fail a pass, each with its first reason: price outlier, then volume spike. One window of each asset gives both."""
    w = Window.partitionBy("asset")
    off = lambda c: F.when((F.count(c).over(w) < 2) | (F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)) == 0), 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w))
    step = bars.select("asset", "ts", off("close").alias("price"), off("volume").alias("spike"))
    reason = F.when(F.abs("price") > price_z, F.struct(F.col("price").alias("z"), F.lit("price_outlier").alias("reason"))).when(F.col("spike") > volume_z, F.struct(F.col("spike").alias("z"), F.lit("volume_spike").alias("reason")))
    return step.select("asset", "ts", reason.alias("r")).where("r is not null").select("asset", "ts", "r.z", "r.reason")


def reconciled(a: DataFrame, b: DataFrame, key: str, tolerance: float = 0.005) -> DataFrame:
    """Keys whose value in ``b`` (key, at, value; the last one wins) differs from ``a`` (key, value) by more than the tolerance of a's."""
    last = b.groupBy(key).agg(F.max_by("value", "at").alias("other"))
    diff = F.abs(F.col("other") - F.col("value")) / F.abs("value")
    return a.where("value <> 0").join(last, key).withColumn("diff", diff).where(F.col("diff") > tolerance)


def checks(bars: DataFrame, as_of: str, min_rows: int = 10, max_null_rate: float = 0.05, stale_days: int = 7) -> DataFrame:
    """(asset, check, severity, passed, detail) of the OHLCV suite, in one aggregate over each asset."""
    nulls = [F.avg(F.col(c).isNull().cast("int")) for c in ("open", "high", "low", "close", "volume")]
    insane = F.count_if((F.col("high") < F.col("low")) | ~F.col("close").between(F.col("low"), F.col("high")) | (F.col("volume") < 0))
    found = bars.groupBy("asset").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("ts")).alias("dup"), F.greatest(*nulls).alias("nulls"), insane.alias("insane"), F.datediff(F.lit(as_of).cast("date"), F.max("ts")).alias("age"))
    one = lambda name, severity, ok, detail: F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), ok.alias("passed"), detail.cast("double").alias("detail"))
    rows = F.array(one("row_count", "ERROR", F.col("n") >= min_rows, F.col("n")), one("duplicate_timestamps", "ERROR", F.col("dup") == 0, F.col("dup")), one("null_rate", "ERROR", F.col("nulls") <= max_null_rate, F.col("nulls")), one("price_sanity", "ERROR", F.col("insane") == 0, F.col("insane")), one("stale_data", "WARN", F.col("age") <= stale_days, F.col("age")))
    return found.select("asset", F.inline(rows))


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of each key the new row, or the old one where there is none; among several new ones the last by ``order``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *order)).alias("r"))
    return best.select(*keys, "r.*").select(old.columns)


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
