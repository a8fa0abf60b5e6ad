"""Tables of a folder, and the domain tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders trades of a day; dates are midnight and order lines are not unique, so every column counts.
TIE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, keys: list[str], price: str, volume: str, tie: list[str]) -> DataFrame:
    """First, highest, lowest and last price and total volume of each key; ``tie`` orders its ticks."""
    order = F.struct(*tie)
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume")
    )


def bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars (asset, ts, open, high, low, close, volume) of unit prices, an asset for each flag and status."""
    ticks = lineitem.withColumns({"asset": F.concat("l_returnflag", "l_linestatus"), "ts": F.to_date("l_shipdate"), "price": F.col("l_extendedprice") / F.col("l_quantity")})
    return ohlcv(ticks, ["asset", "ts"], "price", "l_quantity", list(TIE))


def macro(lineitem: DataFrame) -> DataFrame:
    """Monthly series (indicator, ts, value): the mean discount of each return flag, dated by the month's first day."""
    month = F.trunc("l_shipdate", "month").alias("ts")
    return lineitem.groupBy(F.col("l_returnflag").alias("indicator"), month).agg(F.round(F.avg("l_discount"), 6).alias("value"))


def price_range(prices: DataFrame, asset: str, start: str, end: str) -> DataFrame:
    """Rows of an asset with start <= ts <= end, by time; the filter reaches a Parquet scan."""
    return prices.where((F.col("asset") == asset) & F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("ts")
