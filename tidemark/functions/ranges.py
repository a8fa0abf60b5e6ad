"""Running sums over all rows without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a group are cut into.
RANGES = 256


def running(rows: DataFrame, value: str, weight: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """The rows (by, value, weight; a value once in its group) with ``before``: the weight of their group's smaller values.

    Each group is cut at quantiles of its values, so ranges hold about as many rows each however the values lie. Running sums
    stay within a range; the totals of ranges (at most ``ranges`` + 1 a group) give each its offset.
    """
    by, ranges = by or [], max(ranges, 2)
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(10 * ranges))).alias("_cuts"))
    dealt = (rows.join(cuts, by) if by else rows.crossJoin(F.broadcast(cuts))).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = dealt.groupBy(*by, "_range").agg(F.sum(weight).alias("_own"))
    offsets = totals.withColumn("_before", F.sum("_own").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_own")).drop("_own")
    own = F.sum(weight).over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(offsets, [*by, "_range"]).withColumn("before", F.coalesce(own, F.lit(0)) + F.col("_before")).drop("_range", "_before")
