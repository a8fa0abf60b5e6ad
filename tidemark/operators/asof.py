"""As-of alignment of sparse series to the rows of others, by union and one window: no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, value: str, skip_nulls: bool) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` (key, ts, value) at or before each row's ts, of the same key.

    skip_nulls: the latest that is not null; else the latest row, null or not. Rows of ``left`` stay as often as they came.
    The distinct days of a key are aligned first (their number is bounded by the calendar), so that a key of
    many rows is no large window; the values are joined by key and day.
    """
    days = left.select(key, "ts").distinct().withColumns({"_right": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType), "_any": F.lit(None).cast("struct<v:double>")})
    other = right.select(key, "ts", F.lit(0).alias("_right"), F.col(value).alias("_value"), F.struct(F.col(value).cast("double").alias("v")).alias("_any"))
    w = Window.partitionBy(key).orderBy("ts", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_value", ignorenulls=True).over(w) if skip_nulls else F.last("_any", ignorenulls=True).over(w)["v"]
    known = days.unionByName(other).withColumn(value, found).where("_right = 1").select(key, "ts", value)
    return left.join(known, [key, "ts"], "left").select(*left.columns, value)


def event_distance(days: DataFrame, events: list[str]) -> DataFrame:
    """Days to the next and since the last event date (same day included), and the distance to the nearest."""
    dates = F.array(*(F.lit(e).cast("date") for e in sorted(events)))
    gaps = F.transform(dates, lambda e: F.datediff(e, F.col("ts")))
    done = days.withColumns({"days_until": F.array_min(F.filter(gaps, lambda g: g >= 0)), "days_since": -F.array_max(F.filter(gaps, lambda g: g <= 0)), "days_nearest": F.array_min(F.transform(gaps, F.abs))})
    return done.withColumn("near_event", F.coalesce(F.col("days_nearest") <= 3, F.lit(False)).cast("int"))
