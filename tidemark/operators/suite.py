"""Validation suites over any table: one row a check, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume")


def _row(name: str, severity: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), passed.alias("passed"), detail.cast("double").alias("detail"))


def time_series(df: DataFrame, by: str, time: str, as_of: str, arrival: str | None = None, required: tuple[str, ...] = (), expected: tuple[str, ...] | None = None, keys: tuple[str, ...] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None,
                min_rows: int = 10, max_null: float = 0.05, max_stale: int = 7, max_outside: float = 0.001, extra: list[Column] | None = None) -> DataFrame:
    """(by, check, severity, passed, detail) for each group of ``by``.

    required_columns and schema_drift are decided by the schema (detail: columns missing, or added and removed). null_rate: the
    worst of ``keys``. duplicate_rows, duplicate_timestamps: rows beyond the first of equals. monotonic_timestamps: rows earlier
    than the one that arrived before (order ``arrival``). numeric_range_*: the share of numbers outside; text that is no number
    is left out, a column without numbers fails. A column that is missing is not checked. Equal rows are counted first, so the
    checks are one aggregate over distinct rows; only the order of arrival needs a window.
    """
    have, keys, ranges = df.columns, keys or tuple(df.columns), ranges or {}
    there = [c for c in keys if c in have]
    counted = df.groupBy([F.col(c) for c in have]).agg(F.count("*").alias("_n"))
    outside = {}
    for c, (low, high) in ranges.items():
        if c in have:
            x = F.col(c).try_cast("double")
            outside[c] = (F.sum(F.when(x.isNotNull(), F.col("_n"))), F.sum(F.when((x < low if low is not None else F.lit(False)) | (x > high if high is not None else F.lit(False)), F.col("_n"))))
    nulls = [F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)) for c in there]
    aggregates = [F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("same"), F.greatest(*nulls, F.lit(0)).alias("nulls")]
    if time in have:
        aggregates += [(F.sum(F.when(F.col(time).isNotNull(), F.col("_n"))) - F.count_distinct(time)).alias("ties"), F.datediff(F.lit(as_of).cast("date"), F.max(time)).alias("age")]
    aggregates += [x.alias(f"_{kind}_{c}") for c, pair in outside.items() for kind, x in zip(("all", "out"), pair)]
    aggregates += [x for x in extra or []]
    found = counted.groupBy(by).agg(*aggregates)
    missing = len([c for c in required if c not in have])
    rows = [_row("required_columns", "ERROR", F.lit(missing == 0), F.lit(missing))] if required else []
    rows += [_row("row_count", "ERROR", F.col("rows") >= min_rows, F.col("rows")), _row("null_rate", "ERROR", F.col("nulls") <= max_null * F.col("rows"), F.col("nulls") / F.col("rows")), _row("duplicate_rows", "WARN", F.col("same") == 0, F.col("same"))]
    if time in have:
        rows += [_row("duplicate_timestamps", "ERROR", F.col("ties") == 0, F.col("ties")), _row("stale_data", "WARN", F.col("age") <= max_stale, F.col("age"))]
    if expected is not None:
        drift = len(set(have) ^ set(expected))
        rows.append(_row("schema_drift", "WARN", F.lit(drift == 0), F.lit(drift)))
    for c in outside:
        share = F.coalesce(F.try_divide(F.coalesce(F.col(f"_out_{c}"), F.lit(0)), F.col(f"_all_{c}")), F.lit(1.0))
        rows.append(_row(f"numeric_range_{c}", "ERROR", share <= max_outside, share))
    if extra:
        rows.append(_row("price_sanity", "ERROR", F.col("insane") == 0, F.col("insane")))
    done = found.select(by, F.inline(F.array(*rows)))
    if arrival:
        back = df.select(by, (F.col(time) < F.lag(time).over(Window.partitionBy(by).orderBy(arrival))).alias("back")).groupBy(by).agg(F.count_if("back").alias("n"))
        done = done.unionAll(back.select(by, F.inline(F.array(_row("monotonic_timestamps", "WARN", F.col("n") == 0, F.col("n"))))))
    return done


def prices(df: DataFrame, by: str, as_of: str, time: str = "ts", **options) -> DataFrame:
    """The suite of bars: stricter limits, prices and volumes not below zero, and sane bars."""
    insane = F.sum(F.when((F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")) | (F.col("volume") < 0), F.col("_n")).otherwise(0)).alias("insane")
    options = {"min_rows": 20, "max_null": 0.01, "max_stale": 5, "keys": PRICES, "required": PRICES, "ranges": dict.fromkeys(PRICES, (0.0, None))} | options
    return time_series(df, by, time, as_of, extra=[insane], **options)


def verdict(checks: DataFrame, by: str) -> DataFrame:
    """passed: no ERROR failed; and the numbers of failed errors and warnings."""
    failed = lambda s: F.count_if((F.col("severity") == s) & ~F.col("passed"))
    return checks.groupBy(by).agg(failed("ERROR").alias("errors"), failed("WARN").alias("warnings"), F.count("*").alias("checks")).withColumn("passed", F.col("errors") == 0)


def filtered(rows: DataFrame, reasons: list[DataFrame], keys: list[str]) -> DataFrame:
    """``rows`` with the reason of the first pass that names them (null: clean); each pass is (keys, reason)."""
    named = [r.select(*keys, F.lit(k).alias("_pass"), "reason") for k, r in enumerate(reasons)]
    first = named[0]
    for other in named[1:]:
        first = first.unionAll(other)
    return rows.join(first.groupBy(*keys).agg(F.min_by("reason", "_pass").alias("reason")), keys, "left")
