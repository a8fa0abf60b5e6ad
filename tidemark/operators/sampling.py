"""Samples of landed bodies: their columns and types, which column is the time, a quality score, and what that means for the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import transitioned
from tidemark.sources.payloads import sniffed

#: Names of columns that hold times, and numbers.
TIME_NAMES = ("date", "time", "timestamp", "datetime", "created_at", "updated_at", "published_at", "period", "observation_date", "realtime_start")
NUMBER_NAMES = ("value", "close", "open", "high", "low", "volume", "price", "rate", "yield", "amount", "score", "count", "market_cap", "eps", "revenue", "gdp", "inflation", "yield_pct")
#: Rows of a sample, least rows, largest share of missing cells, rows that are looked at for a number.
ROWS, LEAST_ROWS, MOST_NULLS, LOOKED_AT = 50, 2, 0.5, 5
#: From narrow to wide; a column has the narrowest type that all its values have.
TYPES = ("boolean", "bigint", "double", "date", "timestamp")


def rows_of(raw: DataFrame, most: int = ROWS) -> DataFrame:
    """(id, format, i, row): the first ``most`` rows of each body (id, body), numbered from 1, as maps from column to text; one null row where a body has none."""
    return sniffed(raw, most).select("id", "format", F.posexplode_outer("rows").alias("i", "row")).withColumn("i", F.col("i") + 1)


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def _is(kind: str) -> Column:
    """Whether the text ``value`` is of a type."""
    if kind == "boolean":
        return F.lower("value").isin("true", "false")
    if kind == "date":
        return F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("value").try_cast("date").isNotNull()
    if kind == "timestamp":
        return F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}") & F.col("value").try_cast("timestamp").isNotNull()
    if kind == "bigint":
        return F.col("value").rlike(r"^\s*[+-]?\d+\s*$") & F.col("value").try_cast("bigint").isNotNull()
    return F.col("value").try_cast("double").isNotNull()


def columns_of(rows: DataFrame) -> DataFrame:
    """(id, name, n_filled, type, share_of_times, votes): of each column of each sample its type merged over all its rows, and its votes for being the time.

    A value is of each type that its text can be read as; the merged type is the narrowest that all values share, bigint and double meet
    in double, date and timestamp in timestamp, all else in string; null without values. Votes are the share of values that are times, and one more for a name.
    """
    each = rows.where("row is not null").select("id", F.explode("row").alias("name", "value"))
    filled = each.withColumn("value", F.when(~_blank(F.col("value")), F.trim("value")))
    found = filled.groupBy("id", "name").agg(F.count("value").alias("n_filled"), *(F.count_if(F.col("value").isNotNull() & _is(t)).alias(f"_{t}") for t in TYPES))
    whole = lambda t: F.col(f"_{t}") == F.col("n_filled")
    kind = F.when(F.col("n_filled") == 0, None)
    for t in TYPES:
        kind = kind.when(whole(t), t)
    times = F.coalesce(F.try_divide(F.col("_timestamp").cast("double"), F.col("n_filled")), F.lit(0.0))
    return found.select("id", "name", "n_filled", kind.otherwise("string").alias("type"), times.alias("share_of_times"), (times + F.lower("name").isin(*TIME_NAMES).cast("int")).alias("votes"))


def variant_schemas(rows: DataFrame) -> DataFrame:
    """(id, schema): the rows of each sample read as variants, numbers and booleans by their text, and their schema merged by Spark; null without rows."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    plain = lambda x: x.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$") | x.isin("true", "false")
    value = lambda x: F.when(_blank(x), F.lit("null")).when(plain(F.trim(x)), F.trim(x)).otherwise(quoted(x))
    cell = lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e["value"]))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("row"), cell), ","), F.lit("}"))
    return rows.groupBy("id").agg(F.schema_of_variant_agg(F.when(F.col("row").isNotNull(), F.try_parse_json(text))).alias("schema"))


def quality(rows: DataFrame) -> DataFrame:
    """(id, format, n_rows, n_columns, null_rate, time_column, has_times, has_numbers, score, passed, issues, columns) of each sample.

    Cells are all rows times all columns of any row; a missing one is null, or blank. Issues: no rows, too few, no columns, too many nulls. The score is the mean of four parts: rows up to 50, filled cells, a
    time column, numbers.
    """
    names = columns_of(rows)
    shape = rows.groupBy("id").agg(F.first("format").alias("format"), F.count("row").alias("n_rows"))
    vote = F.min_by("name", F.struct(-F.col("votes"), "name"))
    typed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", F.coalesce("type", F.lit("null"))))), ", ")
    wide = names.groupBy("id").agg(
        F.count("*").alias("n_columns"), F.sum("n_filled").alias("n_filled"), F.max("votes").alias("votes"), vote.alias("voted"), F.bool_or(F.lower("name").isin(*TIME_NAMES)).alias("has_times"),
        F.bool_or(F.lower("name").isin(*NUMBER_NAMES)).alias("named_number"), typed.alias("columns"),
    )
    seen = rows.where((F.col("i") <= LOOKED_AT) & F.col("row").isNotNull()).select("id", F.explode(F.map_values("row")).alias("value"))
    numbers = seen.groupBy("id").agg(F.bool_or(F.trim("value").try_cast("double").isNotNull()).alias("seen_number"))
    done = shape.join(wide, "id", "left").join(numbers, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_columns", "n_filled")})
    done = done.withColumn("null_rate", F.coalesce(1 - F.try_divide(F.col("n_filled").cast("double"), F.col("n_rows") * F.col("n_columns")), F.lit(0.0)))
    sure = lambda c: F.coalesce(c, F.lit(False))
    has_numbers = sure(F.col("named_number")) | sure(F.col("seen_number"))
    few, nulls = (F.col("n_rows") > 0) & (F.col("n_rows") < LEAST_ROWS), F.col("null_rate") > MOST_NULLS
    issues = F.concat_ws(
        "; ", F.when(F.col("n_rows") == 0, F.concat(F.lit("No parseable rows (format="), "format", F.lit(")."))), F.when(few, F.format_string(f"Only %d row(s); need at least {LEAST_ROWS}.", "n_rows")),
        F.when((F.col("n_rows") > 0) & (F.col("n_columns") == 0), "No columns detected."), F.when(nulls, F.format_string(f"Null rate %d%% exceeds {MOST_NULLS * 100:.0f}%% threshold.", F.round(F.col("null_rate") * 100).cast("int"))),
    )
    score = (F.least(F.col("n_rows") / ROWS, F.lit(1.0)) + F.when(F.col("n_rows") > 0, 1 - F.col("null_rate")).otherwise(0.0) + F.least(F.coalesce("votes", F.lit(0.0)), F.lit(1.0)) + has_numbers.cast("int")) / 4
    return done.select(
        "id", "format", "n_rows", "n_columns", "null_rate", F.when(F.col("votes") >= 0.5, F.col("voted")).alias("time_column"), sure(F.col("has_times")).alias("has_times"), has_numbers.alias("has_numbers"), score.alias("score"),
        (issues == "").alias("passed"), issues.alias("issues"), F.coalesce("columns", F.lit("")).alias("columns"),
    )


def sampled(registry: DataFrame, raw: DataFrame, key: str = "id") -> DataFrame:
    """The registry (key, status, ...) after a sample of each of its sources at ``sampled`` that has a body in ``raw`` (id, body): those that pass become validated.

    ``action`` is validated, failed, or null for sources that were not sampled; ``note`` says what was seen.
    The share of missing cells is rounded as numbers are printed in C: what stands exactly between two goes to the even one.
    """
    found = registry.where("status = 'sampled'").join(quality(rows_of(raw)).withColumnRenamed("id", key), key)
    told = found.select(key, F.when(F.col("passed"), "validated").otherwise("failed").alias("action"), F.concat_ws(" | ", F.concat(F.lit("rows="), "n_rows"), F.concat(F.lit("cols="), "n_columns"), F.concat(F.lit("null_rate="), F.format_number(F.col("null_rate") * 100, 1), F.lit("%")), F.concat(F.lit("format="), "format"), F.when(F.col("issues") != "", F.concat(F.lit("issues="), "issues"))).alias("note"))
    moved = transitioned(registry, told.where("action = 'validated'").select(key, F.lit("validated").alias("new_status")), key).drop("accepted")
    return moved.join(told, key, "left")
