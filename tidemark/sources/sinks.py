"""Writes: appends, keep-latest upserts, quarantine with its index, retention. All are plain Parquet under one folder a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import keep_latest


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Adds rows to a log: evolution entries, signals, health readings, discoveries, reports."""
    rows.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def health(readings: DataFrame) -> DataFrame:
    """Readings (metric, value, threshold) with ``flagged``: above the threshold; without one, not flagged."""
    return readings.withColumn("flagged", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of ``spark.checkpoint.dir``, which the whole cluster shares; a local session without one gets it in a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def upsert(rows: DataFrame, path: str, into: str, keys: list[str], order: list[str]) -> None:
    """Writes the table at ``path`` with ``rows`` merged by key to the folder ``into``, another one: readers keep the old until they switch."""
    old = stored(rows.sparkSession, path)
    merged = keep_latest(rows.limit(0) if old is None else old, rows, keys, order)
    merged.write.mode("errorifexists").parquet(into)


def quarantine(rows: DataFrame, path: str, entry_id: str, source: str, at: str) -> None:
    """Copies failed rows (with ``reason``) to the quarantine, one partition a day; nothing is deleted at their source."""
    append(rows.select(F.to_date(F.lit(at).cast("timestamp")).alias("day"), F.lit(entry_id).alias("entry_id"), F.lit(source).alias("source"), F.lit(at).cast("timestamp").alias("at"), "reason", F.to_json(F.struct([F.col(f"`{c}`") for c in rows.columns if c != "reason"])).alias("data")), path, ["day"])


def restored(entries: DataFrame, entry_id: str, schema: str) -> DataFrame:
    """The rows of one entry as they were."""
    return entries.where(F.col("entry_id") == entry_id).select(F.from_json("data", schema).alias("r")).select("r.*")


def quarantine_summary(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries (entry_id, source, reason) of each source and reason: rows, entries, and those not resolved (entry_id)."""
    marks = resolved.select("entry_id").distinct().withColumn("_done", F.lit(True))
    open_id = F.when(F.col("_done").isNull(), F.col("entry_id"))
    return entries.join(marks, "entry_id", "left").groupBy("source", "reason").agg(F.count("*").alias("n_rows"), F.count_distinct("entry_id").alias("n_entries"), F.count_distinct(open_id).alias("n_open"))


def retained(rows: DataFrame, column: str, as_of: str, years: int) -> DataFrame:
    """Rows not older than ``years`` years at ``as_of``; a row without a time stays."""
    return rows.where(F.coalesce(F.col(column) >= F.add_months(F.lit(as_of).cast("date"), -12 * years), F.lit(True)))
