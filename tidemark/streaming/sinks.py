"""Streams into tables: ticks with the value before them, and upserts that rewrite only the partitions they touch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import stored


def change(value: str, before: str) -> Column:
    """Change in percent on the value before; 0 without one, or on 0."""
    return F.coalesce(F.round(F.try_divide(F.col(value) - F.col(before), F.col(before)) * 100, 4), F.lit(0.0))


def ticks(events: DataFrame) -> DataFrame:
    """Every event (event_type, event_id, ts, value) of a stream with ``before``, the value that its type had before it.

    The state of a type is its last value and time. Events of a micro-batch count in order of (ts, event_id); one that is not later than the
    last of an earlier batch is late: it gets that batch's last as ``before``, and does not take its place. An event without a value has no
    part in it.
    """
    out = f"event_type {events.schema['event_type'].dataType.simpleString()}, event_id long, ts timestamp, value double, before double"

    def follow(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, at, by = state.get if state.exists else (None, pd.Timestamp.min, -1)
        at = pd.Timestamp(at)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        before = []
        for ts, number, value in zip(rows["ts"], rows["event_id"], rows["value"]):
            before.append(last)
            if (ts, number) > (at, by):
                last, at, by = float(value), ts, int(number)
        state.update((last, at.to_pydatetime(), by))
        rows["before"] = pd.array(before, "Float64")
        yield rows[["event_type", "event_id", "ts", "value", "before"]]

    found = events.where("value is not null").select("event_type", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return found.groupBy("event_type").applyInPandasWithState(follow, out, "last double, at timestamp, event_id long", "append", "NoTimeout")


def ticks_of(events: DataFrame) -> DataFrame:
    """The same of a table: within a day by a window of the day, on a day's first event from the last of an earlier day, so that no window holds more than a type's day."""
    order = ["ts", "event_id"]
    rows = events.where("value is not null").withColumn("day", F.to_date("ts"))
    own = Window.partitionBy("event_type", "day").orderBy(*order)
    lasts = rows.groupBy("event_type", "day").agg(F.max_by("value", F.struct(*order)).alias("last"))
    lasts = lasts.select("event_type", "day", F.lag("last").over(Window.partitionBy("event_type").orderBy("day")).alias("carried"))
    found = rows.withColumns({"_b": F.lag("value").over(own), "_i": F.row_number().over(own)}).join(lasts, ["event_type", "day"])
    return found.select("event_type", "event_id", "ts", "value", F.when(F.col("_i") == 1, F.col("carried")).otherwise(F.col("_b")).alias("before"))


def bucket(key: str, n: int) -> Column:
    """A partition for a table that is kept by ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row of the greatest ``order``; of equal ones the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("r")).select(*keys, "r.*").select(rows.columns)


def upsert_partitions(rows: DataFrame, path: str, keys: list[str], order: list[str], partition: str) -> None:
    """Merge ``rows`` into the table at ``path``: of each key the latest row stays. Only partitions that ``rows`` has are read and written; the files of all others stay.

    ``partition`` is one of the keys or a function of them (``bucket``), so that a key never changes its partition; it may not be null. The new
    rows are written beside the table first: a source that cannot be read twice is read once. Merging the
    same rows again changes nothing.
    """
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}/_new"
    rows.write.mode("overwrite").parquet(beside)
    new = spark.read.schema(rows.schema).parquet(beside)
    old = stored(spark, path) if _tables(spark, path) else None
    if old is not None:
        touched = new.select(partition).distinct()
        new = new.unionByName(old.select(new.columns).join(F.broadcast(touched), partition, "left_semi"))  # one row a partition
    merged = latest(new, keys, order)
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _file(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _tables(spark: SparkSession, path: str) -> bool:
    """Whether there is a partition under ``path``."""
    found, fs = _file(spark, path)
    return fs.exists(found) and any("=" in f.getPath().getName() for f in fs.listStatus(found))


def upserting(path: str, keys: list[str], order: list[str], partition: str, writer: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges each micro-batch once.

    A batch that is done leaves a mark of ``writer`` (one name for each stream and checkpoint) and its number, and is skipped when the
    stream gives it again after a restart. A batch that was cut short has no mark and is merged again, with the same outcome.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark, fs = _file(spark, f"{path.rstrip('/')}/_done/{writer}/{number}")
        if fs.exists(mark):
            batch.write.format("noop").mode("overwrite").save()  # a batch with state is to be read in any case
        else:
            upsert_partitions(batch, path, keys, order, partition)
            fs.create(mark, True).close()

    return put
