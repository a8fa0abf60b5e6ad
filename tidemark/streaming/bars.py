"""Streaming bars: tumbling OHLCV with a watermark, the last value of each key, and online anomalies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(events: DataFrame, every: str = "1 day") -> DataFrame:
    """(event_type, start, open, high, low, close, volume, n) of event time windows; works on batches and streams."""
    order = F.struct("ts", "event_id")
    found = events.groupBy("event_type", F.window("ts", every).alias("w")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.round(F.sum("value"), 4).alias("volume"), F.count("*").alias("n"))
    return found.select("event_type", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def stream_bars(events: DataFrame, late: str = "3 days", every: str = "1 day") -> DataFrame:
    """The same over a stream; events later than ``late`` are not counted."""
    return bucketed(events.withWatermark("ts", late), every)


def last_values(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Last value of each key and its change on the first; a stream runs it in update or complete mode."""
    order = F.struct("ts", "event_id")
    found = events.groupBy(key).agg(F.max_by("value", order).alias("last"), F.min_by("value", order).alias("first"), F.max("ts").alias("ts"))
    return found.withColumn("change_pct", F.round(F.try_divide(F.col("last") - F.col("first"), "first") * 100, 4))


ODD = "event_type string, ts timestamp, value double, z double, seen long"


def online_anomalies(events: DataFrame, window: int = 252, least: int = 20, threshold: float = 3.0) -> DataFrame:
    """Events (event_type, ts, event_id, value) of a stream whose z among the last ``window`` of their type, themselves included, is beyond ``threshold``.

    The state of a type is its last values, at most ``window`` of them. Events of a batch count in order of time;
    those that come late count when they come.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        found = []
        for ts, value in zip(rows["ts"], rows["value"]):
            past = [*past, float(value)][-window:]
            mean = sum(past) / len(past)
            sd = (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5
            if len(past) >= least and sd > 0 and abs((value - mean) / sd) > threshold:
                found.append((key[0], ts, float(value), (value - mean) / sd, len(past)))
        state.update((past,))
        yield pd.DataFrame(found, columns=["event_type", "ts", "value", "z", "seen"])

    return events.groupBy("event_type").applyInPandasWithState(judge, ODD, "past array<double>", "append", "NoTimeout")
