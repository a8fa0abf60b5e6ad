"""Streams into tables: restarts give the table of one run, and only touched partitions are written."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import sinks

AT = dt.datetime(2024, 1, 1)
SCHEMA = "event_type string, event_id long, ts timestamp, value double"


def made():
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, AT + dt.timedelta(hours=5 * i, minutes=rng.randrange(200)), float(rng.randrange(1, 50))) for i in range(120)]
    return [*rows, ("a", 500, AT + dt.timedelta(hours=30), None), ("zero", 501, AT, 0.0), ("zero", 502, AT, 5.0)]


def plain(rows):
    last, out = {}, []
    for t, i, ts, v in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[2], r[1])):
        out.append((t, i, ts, v, last.get(t)))
        last[t] = v
    return sorted(out)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-") and "/_" not in d}


def test_ticks_of_a_table(spark):
    got = sinks.ticks_of(spark.createDataFrame(made(), SCHEMA).repartition(5)).collect()
    assert sorted((r.event_type, r.event_id, r.ts, r.value, r.before) for r in got) == plain(made())
    first = spark.createDataFrame([(1.0, None), (3.0, 2.0), (3.0, 0.0)], "value double, before double")
    assert [r.c for r in first.select(sinks.change("value", "before").alias("c")).collect()] == [0.0, 50.0, 0.0]


def run(spark, folder, put, name, per_batch=1):
    """Start, or start again, the stream of the files that are there, until it ends or fails."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = sinks.ticks(events).withColumn("day", F.to_date("ts"))
    query = found.writeStream.foreachBatch(put).queryName(name).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    try:
        query.awaitTermination(240)
    except Exception:
        return False
    return True


def test_a_stream_that_is_killed_and_restarted_gives_the_table_of_one_run(spark):
    folder, whole = tempfile.mkdtemp(prefix="spark-"), made()
    ordered = sorted(whole, key=lambda r: (r[2], r[1]))
    for i in range(0, len(ordered), 25):
        spark.createDataFrame(ordered[i : i + 25], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    calls, put = [], sinks.upserting(f"{folder}/table", ["event_type", "event_id", "day"], ["ts"], "day", "live")

    def failing(batch, number):
        """Batch 1 dies before its table is written, batch 3 after, without and with the mark."""
        calls.append(number)
        if calls.count(number) == 1 and number == 1:
            raise RuntimeError("killed")
        put(batch, number)
        if calls.count(number) == 1 and number == 2:
            os.remove(f"{folder}/table/_done/live/2")
        if calls.count(number) == 1 and number in (2, 3):
            raise RuntimeError("killed")

    ended = [run(spark, folder, failing, f"run{i}") for i in range(4)]
    assert ended == [False, False, False, True] and calls.count(1) == calls.count(2) == calls.count(3) == 2
    got = spark.read.parquet(f"{folder}/table").collect()
    assert sorted((r.event_type, r.event_id, r.ts, r.value, r.before) for r in got) == plain(whole)
    again = files(f"{folder}/table")
    put(spark.createDataFrame([("new", 999, AT, 1.0, None, AT.date())], SCHEMA + ", before double, day date"), 0)  # a batch that is done
    assert files(f"{folder}/table") == again


def test_late_events_do_not_become_the_last(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    batches = [[("a", 1, AT, 1.0), ("a", 2, AT + dt.timedelta(days=3), 2.0)], [("a", 3, AT + dt.timedelta(days=1), 9.0)], [("a", 4, AT + dt.timedelta(days=4), 4.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
    got = []
    assert run(spark, folder, lambda batch, _: got.extend(batch.collect()), "late")
    assert sorted((r.event_id, r.before) for r in got if r.event_id > 1) == [(2, 1.0), (3, 2.0), (4, 2.0)]


@pytest.mark.parametrize("partition", ["day", "part"])
def test_upserts_write_only_the_partitions_they_touch(spark, partition):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/table"
    schema, day = "key string, day date, at int, value double", AT.date()
    days = [day + dt.timedelta(i) for i in range(4)]
    keys = ["key", "day"] if partition == "day" else ["key"]

    def put(rows):
        frame = spark.createDataFrame(rows, schema)
        sinks.upsert_partitions(frame.withColumn("part", sinks.bucket("key", 5)), path, keys + (["part"] if partition == "part" else []), ["at"], partition)

    put([(f"k{i}", days[i % 4], 1, float(i)) for i in range(40)])
    before = files(path)
    new = [("k1", days[1], 2, 100.0), ("k5", days[1], 0, -1.0), ("k5", days[1], 0, -2.0), ("k900", days[1], 1, 5.0)]
    put(new)
    after = files(path)
    table = spark.read.parquet(path)
    touched = {str(r[0]) for r in table.where(F.col("key").isin("k1", "k5", "k900")).select(partition).distinct().collect()}
    kept = {f: t for f, t in before.items() if f.split(f"{partition}=")[1].split("/")[0] not in touched}
    assert kept and len(kept) < len(before) and all(after.get(f) == t for f, t in kept.items())
    got = {(r.key, r.day): r.value for r in table.collect()}
    want = {(f"k{i}", days[i % 4]): float(i) for i in range(40)} | {("k1", days[1]): 100.0, ("k900", days[1]): 5.0}
    assert got == want
    put(new)  # the same again
    assert {(r.key, r.day): r.value for r in spark.read.parquet(path).collect()} == want
