"""Registers as files, windows of events, tensors of windows, loadings, exposures."""

import datetime as dt
import json
import os
import tempfile

import numpy as np
import pytest

from tidemark.operators import records
from tidemark.sources import registries

DAY = dt.date(2024, 1, 15)


def test_registers_are_read_whole(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.json", "w") as f:
        json.dump([{"id": "x", "tags": ["a"], "more": 1}, {"id": "y"}], f, indent=1)
    with open(f"{folder}/b.json", "w") as f:
        json.dump({"id": "z", "tags": []}, f)
    got = sorted((r.id, r.tags) for r in registries.loaded(spark, folder, "id string, tags array<string>").collect())
    assert got == [("x", ["a"]), ("y", None), ("z", [])]
    with open(f"{folder}/keyed.txt", "w") as f:
        json.dump({"k1": {"status": "on"}, "k2": {}}, f)
    assert sorted(tuple(r) for r in registries.keyed(spark, f"{folder}/keyed.txt", "status string").collect()) == [("k1", "on"), ("k2", None)]
    with open(f"{folder}/bad.json", "w") as f:
        f.write("[{")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        registries.loaded(spark, f"{folder}/bad.json", "id string").collect()


def test_a_register_is_rewritten_as_a_whole(spark):
    folder, schema = tempfile.mkdtemp(prefix="spark-") + "/r", "id string, n int"
    assert registries.current(spark, folder, schema).collect() == []
    first = registries.rewritten(spark.createDataFrame([("a", 1), ("b", None)], schema), folder)
    old = registries.current(spark, folder, schema)
    second = registries.rewritten(old.where("id = 'b'").unionAll(spark.createDataFrame([("c", 3)], schema)), folder)
    assert first != second and sorted(tuple(r) for r in registries.current(spark, folder, schema).collect()) == [("b", None), ("c", 3)]
    assert sorted(tuple(r) for r in old.collect()) == [("a", 1), ("b", None)]  # a reader of the old version still has it
    os.makedirs(f"{folder}/v-half")  # a version that was not finished is not pointed to
    assert registries.current(spark, folder, schema).count() == 2


def test_events_in_a_window(spark):
    rows = [("a", DAY + dt.timedelta(d)) for d in (-8, -7, 0, 14, 15)] + [("b", DAY), ("a", None)]
    events = spark.createDataFrame(rows, "symbol string, date date")
    assert records.due(events, str(DAY)).count() == 4
    assert sorted((r.date - DAY).days for r in records.due(events, str(DAY), universe=spark.createDataFrame([("a",)], "symbol string")).collect()) == [-7, 0, 14]


def test_context_takes_the_latest_of_some_indicators(spark):
    rows = [("x", "i1", DAY, 1.0), ("x", "i1", DAY + dt.timedelta(1), 2.0), ("x", "i1", DAY + dt.timedelta(2), None), ("x", "i3", DAY, 5.0), ("y", "i2", DAY, 3.0)]
    values = spark.createDataFrame(rows, "country string, indicator string, ts date, value double")
    assert sorted((r.country, r.indicator, r.value) for r in records.context(values, ["i1", "i1", "i2", "i3"], 2).collect()) == [("x", "i1", 2.0), ("y", "i2", 3.0)]


def test_tensors_have_one_shape(spark):
    rows = [("A", DAY + dt.timedelta(i), float(i), None if i == 3 else 2.0) for i in range(6)] + [("B", DAY, 7.0, 8.0)]
    got = {r.asset: (r.n_real, r.tensor) for r in records.window_tensors(spark.createDataFrame(rows, "asset string, ts date, u double, v double").repartition(3), ["u", "v"], 4).collect()}
    assert got["A"] == (4, [[2.0, 2.0], [3.0, 0.0], [4.0, 2.0], [5.0, 2.0]]) and got["B"] == (1, [[0.0, 0.0]] * 3 + [[7.0, 8.0]])


def test_loadings_and_exposures(spark):
    rows = [(0, c, v) for c, v in (("a", 0.5), ("b", -0.7), ("c", 0.4), ("d", 0.0), ("e", -0.1), ("f", 0.5))]
    got = [(r.side, r.place, r["column"]) for r in records.top_loadings(spark.createDataFrame(rows, "component int, column string, loading double"), 2).orderBy("side", "place").collect()]
    assert got == [("down", 1, "b"), ("down", 2, "e"), ("up", 1, "a"), ("up", 2, "f")]
    rng = np.random.default_rng(0)
    level = np.cumsum(rng.normal(size=40))
    ret = 0.3 * np.diff(level) + 0.01 * rng.normal(size=39)
    days = [DAY + dt.timedelta(i) for i in range(40)]
    factors = spark.createDataFrame([("f", d, float(v)) for d, v in zip(days, level)], "factor string, ts date, value double")
    returns = spark.createDataFrame([("A", d, float(r)) for d, r in zip(days[1:], ret)] + [("B", days[1], 0.1)], "asset string, ts date, ret double")
    (row,) = records.factor_exposures(returns, factors).collect()
    assert (row.asset, row.n) == ("A", 39) and row.beta == pytest.approx(np.polyfit(np.diff(level), ret, 1)[0]) and row.r2 > 0.99
