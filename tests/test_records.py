"""Registers and records: matches, versions, logs, collections, claims as graphs, scaling, budgets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import records

DAY = dt.date(2024, 1, 1)


def test_candidates_are_known_by_id_or_address(spark):
    schema = "source_id string, url string"
    registry = spark.createDataFrame([("a", "HTTP://x/y/"), ("b", "http://x/y"), ("c", None), ("d", "http://z")], schema)
    candidates = spark.createDataFrame([("a", "other"), ("n1", "http://X/Y//"), ("n2", "http://q"), ("c", None), ("n3", None), ("d", "http://x/y")], schema)
    got = {r.source_id: (r.known_id, r.by) for r in records.matched(candidates, registry).collect()}
    assert got == {"a": ("a", "id"), "n1": ("a", "url"), "n2": (None, None), "c": ("c", "id"), "n3": (None, None), "d": ("d", "id")}


def test_experiments_are_compared_by_version(spark):
    rows = [(1, "m", 0.5, "v1", None, DAY), (2, "n", 0.7, "v2", "v1", DAY + dt.timedelta(1)), (3, "m", 0.7, "v1", "v1", DAY), (4, "m", None, None, None, DAY)]
    made = spark.createDataFrame(rows, "experiment_id int, model_type string, score double, dataset_version string, comparison_version string, created date")
    assert [r.experiment_id for r in records.comparable(made, "v1").collect()] == [2, 1, 3]
    got = {r.version: (r.n, r.n_models, r.best) for r in records.groups_of_versions(made).collect()}
    assert got == {"v1": (3, 2, 2), "v2": (1, 1, 2)}


def test_logs_and_collections(spark):
    log = spark.createDataFrame([(i, "a" if i % 2 else "b", "x", DAY + dt.timedelta(i)) for i in range(10)], "entry_id int, agent string, action string, created date")
    assert [r.entry_id for r in records.listed(log, "a", "x", 3).collect()] == [9, 7, 5] and records.listed(log, "a", "y").count() == 0
    points = spark.createDataFrame([("c", [1.0, 2.0]), ("c", [1.0]), ("c", [3.0, 4.0]), ("d", [1.0]), ("d", [1.0, 2.0, 3.0])], "collection string, vector array<double>")
    assert {r.collection: (r.n_points, r.dims, r.n_other) for r in records.collection_info(points).collect()} == {"c": (3, 2, 1), "d": (2, 3, 1)}


def test_claims_as_a_graph(spark):
    claims = spark.createDataFrame([(1, "source:a", "is", "domain:x", 0.5, "supported"), (2, "source:a", "is", "plain", 0.5, "odd"), (3, None, "is", "plain", 0.5, "weak")], "claim_id int, subject string, predicate string, object string, confidence double, status string")
    nodes, edges = records.claim_graph(claims, {"source": "Source", "domain": "Domain"})
    assert {r.node: (r.kind, r.label, r.n_claims) for r in nodes.collect()} == {"source:a": ("Source", "a", 2), "domain:x": ("Domain", "x", 1), "plain": ("unknown", "plain", 2)}
    assert {r.claim_id: (r.dst, r.status) for r in edges.collect()} == {1: ("domain:x", "active"), 2: ("plain", "proposed")}


def test_names_of_features():
    assert records.feature_names(["asset", "ts", "Open", "close", "rsi", "rsi", "macd"]) == ["rsi", "macd"]
    assert records.names_due(["a", "b"], ["b", "c"]) == {"missing": ["c"], "unexpected": ["a"]}


def test_a_series_on_another_calendar(spark):
    series = spark.createDataFrame([(DAY + dt.timedelta(i), v) for i, v in ((2, 1.0), (4, None), (5, 2.0))], "ts date, value double")
    calendar = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in (1, 3, 4, 5, 9, 9)], "ts date")
    got = [(r.ts.day, r.value, r.since and r.since.day) for r in records.reindexed(series, calendar).orderBy("ts").collect()]
    assert got == [(2, None, None), (4, 1.0, 3), (5, 1.0, 3), (6, 2.0, 6), (10, 2.0, 6)]


def test_scaling_gives_its_parameters(spark):
    rows = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0), (8.0, 5.0, 4.0)], "a double, b double, c double")
    scaled, found = records.normalised_with(rows, ["a", "b", "c"], "minmax")
    assert {r.name: (r.low, r.width) for r in found.collect()} == {"a": (1.0, 7.0), "b": (0.0, 1.0), "c": (2.0, 2.0)}
    assert [tuple(r) for r in scaled.collect()] == [(0.0, 5.0, None), (pytest.approx(2 / 7), 5.0, 0.0), (1.0, 5.0, 1.0)]
    other = spark.createDataFrame([(15.0, 1.0, 0.0)], "a double, b double, c double")
    assert tuple(records.scaled_by(other, found, ["a", "b", "c"]).first()) == (2.0, 1.0, -1.0)


def test_spread_and_parts(spark):
    rows = spark.createDataFrame([("x", 1.0, None), ("x", 3.0, 2), ("y", None, None)], "g string, a double, b int")
    got = {(r.g, r.metric): (r.n, r.low, r.high, r.total, r.mean, r.n_null) for r in records.spread_of(rows, ["g"], ["a", "b"]).collect()}
    assert got["x", "a"] == (2, 1.0, 3.0, 4.0, 2.0, 0) and got["x", "b"] == (1, 2.0, 2.0, 2.0, 2.0, 1) and got["y", "a"] == (0, None, None, None, None, 1)
    made = spark.createDataFrame([("A", DAY + dt.timedelta(i)) for i in range(20)], "asset string, ts date")
    assert [r.part for r in records.sequences_split(made).orderBy("ts").collect()] == ["train"] * 14 + ["val"] * 3 + ["test"] * 3


@pytest.mark.parametrize("most", [1, 3, 7, 10, 99])
def test_pairs_in_a_budget(spark, most):
    names = spark.createDataFrame([(n,) for n in "cabedab"], "name string")
    want = [(a, b) for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]][:most]
    assert [(r.a, r.b) for r in records.capped_pairs(names, most).orderBy("k").collect()] == want


def test_moods(spark):
    texts = ["Record earnings beat; GROWTH", "recorded beating", "missed guidance and a loss", None, "", "risk, profit"]
    got = [(r.m.score, r.m.label, r.m.rising, r.m.falling) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(records.mood("text").alias("m")).collect()]
    assert got[0] == (1.0, "bullish", 4, 0) and got[1] == (0.0, "neutral", 0, 0) and got[2] == (-1.0, "bearish", 0, 2) and got[3][0] == 0.0 and got[5] == (0.0, "neutral", 1, 1)
    assert len(records.RISING) == 32 and len(records.FALLING) == 31 and F
