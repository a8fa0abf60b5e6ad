"""Edge cases of the expanded features, suites, filters, searches and streams on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, baseline, expanded, filters, intelligence, relations, scores, suite, validation, vectors
from tidemark.sources import payloads
from tidemark.streaming.bars import online_anomalies

DAY = dt.date(2024, 1, 1)


def prices(spark, closes, asset="A"):
    rows = [(asset, DAY + dt.timedelta(i), c, c + 1.0, c - 1.0, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "asset string, ts date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("group", sorted(expanded.GROUPS))
def test_groups_of_empty_and_single_bars(spark, group):
    make = expanded.GROUPS[group]
    for bars in (prices(spark, [1.0]).limit(0), prices(spark, [1.0])):
        bars = expanded.volatility(bars) if group == "volatility_regime" else bars
        assert make(bars).count() == bars.count()


def test_constant_prices_have_no_ratios(spark):
    bars = prices(spark, [5.0] * 30).withColumns({"high": F.col("close"), "low": F.col("close")})
    last = bars.transform(expanded.bands).transform(expanded.volume).transform(expanded.momentum).orderBy(F.desc("ts")).first()
    assert last.bb_pct is None and last.stoch_k is None and last.ad_line is None and last.rsi_14 is None and last.ret_21d == 0.0


def test_crossings_are_changes_of_sign(spark):
    got = prices(spark, [1.0, -1.0, 0.0, 2.0]).select("ts", expanded.sign_change(F.col("close")).alias("x")).orderBy("ts").collect()
    assert [r.x for r in got] == [0.0, -2.0, 1.0, 1.0]


def test_sequences_stop_before_the_end(spark):
    got = expanded.sequences(prices(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), ["close"], 2).orderBy("ts").collect()
    assert [([x[0] for x in r.steps], r.target) for r in got] == [([1.0, 2.0], 3.0), ([2.0, 3.0], 4.0)]


def test_weekend_levels_count_on_friday(spark):
    rows = [("s", dt.date(2024, 1, 5), 1.0), ("s", dt.date(2024, 1, 7), 3.0), ("s", dt.date(2024, 1, 9), 4.0)]
    got = expanded.scaled_levels(spark.createDataFrame(rows, "indicator string, ts date, value double")).orderBy("ts").collect()
    assert [r.ts for r in got] == [dt.date(2024, 1, 8), dt.date(2024, 1, 9)] and got[0].value == 0.0


def test_earnings_without_dates(spark):
    row = expanded.earnings(prices(spark, [1.0]), []).first()
    assert row.earnings_days_until is None and row.within_earnings_window == 0


def test_leads_are_recovered(spark):
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(300)]
    rows = [("lead", DAY + dt.timedelta(i), v) for i, v in enumerate(x)] + [("late", DAY + dt.timedelta(i), x[i - 3] + 0.01 * rng.gauss(0, 1)) for i in range(3, 300)]
    series = spark.createDataFrame(rows, "asset string, ts date, ret double")
    assert relations.leading(series, "late").first().lag_days == 3
    best = relations.lag_sweep(series).first()
    assert {best.a, best.b} == {"late", "lead"} and abs(best.lag) == 3 and best.leader == "lead"


@pytest.mark.parametrize("t, n, p", [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (12.706, 1, 0.05000080), (1.96, 10000, 0.05002197), (-3.0, 60, 0.00392770)])
def test_t_tail(spark, t, n, p):
    got = spark.createDataFrame([(t, n)], "t double, n int").select(baseline.t_tail(F.col("t"), F.col("n")).alias("p")).first().p
    assert math.isclose(got, p, rel_tol=1e-4)


def test_suite_of_awkward_tables(spark):
    schema = "k string, ts date, close string, at int"
    rows = [("a", DAY, "1", 1), ("a", DAY, "1", 1), ("a", None, None, 3), ("a", DAY - dt.timedelta(1), "x", 4), ("a", DAY, "-5", 5)]
    checks = suite.time_series(spark.createDataFrame(rows, schema), "k", "ts", "2024-01-02", arrival="at", required=("close", "gone"), expected=("k", "ts", "close", "at"), keys=("close",), ranges={"close": (0.0, None), "gone": (0.0, None)}, min_rows=3)
    got = {r.check: (r.passed, r.detail) for r in checks.collect()}
    assert got["required_columns"] == (False, 1.0) and got["schema_drift"] == (True, 0.0) and got["duplicate_rows"] == (False, 1.0) and got["duplicate_timestamps"] == (False, 2.0)
    assert got["null_rate"] == (False, 0.2) and got["monotonic_timestamps"] == (True, 0.0) and "numeric_range_gone" not in got and math.isclose(got["numeric_range_close"][1], 1 / 3)
    verdict = suite.verdict(checks, "k").first()
    assert not verdict.passed and verdict.errors == 4 and verdict.warnings == 1
    assert suite.time_series(spark.createDataFrame([], schema), "k", "ts", "2024-01-02").count() == 0


def test_filters_and_nulls(spark):
    rows = spark.createDataFrame([(1, "Ab", None, ["x"]), (2, None, 5.0, None), (3, "cd", 9.0, ["x", "y"])], "id int, name string, rsi double, tags array<string>")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(filters.matching(rows, within={"rsi": (0.0, 6.0)})) == [1, 2]
    assert ids(filters.matching(rows, holds={"tags": "x"}, search=("B", ("name",)))) == [1]
    assert ids(filters.matching(rows, {"name": None})) == [1, 2, 3]
    assert ids(filters.ordered(rows, "rsi")) == [3, 2, 1] and ids(filters.ordered(rows, "rsi", descending=False)) == [2, 3, 1]


def test_first_reason_wins(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    reasons = [spark.createDataFrame([(1, "price")], "k int, reason string"), spark.createDataFrame([(1, "spike"), (2, "spike")], "k int, reason string")]
    assert {r.k: r.reason for r in suite.filtered(rows, reasons, ["k"]).collect()} == {1: "price", 2: "spike", 3: None}


def test_not_numbers(spark):
    rows = spark.createDataFrame([(1.23456789,), (float("nan"),), (float("inf"),), (None,)], "x double")
    got = [(r.a, r.b) for r in rows.select(scores.finite(F.col("x")).alias("a"), scores.finite_or_zero(F.col("x")).alias("b")).collect()]
    assert got == [(1.234568, 1.23456789), (None, 0.0), (None, 0.0), (None, 0.0)]


def test_edges_of_discoveries(spark):
    found = spark.createDataFrame([("z", "b", "discovered", 0.01, 0.9, "strong"), ("z", "b", "rate_sensitive", None, 0.9, None)], "a string, b string, relationship_type string, granger_p double, pearson_r double, strength string")
    found = found.withColumns({c: F.lit(None).cast("double") for c in ("mutual_info", "beta", "t_stat", "p_value", "r_squared")})
    got = {(r.rel_type, r.src, r.dst) for r in intelligence.discovery_edges(found).collect()}
    assert got == {("CORRELATED_WITH", "b", "z"), ("CAUSES", "z", "b"), ("SENSITIVE_TO", "z", "b")}


def test_auc_of_ties_and_one_class(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert validation.auc(rows).first().auc == 0.875 and validation.auc(rows.where("label = 1")).first().auc == 0.5
    assert validation.auc_by_thresholds(rows.where("label = 1")).first().auc == 0.5


def test_report_of_an_open_trade(spark):
    p = prices(spark, [1.0, 2.0, 3.0, 4.0])
    got = backtest.report(p, p.select("asset", "ts", (F.col("close") >= 2).cast("int").alias("score"))).first()
    assert got.total_trades == 1 and got.win_rate_pct == 0.0 and got.avg_trade_pct == 0.0


def test_vector_sizes_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert vectors.checked(rows, 2).count() == 1
    with pytest.raises(Exception, match="of 3 numbers"):
        vectors.checked(rows, 3).collect()


def test_bodies_that_are_no_data(spark):
    raw = spark.createDataFrame([("a", ""), ("b", None), ("c", "KEY,OTHER\n1,2"), ("d", "TIME_PERIOD,OBS_VALUE\n2020-Q3,1\n2021,2\nx,3\n2020-13,4")], "indicator string, body string")
    assert [(r.indicator, str(r.ts), r.value) for r in payloads.sdmx(raw).orderBy("ts").collect()] == [("d", "2020-07-01", 1.0), ("d", "2021-01-01", 2.0)]
    assert {r.format for r in payloads.sniffed(raw.withColumnRenamed("indicator", "id").where("id < 'c'")).collect()} == {"unknown"}


def test_online_anomalies_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, 100.0 if i in (70, 150) else rng.gauss(0, 1)) for k in ("a", "b") for i in range(200)]
    events = spark.createDataFrame(rows, "event_type string, ts timestamp, event_id long, value double")
    for part in range(2):
        events.where((F.col("event_id") >= 100 * part) & (F.col("event_id") < 100 * (part + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = online_anomalies(stream, window=50).writeStream.format("memory").queryName("odd").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    out.processAllAvailable()
    out.stop()
    got = {(r.event_type, r.ts) for r in spark.table("odd").collect()}
    batch = intelligence.rolling_anomalies(events.withColumnRenamed("event_type", "node"), window=50)
    assert got == {(r.node, r.ts) for r in batch.collect()} and len(got) >= 4


def test_quarantine_is_restored(spark, tmp_path):
    from tidemark.sources import sinks

    bad = spark.createDataFrame([(1, "x", "late"), (2, None, "late")], "id int, name string, reason string")
    for entry in ("e1", "e2"):
        sinks.quarantine(bad, str(tmp_path / "q"), entry, "s", "2024-01-01")
    entries = spark.read.parquet(str(tmp_path / "q"))
    assert [tuple(r) for r in sinks.restored(entries, "e1", "id int, name string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert len(list((tmp_path / "q").glob("day=*"))) == 1
