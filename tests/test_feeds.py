"""Feeds: descriptions, checks by frequency, scores, facts, feeds of filings, profiles and runs."""

import datetime as dt
import json
import statistics

import pytest

from tidemark.sources import feeds
from tidemark.sources import payloads as feeds_payloads

DAY = dt.date(2024, 1, 1)
OBSERVED = "indicator string, ts date, value double"


def test_descriptions(spark):
    bodies = [json.dumps({"seriess": [{"id": "A", "title": "t", "units": "u", "frequency": "Monthly", "last_updated": "x"}, {"id": "B"}]}), json.dumps({"seriess": []}), "no json", None, "{}"]
    got = feeds.described(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [tuple(r) for r in got] == [("A", "t", "u", "monthly", "x")]


def test_series_are_written_whole_or_not_at_all(spark):
    rows = [("ok", DAY + dt.timedelta(i), 1.0) for i in range(12)] + [("few", DAY + dt.timedelta(i), 1.0) for i in range(9)] + [("event", DAY, 1.0), ("event", DAY + dt.timedelta(1), 2.0)]
    rows += [("twice", DAY + dt.timedelta(i), 1.0) for i in range(12)] + [("twice", DAY, 2.0)] + [("nulls", DAY, None)] + [("both", DAY, 1.0)] * 2
    series = [("ok", "daily"), ("few", "monthly"), ("event", "event"), ("twice", "weekly"), ("nulls", "daily"), ("none", "quarterly"), ("both", "daily")]
    got = {r.indicator: r for r in feeds.ingested(spark.createDataFrame(rows, OBSERVED), spark.createDataFrame(series, "indicator string, frequency string"), "2024-02-01").collect()}
    assert {i: (r.code, r.n_fetched, r.n_written, r.error, r.stale) for i, r in got.items()} == {
        "ok": ("d", 12, 12, None, True), "few": ("m", 9, 0, "1 checks failed", False), "event": (None, 2, 2, None, False), "twice": ("w", 13, 0, "1 checks failed", True), "nulls": ("d", 0, 0, "empty", None), "none": ("q", 0, 0, "empty", None),
        "both": ("d", 2, 0, "2 checks failed", True),
    }
    assert got["ok"].first == DAY and got["few"].first is None


def test_scores_wait_for_their_window(spark):
    values = {"long": [float(i * i % 17) for i in range(30)], "short": [1.0, 2.0, 4.0], "flat": [5.0] * 12, "one": [3.0]}
    rows = [(k, DAY + dt.timedelta(i), v) for k, vs in values.items() for i, v in enumerate(vs)]
    got = {(r.indicator, r.ts): r.z for r in feeds.scored(spark.createDataFrame(rows, OBSERVED), {"z": 10}).collect()}
    for k, vs in values.items():
        size = min(10, len(vs))
        for i, v in enumerate(vs):
            part = vs[i - size + 1 : i + 1] if i >= size - 1 else None
            if not part or len(part) < 2:
                assert got[k, DAY + dt.timedelta(i)] is None
            else:
                sd = statistics.stdev(part)
                assert got[k, DAY + dt.timedelta(i)] == pytest.approx((v - statistics.mean(part)) / sd if sd else 0.0, abs=6e-4)


def test_recent_observations_come_newest_first(spark):
    rows = [("a", DAY + dt.timedelta(i), float(i)) for i in range(10)] + [("a", DAY + dt.timedelta(20), None), ("b", DAY, 1.0)]
    got = feeds.recent(spark.createDataFrame(rows, OBSERVED), "2024-01-03", "2024-01-09", 3).collect()
    assert [(r.indicator, r.value) for r in got] == [("a", 8.0), ("a", 7.0), ("a", 6.0)]


def test_company_facts_take_one_concept_unit_and_filing(spark):
    rows = [
        ("s", "Revenues", "USD", "2020", 1.0, "10-K", "f1"), ("s", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "2020", 2.0, "10-K", "f1"), ("s", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "2020", 3.0, "10-Q", "f2"),
        ("s", "RevenueFromContractWithCustomerExcludingAssessedTax", "pure", "2021", 9.0, "10-K", "f9"), ("t", "Revenues", "EUR", "2020", 1.0, "10-K", "f1"), ("t", "Revenues", "shares", "2020", 4.0, "10-K", "f1"), ("t", "Revenues", "shares", "2020", 5.0, "8-K", "f3"), ("t", "Other", "USD", "2020", 4.0, "10-K", "f1"),
        ("t", "Assets", "USD", None, 4.0, "10-K", "f1"), ("t", "Assets", "USD", "2020", None, "10-K", "f1"),
    ]
    got = feeds.company_facts(spark.createDataFrame(rows, "symbol string, concept string, unit string, end string, val double, form string, filed string")).collect()
    assert sorted(tuple(r) for r in got) == [("s", "revenue", "2020", 3.0, "f2", "10-Q"), ("t", "revenue", "2020", 4.0, "f1", "10-K")]


def test_filings_and_profiles(spark):
    entry = '<entry><category scheme="s" term="{}"/>\n<x/><updated>{}</updated><filing-href> {} </filing-href></entry>'
    body = "".join(entry.format(f"10-{k}", f"2024-0{k}-01T00:00", f"u{k}") for k in range(1, 5))
    raw = spark.createDataFrame([("a", body), ("b", "<feed/>"), ("c", None)], "symbol string, body string")
    filings = feeds.atom_filings(raw, 3)
    assert [(r.symbol, r.place, r.form, str(r.filed), r.url) for r in filings.orderBy("place").collect()] == [("a", k, f"10-{k}", f"2024-0{k}-01", f"u{k}") for k in (1, 2, 3)]
    stats = feeds.key_stats(spark.createDataFrame([("a", '{"marketCap": 5, "beta": "x", "fiftyTwoWeekLow": "1,200.5"}'), ("b", "no")], "symbol string, body string")).collect()
    assert len(stats[0]) == 25 and (stats[0]["market_cap"], stats[0]["beta"], stats[0]["52w_low"]) == (5.0, None, 1200.5) and stats[1]["market_cap"] is None
    made = {r.symbol: r.filings for r in feeds.profiles(raw, {"filings": filings}).collect()}
    assert [f.form for f in made["a"]] == ["10-1", "10-2", "10-3"] and made["b"] == made["c"] == []


def test_training_bars_lack_nothing(spark):
    at = dt.datetime(2024, 1, 1, 1)
    raw = spark.createDataFrame([(at, 1.0, 2.0), (at, None, 2.0), (at, float("nan"), 2.0), (None, 1.0, 2.0)], "Date timestamp, Open double, CLOSE double")
    (row,) = feeds_payloads.training_bars(raw, zone="+02:00").collect()
    assert row.asDict() == {"date": dt.date(2023, 12, 31), "open": 1.0, "close": 2.0}
    with pytest.raises(ValueError, match="case alone"):
        feeds_payloads.training_bars(raw.withColumnRenamed("CLOSE", "oPEN"))


def test_ciks_and_runs(spark):
    tickers = spark.createDataFrame([("aa",), ("BB",), ("zz",)], "symbol string")
    got = {r.symbol: r.cik for r in feeds.with_ciks(tickers, spark.createDataFrame([("AA", 12), ("aa", 11), ("bb", 7)], "ticker string, cik_str int")).collect()}
    assert got == {"aa": "0000000011", "BB": "0000000007", "zz": None}
    results = spark.createDataFrame([(5, None), (9, "bad"), (2, None)], "n_written int, error string")
    assert [tuple(r) for r in feeds.run_summary({"x": results, "y": results.limit(0)}).collect()] == [("x", 3, 1, 7), ("y", 0, 0, 0), ("total", 3, 1, 7)]
    names = spark.createDataFrame([(n,) for n in "dcba"], "name string")
    assert [tuple(r) for r in feeds.planned({"x": names, "y": names.limit(0)}, 2).collect()] == [("x", 4, "a, b"), ("y", 0, "")]
