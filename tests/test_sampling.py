"""Samples: types merged over rows, the time column, quality, and moves in the registry."""

import pytest

from tidemark.operators import sampling

BODIES = {
    1: '[{"date": "2024-01-01", "value": 1, "note": null}, {"date": "2024-01-02", "value": 2.5, "extra": "x"}]',
    2: '{"meta": {"a": 1}, "data": [{"period": "2024-01-01T10:00:00", "n": 1}, {"period": "2024-01-02", "n": 2}, {"period": "", "n": 3}]}',
    3: '{"a": true, "b": "x"}\n{"a": "false", "b": 3}\n',
    4: "when,price\n2024-01-01,\n2024-01-02,7\n2024-01-03,\n,\n,\n",
    5: "", 6: "no table at all", 7: '[{"x": 1}]', 8: None, 9: '[{"b": null, "a": null}, {"b": ""}]', 10: "[" + ", ".join('{"v": %d}' % i for i in range(80)) + "]",
}


@pytest.fixture(scope="module")
def rows(spark):
    return sampling.rows_of(spark.createDataFrame(list(BODIES.items()), "id int, body string"))


def test_types_merge_over_rows(rows):
    got = {(r.id, r.name): (r.n_filled, r.type, r.votes) for r in sampling.columns_of(rows).collect()}
    assert got[1, "date"] == (2, "date", 2.0) and got[1, "value"] == (2, "double", 0.0) and got[1, "note"] == (0, None, 0.0) and got[1, "extra"] == (1, "string", 0.0)
    assert got[2, "period"] == (2, "timestamp", 2.0) and got[2, "n"] == (3, "bigint", 0.0)
    assert got[3, "a"] == (2, "boolean", 0.0) and got[3, "b"] == (2, "string", 0.0)
    assert got[4, "when"] == (3, "date", 1.0) and got[4, "price"] == (1, "bigint", 0.0)


def test_variants_merge_over_rows(rows):
    got = {r.id: r.schema for r in sampling.variant_schemas(rows).collect()}
    assert got[1].startswith("OBJECT<date: STRING, extra: STRING, note: ") and "value: DECIMAL" in got[1]
    assert got[2] == "OBJECT<n: BIGINT, period: STRING>" and got[3] == "OBJECT<a: BOOLEAN, b: VARIANT>"
    assert got[10] == "OBJECT<v: BIGINT>"


def test_quality(rows):
    got = {r.id: r for r in sampling.quality(rows).collect()}
    assert {i: (r.format, r.n_rows, r.n_columns, r.time_column, r.passed) for i, r in got.items()} == {
        1: ("json", 2, 4, "date", True), 2: ("json_object", 3, 2, "period", True), 3: ("ndjson", 2, 2, None, True), 4: ("csv", 5, 2, "when", False), 5: ("unknown", 0, 0, None, False), 6: ("unknown", 0, 0, None, False),
        7: ("json", 1, 1, None, False), 8: ("unknown", 0, 0, None, False), 9: ("json", 2, 2, None, False), 10: ("json", 50, 1, None, True),
    }
    assert got[4].null_rate == pytest.approx(0.6) and got[4].issues == "Null rate 60% exceeds 50% threshold."
    assert got[5].issues == "No parseable rows (format=unknown)." and got[7].issues == "Only 1 row(s); need at least 2."
    assert got[1].null_rate == pytest.approx(3 / 8) and got[1].has_times and got[1].has_numbers and got[3].has_numbers
    assert not got[9].has_numbers and not got[10].has_times and got[4].has_numbers
    assert got[10].score == pytest.approx((1 + 1 + 0 + 1) / 4) and got[2].score == pytest.approx((3 / 50 + 5 / 6 + 1 + 1) / 4) and got[5].score == 0
    assert got[1].columns == "date date, extra string, note null, value double"


def test_samples_move_sources(spark):
    raw = spark.createDataFrame(list(BODIES.items()), "id int, body string")
    registry = spark.createDataFrame([(1, "sampled"), (2, "discovered"), (4, "sampled"), (5, "sampled"), (77, "sampled"), (3, "approved")], "id int, status string")
    got = {r.id: (r.status, r.action) for r in sampling.sampled(registry, raw).collect()}
    assert got == {1: ("validated", "validated"), 2: ("discovered", None), 4: ("sampled", "failed"), 5: ("sampled", "failed"), 77: ("sampled", None), 3: ("approved", None)}
    assert sampling.sampled(registry.limit(0), raw).count() == 0 and sampling.quality(sampling.rows_of(raw.limit(0))).count() == 0


def test_shares_between_two_go_to_the_even_one(spark):
    """11 of 16 cells filled: 31.25 % is told as 31.2, as Python and SQL print it (it was 31.3)."""
    body = "[" + ", ".join('{"date": "2024-01-01"}' if i < 11 else '{"date": null}' for i in range(16)) + "]"
    registry = spark.createDataFrame([(1, "sampled")], "id int, status string")
    note = sampling.sampled(registry, spark.createDataFrame([(1, body)], "id int, body string")).first().note
    assert note == f"rows=16 | cols=1 | null_rate={5 / 16:.1%} | format=json" and "31.2%" in note
