"""Every query with SQL gives the rows that the SQL gives."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(value):
    if isinstance(value, (list, dict)) or not pd.isna(value):
        if isinstance(value, float):
            return round(value, 5) + 0.0
        return str(value)[:19].replace(" 00:00:00", "")
    return None


def rows(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=3e-5))


@pytest.mark.parametrize("name", sorted(n for n, (_, text) in entry.CORE.items() if text))
def test_rows_equal_sql(spark, sql, name):
    query, text = entry.CORE[name]
    got, want = query(spark, DIR).toPandas(), sql.sql(text).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for c in columns:  # an integer column with nulls is a float in pandas
        if got[c].dtype != want[c].dtype and "float64" in (got[c].dtype, want[c].dtype):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b) > 0
    assert [(x, y) for x, y in zip(a, b) if not all(map(close, x, y))] == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6
