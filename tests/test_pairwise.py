"""Measures of pairs against plain versions and known values, and that blocks meet each pair once."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import pairwise as pw

DAY = dt.date(2024, 1, 1)
small = st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=0, max_size=40)


def plain_kendall(x, y):
    n = len(x)
    s = lambda a: int(a > 0) - int(a < 0)
    pairs = [(s(x[i] - x[j]), s(y[i] - y[j])) for i in range(n) for j in range(i)]
    nx, ny = sum(a != 0 for a, _ in pairs), sum(b != 0 for _, b in pairs)
    return sum(a * b for a, b in pairs) / math.sqrt(nx * ny) if nx and ny else None


def plain_information(x, y, k):
    """All distances, and digamma by its recurrence and series."""

    def psi(z):
        low, z = 0.0, float(z)
        while z < 10:
            low, z = low - 1 / z, z + 1
        return low + math.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)

    x, y = ((v - np.mean(v)) / np.std(v) for v in (np.array(x, float), np.array(y, float)))
    total = 0.0
    for i in range(len(x)):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        r = sorted(np.delete(np.maximum(dx, dy), i))[k - 1] * (1 - 1e-9)
        total += psi((dx <= r).sum()) + psi((dy <= r).sum())
    return max(0.0, psi(len(x)) + psi(k) - total / len(x))


@settings(max_examples=200, deadline=None)
@given(small)
def test_kendall_equals_pair_counting(points):
    x, y = (np.array([p[i] for p in points], float) for i in (0, 1))
    want = plain_kendall(x, y)
    assert pw.kendall(x, y) == (None if want is None else pytest.approx(want, abs=1e-12))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=70))
def test_inversions(y):
    assert pw.inversions(np.array(y, np.int64)) == sum(a > b for i, b in enumerate(y) for a in y[:i])


def test_kendall_of_many_points_is_quick():
    rng = np.random.default_rng(1)
    x = rng.normal(size=200_000)
    assert pw.kendall(x, x) == 1 and pw.kendall(x, -x) == -1
    assert abs(pw.kendall(x, rng.normal(size=200_000))) < 0.01


@settings(max_examples=100, deadline=None)
@given(small, st.integers(1, 4))
def test_information_equals_all_distances(points, k):
    x, y = (np.array([p[i] for p in points], float) for i in (0, 1))
    got = pw.neighbour_information(x, y, k)
    if len(x) <= k or len(set(x)) < 2 or len(set(y)) < 2:
        assert got is None
    else:
        assert got == pytest.approx(plain_information(x, y, k), abs=1e-9)


@pytest.mark.parametrize("rho", [0.0, 0.3, 0.6, 0.9, -0.8])
def test_information_of_gaussians_is_known(rho):
    rng = np.random.default_rng(7)
    x, e = rng.normal(size=(2, 4000))
    y = 50 + 3 * (rho * x + math.sqrt(1 - rho**2) * e)
    got = pw.neighbour_information(1e-3 * x, y)
    assert got == pytest.approx(-0.5 * math.log(1 - rho**2), abs=0.05)
    assert got == pytest.approx(plain_information(x, y, 3), abs=1e-9)
    assert pw.neighbour_information(x, x**2) > 1  # no linear relation, all the same


def series(spark, n_assets=7, n=90):
    rng = np.random.default_rng(3)
    rows = []
    for a in range(n_assets):
        kept = np.sort(rng.permutation(n)[: n - 3 * a])  # different days
        rows += [(f"s{a}", DAY + dt.timedelta(int(i)), float(np.round(rng.normal(), 1))) for i in kept]
    rows += [("flat", DAY + dt.timedelta(i), 1.0) for i in range(n)] + [("s0", DAY + dt.timedelta(500), None), ("s1", DAY + dt.timedelta(501), math.nan), ("none", DAY, None)]
    return rows, spark.createDataFrame(rows, "asset string, ts date, ret double")


@pytest.mark.parametrize("size", [1, 3, 32])
def test_each_pair_meets_once_on_its_common_days(spark, size):
    rows, df = series(spark)
    values = {}
    for a, t, v in rows:
        if v is not None and not math.isnan(v):
            values.setdefault(a, {})[t] = v
    got = {(r.a, r.b): r for r in pw.rank_matrix(df, size=size).collect()}
    assert set(got) == {(a, b) for a in values for b in values if a < b}
    assert pw.rank_matrix(df, size=size).count() == len(got)
    for (a, b), r in got.items():
        days = sorted(values[a].keys() & values[b].keys())
        x, y = ([values[k][t] for t in days] for k in (a, b))
        assert r.n == len(days)
        want = plain_kendall(x, y)
        assert r.kendall == (None if want is None else pytest.approx(want))
        assert (r.pearson is None) == (r.spearman is None) == ("flat" in (a, b))
        if "flat" not in (a, b):
            assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
    empty = df.limit(0)
    assert pw.rank_matrix(empty).count() == pw.information(empty).count() == 0


def test_information_over_all_pairs(spark):
    rows, df = series(spark)
    got = {(r.a, r.b): r.nats for r in pw.information(df, least_rows=70).collect()}
    assert ("s0", "s6") in got and got["flat", "s0"] is None
    values = {a: {t: v for b, t, v in rows if b == a} for a in ("s0", "s6")}
    days = sorted(t for t in values["s0"].keys() & values["s6"].keys())
    assert got["s0", "s6"] == pytest.approx(plain_information([values["s0"][t] for t in days], [values["s6"][t] for t in days], 3), abs=1e-9)
