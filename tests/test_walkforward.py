"""Walk-forward fits against plain numpy, failed folds, and that nothing of test rows reaches a fit."""

import datetime as dt
import math

import numpy as np
import pytest

from tidemark.operators import baseline, validation, walkforward
from tidemark.operators.walkforward import Model

DAY = dt.date(2024, 1, 1)


def made(seed, n, constant=False):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=n), rng.normal(5, 3, size=n)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    y = (u + 0.3 * (v - 5) + rng.normal(size=n) > 0).astype(int) if not constant else np.ones(n, int)
    return u, v, close, y


SERIES = {"A": made(1, 300), "B": made(2, 210), "C|x": made(3, 250, constant=True), "D": made(4, 40)}
MODELS = [Model("both", ("u", "v")), Model("u", ("u",), c=0.01), Model("flat", ("k", "v"), balanced=False)]


@pytest.fixture(scope="module")
def series(spark):
    rows = [(a, DAY + dt.timedelta(i), float(close[i]), int(y[i]), float(u[i]), float(v[i]), 7.0) for a, (u, v, close, y) in SERIES.items() for i in range(len(y))]
    rows += [("A", DAY - dt.timedelta(1), 100.0, 1, None, 1.0, 7.0), ("A", DAY - dt.timedelta(2), 100.0, 1, math.nan, 1.0, 7.0)]
    return spark.createDataFrame(rows, "asset string, ts date, close double, label int, u double, v double, k double").repartition(5)


def descended(x, y, c, balanced):
    """Plain gradient descent to the least loss."""
    n = len(y)
    w8 = np.array([n / (2 * y.sum()) if k else n / (2 * (n - y.sum())) for k in y]) if balanced else np.ones(n)
    d, w = np.column_stack([x, np.ones(n)]), np.zeros(x.shape[1] + 1)
    rate = 1 / (1 + c * 0.25 * np.linalg.norm(d * np.sqrt(w8)[:, None], 2) ** 2)
    for _ in range(40000):
        w = w - rate * (np.append(w[:-1], 0) + c * d.T @ (w8 * (1 / (1 + np.exp(-d @ w)) - y)))
    return w


def test_fits_equal_plain_ones(series):
    got = walkforward.fits(series, MODELS, n_folds=3, min_train=100, gap=2).collect()
    assert {(r.asset, r.model) for r in got} == {(a, m.name) for a in ("A", "B", "C|x") for m in MODELS}  # D is too short for any fold
    ok = [r for r in got if r.status == "ok"]
    assert {r.status for r in got if r.asset == "C|x"} == {"one class in train"} and all(r.scored is None for r in got if r.asset == "C|x")
    assert len(ok) == sum(r.asset != "C|x" for r in got) >= 12
    for r in ok:
        u, v, close, y = SERIES[r.asset]
        size = (len(y) - 100) // 3
        end = 100 + r.fold * size
        n_val = max(int(end * 0.15), 1)
        assert (r.n_train, r.n_val, r.n_test) == (end - n_val, n_val, size)
        m = next(m for m in MODELS if m.name == r.model)
        x = np.column_stack([{"u": u, "v": v, "k": np.full(len(u), 7.0)}[c] for c in m.columns])
        train, test = slice(0, end - n_val), slice(end + 2, end + 2 + size)
        sd = np.where(x[train].std(0) > 0, x[train].std(0), 1)
        z = (x - x[train].mean(0)) / sd
        want = descended(z[train], y[train], m.c, m.balanced)
        assert np.allclose([*r.weights, r.intercept], want, atol=1e-6)
        assert [s.ts for s in r.scored] == [DAY + dt.timedelta(i) for i in range(test.start, test.stop)]
        assert np.allclose([s.score for s in r.scored], 1 / (1 + np.exp(-(z[test] @ want[:-1] + want[-1]))), atol=1e-6)
        assert [s.label for s in r.scored] == y[test].tolist() and np.allclose([s.close for s in r.scored], close[test])


def test_newton_equals_the_library_of_spark(spark):
    u, v, _, y = SERIES["A"]
    rows = spark.createDataFrame([(float(a), float(b), int(k), "train") for a, b, k in zip(u, v, y)], "u double, v double, label int, part string")
    w, b, _ = walkforward.newton(np.column_stack([u, v]), y)
    got = {(r.u, r.v): r.score for r in baseline.logistic(rows, ["u", "v"]).collect()}
    for a, c in list(zip(u, v))[:50]:
        assert got[a, c] == pytest.approx(1 / (1 + math.exp(-(w[0] * a + w[1] * c + b))), abs=1e-4)


def test_newton_of_separable_and_bad_rows():
    x = np.array([[-1.0], [-2.0], [1.0], [2.0]])
    w, b, _ = walkforward.newton(x, np.array([0, 0, 1, 1]))
    assert w[0] > 0 and abs(b) < 1e-6
    w, _, _ = walkforward.newton(1e4 * x, np.array([0, 0, 1, 1]), c=1e6)  # separable: the penalty keeps it finite
    assert np.isfinite(w).all()
    for y in ([], [1, 1, 1, 1], [0, 0, 0, 0]):
        with pytest.raises(ValueError):
            walkforward.newton(x[: len(y)], np.array(y, int))


def test_metrics_of_folds(series):
    done = walkforward.fits(series, MODELS, n_folds=3, min_train=100)
    rows = {(r.asset, r.model, r.fold): r for r in done.collect()}
    got = walkforward.fold_metrics(done).collect()
    assert len(got) == len(rows)
    for m in got:
        r = rows[m.asset, m.model, m.fold]
        if r.status != "ok":
            assert m.accuracy is None and m.auc is None and m.beat is None
            continue
        y, s, close = ([getattr(p, k) for p in r.scored] for k in ("label", "score", "close"))
        assert m.accuracy == pytest.approx(np.mean([(b >= 0.5) == (a == 1) for a, b in zip(y, s)]), abs=1e-6)
        pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
        assert m.auc == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
        want = [0] + [int(b >= 0.55) for b in s][:-1]  # held from the bar after the signal
        ret = [0] + [b / a - 1 for a, b in zip(close, close[1:])]
        growth = np.cumprod([1 + (want[i - 1] if i else 0) * ret[i] - 0.001 * (i > 0 and want[i] != want[i - 1]) for i in range(len(ret))])
        assert m.total_return == pytest.approx(growth[-1] - 1) and m.benchmark_return == pytest.approx(close[-1] / close[0] - 1)
        assert m.max_drawdown == pytest.approx(min(g / max(growth[: i + 1]) - 1 for i, g in enumerate(growth)))
        assert m.beat == (m.total_return > m.benchmark_return)


def test_verdicts_count_failed_folds(series):
    metrics = walkforward.fold_metrics(walkforward.fits(series, MODELS, n_folds=3, min_train=100))
    got = {(r.asset, r.model): r for r in walkforward.verdicts(metrics, ["asset", "model"]).collect()}
    assert got["C|x", "u"].n_failed == got["C|x", "u"].n_folds == 3 and not got["C|x", "u"].overall
    assert got["A", "both"].n_failed == 0 and got["A", "both"].n == 6


def test_later_rows_do_not_reach_a_fit(series, spark):
    from pyspark.sql import functions as F

    other = series.withColumn("u", F.when(F.col("ts") >= F.lit(DAY + dt.timedelta(100)), F.col("u") * 50 + 3).otherwise(F.col("u")))
    one, two = ({(r.asset, r.model): (r.weights, r.intercept) for r in walkforward.fits(s, MODELS, n_folds=1, min_train=100).where("fold = 0 and status = 'ok'").collect()} for s in (series, other))
    assert one == two and one
    assert validation.folds(series.limit(0)).count() == walkforward.fits(series.limit(0), MODELS).count() == 0
