"""Values of fitted models and tests against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baseline, discovery, intelligence, pairwise


@pytest.mark.parametrize("n", [1, 2, 5, 10, 63, 500])
def test_t_tails_equal_the_integral(n):
    t = np.array([0.0, 0.1, -0.7, 1.0, 2.0, -3.5, 8.0])
    grid = np.tan(np.linspace(0, np.pi / 2 - 1e-9, 400_001))  # from 0 to far out
    mid, step = (grid[1:] + grid[:-1]) / 2, np.diff(grid)
    density = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + mid**2 / n) ** (-(n + 1) / 2) * step
    want = [2 * density[mid > abs(x)].sum() for x in t]
    assert baseline.t_tails(t, np.full(len(t), float(n))) == pytest.approx(want, abs=2e-4)


def test_t_tails_of_odd_rows(spark):
    got = baseline.t_tails(np.array([np.nan, 2.0, np.inf, 2.0, 1.0]), np.array([5.0, 0.0, 5.0, 10.0, 1.0]))
    assert np.isnan(got[:2]).all() and got[2:] == pytest.approx([0.0, 0.07338803477074, 0.5])
    rows = spark.createDataFrame([(2.0, 10), (None, 10), (2.0, None), (2.0, 0)], "t double, n int")
    assert [r.p if r.p is None else round(r.p, 6) for r in rows.select(baseline.t_tail(F.col("t"), F.col("n")).alias("p")).collect()] == [0.073388, None, None, None]


def plain_granger(cause, effect, most):
    """Normal equations solved by elimination, and the tail by summing the density."""

    def rss(x, y):
        return float(((y - x @ np.linalg.solve(x.T @ x, x.T @ y)) ** 2).sum())

    best = 1.0
    for lag in range(1, most + 1):
        rows = range(lag, len(effect))
        own = np.array([[1.0] + [effect[i - k] for k in range(1, lag + 1)] for i in rows])
        both = np.array([list(o) + [cause[i - k] for k in range(1, lag + 1)] for o, i in zip(own, rows)])
        y = np.array([effect[i] for i in rows])
        stat = len(y) * (rss(own, y) - rss(both, y)) / rss(both, y)
        grid = np.linspace(0, stat, 200_001)
        mid = (grid[1:] + grid[:-1]) / 2
        inside = (mid ** (lag / 2 - 1) * np.exp(-mid / 2)).sum() * (grid[1] - grid[0]) / (2 ** (lag / 2) * math.gamma(lag / 2))
        best = min(best, 1 - inside)
    return best


def test_granger_equals_a_plain_version(spark):
    rng = np.random.default_rng(6)
    for k in range(6):
        x, y = rng.normal(size=(2, 90))
        if k % 2:
            y[2:] += 0.2 * x[:-2]
        assert discovery.granger_p(x, y, 4) == pytest.approx(plain_granger(x, y, 4), abs=3e-3)
    x = np.sin(np.arange(60) * 1.7) + rng.normal(size=60)
    y = np.roll(x, 1) + 0.3 * rng.normal(size=60)
    import datetime as dt

    rows = [(a, dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for a, s in (("a", x), ("b", y)) for i, v in enumerate(s)]
    r = discovery.granger(spark.createDataFrame(rows, "asset string, ts date, ret double"), 3).first()
    assert (r.a, r.b, r.n) == ("a", "b", 60) and r.p_a_causes_b == pytest.approx(discovery.granger_p(x, y, 3)) and r.p_a_causes_b < 1e-3 < r.p_b_causes_a


def test_components_equal_the_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    got = {(r.component, r["column"]): (r.explained, r.loading) for r in discovery.components(rows, list("abcd"), 3).collect()}
    for j in range(3):
        v = vectors[:, 3 - j] * np.sign(vectors[np.abs(vectors[:, 3 - j]).argmax(), 3 - j])
        assert [got[j, c][1] for c in "abcd"] == pytest.approx(v.tolist(), abs=1e-6)
        assert got[j, "a"][0] == pytest.approx(values[3 - j] / values.sum())


def test_clusters_and_mixtures_find_what_is_apart(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [9, 0], [0, 9.0]])
    rows = [(i, i % 3, *map(float, centres[i % 3] + rng.normal(size=2))) for i in range(240)] + [(999, None, None, 1.0)]
    frame = spark.createDataFrame(rows, "i int, own int, u double, v double")
    for soft in (False, True):
        got = discovery.clustered(frame, ["u", "v"], 3, soft=soft).collect()
        assert len(got) == 240 and len({(r.own, r.cluster) for r in got}) == 3
        if soft:
            assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.probabilities[r.cluster] == max(r.probabilities) for r in got)


def test_indices_of_nodes_are_dense(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 90}", "R", 0.9, None) for i in range(200)], "src string, dst string, rel_type string, confidence double, pearson_r double")
    index, made = intelligence.tensors(edges, edges.select(F.explode(F.array("src", "dst")).alias("node")), {"R": 1})
    numbers = {r.node: r["index"] for r in index.collect()}
    assert sorted(numbers.values()) == list(range(200)) and all((r.i, r.j) == (numbers[r.src], numbers[r.dst]) for r in made.collect())


def test_binned_information_of_a_known_table():
    x = np.repeat([0.0, 1.0], 40)
    assert pairwise.binned_information(x, x, 2, 10) == [(80, pytest.approx(math.log(2)))]
    assert pairwise.binned_information(x, np.tile([0.0, 1.0], 40), 2, 10)[0][1] == pytest.approx(0.0, abs=1e-12)
    assert pairwise.binned_information(x, x, 2, 100) == []
