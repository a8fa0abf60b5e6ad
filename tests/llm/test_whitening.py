"""Whitening against plain numpy, whatever the tiles and row-blocks are."""

import math

import numpy as np
import pytest

from tests.llm.test_llm import DIR
from tidemark.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)


def plain(rows, components):
    """(vec_id, component) -> results, signs aside."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = np.array([[n * r[k] - sums[k] for k in range(d)] for r in x], float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), r, own in zip(good, x, y):
        deviation = sum((n * r[k] - sums[k]) ** 2 for k in range(d))
        out += [(i, c + 1, n, deviation, own @ vectors[:, c] / math.sqrt(values[c]), values[c] / values.sum()) for c in range(min(components, d))]
    return out


def compare(got, want):
    got = sorted(got, key=lambda r: (r.component, r.vec_id is None, r.vec_id or 0, r.deviation))
    want = sorted(want, key=lambda r: (r[1], r[0] is None, r[0] or 0, r[3]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    for c in {r.component for r in got}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want))
        assert np.allclose(a, b * np.sign(a @ b), atol=1e-8)
    assert np.allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("tile, block_rows", [(32, 4096), (5, 7), (3, 1), (100, 50)])
def test_whitening_of_awkward_rows(spark, tile, block_rows):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(11, 11))
    rows = [(i, (rng.normal(size=11) @ mix * 3 + 100).tolist()) for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[5][1])]
    bad = [(100, None), (101, []), (102, [None] + [1.0] * 10), (103, [math.nan] + [1.0] * 10), (104, [math.inf] + [1.0] * 10), (105, [-math.inf] * 11), (106, [1e300] + [1.0] * 10), (107, [1.0] * 10)]
    got = w.whitened(frame(spark, rows + bad).repartition(5), 8, tile, block_rows).collect()
    compare(got, plain(rows, 8))


def test_whitening_of_real_rows(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    compare(w.whitened(table).collect(), plain([(r.vec_id, r.embedding) for r in table.collect()], 32))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_whitening_without_variance_has_no_rows(spark, rows):
    assert w.whitened(frame(spark, rows)).collect() == []


def test_dimensions_that_do_not_vary_are_no_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), 7.0, float(b), float(a)]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    got = w.whitened(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9 and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9


def test_deviations_that_do_not_fit_are_null():
    model = w.Whitening(w.Covariance(10**9, np.array([10**9 * 50]), np.ones((1, 1))), np.ones((1, 1)), np.ones(1), np.ones(1))
    assert model.deviations(np.array([[50], [53], [49], [54]])).to_pylist() == [0, 9 * 10**18, 10**18, None]


def test_too_many_dimensions(spark):
    with pytest.raises(ValueError, match="at most 4096"):
        w.whitened(frame(spark, [(1, [1.0] * 4097)]))
