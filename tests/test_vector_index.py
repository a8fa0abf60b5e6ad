"""Blocked and probed vector searches against plain ones."""

import math

import numpy as np
import pytest

from tidemark.operators import vector_index as vi

SCHEMA = "vec_id long, embedding array<double>, label int"


def made(n=300, d=6, groups=12):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(groups, d)) * 3
    rows = [(i, [float(x) for x in centres[i % groups] + rng.normal(size=d)], i % 3) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(40)]  # copies
    odd = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * d, 1), (2003, [math.nan] * d, 1), (2004, [None] * d, 1), (2005, [1.0] * (d - 1), 1), (2006, [math.inf] + [1.0] * (d - 1), 1)]
    return rows, odd


def asked(rows):
    return [(i, v) for i, v, _ in rows if i % 20 == 0]


def plain(rows, queries, k, threshold=-1.0, label=None):
    kept = [(i, np.array(v) / np.linalg.norm(v)) for i, v, l in rows if label is None or l == label]
    out = set()
    for q, v in queries:
        u = np.array(v) / np.linalg.norm(v)
        best = sorted((-round(float(u @ x), 9), i) for i, x in kept)
        out |= {(q, i, r) for r, (s, i) in enumerate(best[:k], 1) if -s >= threshold}
    return out


def ranked(df):
    return {(r.query_id, r.vec_id, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def frames(spark):
    rows, odd = made()
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(5), spark.createDataFrame(asked(rows) + [(5000, [0.0] * 6), (5001, None)], "query_id long, query array<double>")


@pytest.mark.parametrize("size, options", [(2048, {}), (17, {}), (50, {"threshold": 0.6}), (23, {"label": 1})])
def test_exact_search(frames, size, options):
    rows, _ = made()
    payload = {"label": options["label"]} if "label" in options else None
    got = ranked(vi.exact_top_k(*frames, 7, options.get("threshold", -1.0), payload, size))
    assert {g for g in got if g[1] != 2005} == plain(rows, asked(rows), 7, **options)
    assert not any(q >= 5000 for q, _, _ in got)


def test_all_probes_are_exact_and_a_few_find_most(frames):
    rows, _ = made()
    index = vi.cells(frames[0], 12)
    assert index.rows.count() == len(rows) and index.centres.shape == (12, 6)
    assert ranked(vi.probed_top_k(index, frames[1], 7, 12, size=30)) == plain(rows, asked(rows), 7)
    found = vi.probed_top_k(index, frames[1], 7, 3, size=30)
    told = vi.recall(found, vi.exact_top_k(*frames, 7)).collect()
    assert len(told) == len(asked(rows)) and np.mean([r.recall for r in told]) >= 0.9
    assert all(r.n_read < 0.6 * len(rows) for r in found.collect())
    by_cell = {}
    for r in index.rows.collect():
        by_cell.setdefault(r.cell, []).append(r)
    unit = index.centres
    for r in found.select("query_id", "n_read").distinct().collect():
        q = next(np.array(v) for i, v, _ in rows if i == r.query_id)
        near = np.argsort(-(unit @ (q / np.linalg.norm(q))), kind="stable")[:3]
        assert r.n_read == sum(len(by_cell.get(int(c), [])) for c in near)


def test_payload_conditions_come_before_the_ranking(frames):
    rows, _ = made()
    index = vi.cells(frames[0], 12)
    got = vi.probed_top_k(index, frames[1], 5, 12, payload={"label": 1}, threshold=0.2)
    assert ranked(got) == plain(rows, asked(rows), 5, 0.2, 1)


@pytest.mark.parametrize("size", [5, 100, 4096])
def test_alike_pairs(frames, size):
    rows, _ = made()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95}
    found = vi.alike(frames[0], 0.95, size).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want) > 1000
    assert all(r.cosine == pytest.approx(unit[r.a] @ unit[r.b]) for r in found)


def test_empty_tables(spark, frames):
    rows, queries = frames
    none = spark.createDataFrame([], SCHEMA)
    assert vi.exact_top_k(none, queries).count() == vi.exact_top_k(rows, queries.limit(0)).count() == vi.alike(none, 0.5).count() == 0
    assert vi.probed_top_k(vi.cells(none, 4), queries).count() == 0


def test_ids_may_be_text(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "vec_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query array<float>")
    assert [r.vec_id for r in vi.exact_top_k(rows, queries, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [(r.a, r.b) for r in vi.alike(rows, 0.9).collect()] == [("a", "b")]


def test_blocks_grow_so_that_each_vector_meets_a_bounded_number(spark, frames, monkeypatch):
    """With 2 meetings each row is dealt twice however small a square is (it was once for each block of ``size`` rows), and all pairs are found."""
    rows, _ = made()
    monkeypatch.setattr(vi, "MEETINGS", 2)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    want = {(a, b, label[a] is not None and label[a] == label[b]) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95}
    found = vi.alike(frames[0], 0.95, 20, same="label").collect()
    assert len(found) == len(want) and {(r.a, r.b, r.known) for r in found} == want


def test_best_of_rows_with_ties():
    rng = np.random.default_rng(9)
    score = rng.integers(0, 4, (30, 50)) / 3 + rng.choice([0, 2e-10, 3e-9], (30, 50))
    query, at, value = vi.best_of_rows(score, 7)
    order = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :7]
    assert (at.reshape(30, 7) == order).all() and (query == np.repeat(range(30), 7)).all() and (value == np.round(score, 9)[query, at]).all()
    assert vi.best_of_rows(score, 60)[0].size == 1500
