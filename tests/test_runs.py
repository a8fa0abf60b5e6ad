"""Discovery runs: what a run reads, that it equals one from scratch, repeats and cut runs; canonical JSON."""

import datetime as dt
import json
import os
import shutil
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import canonical
from tidemark.operators import runs

DAY = dt.date(2024, 1, 1)


def made(n=260):
    rng = np.random.default_rng(8)
    common = rng.normal(size=n)
    rows = []
    for a in range(6):
        late = np.arange(n) > n // 2
        weight = [0.8, 0.8, 0.1, 0.0, 0.5, 0.0][a] + np.where(late, [0, -0.7, 0.8, 0.9, 0, 0][a], 0.0)
        close = 100 * np.exp(np.cumsum(0.01 * (weight * common + 0.5 * rng.normal(size=n))))
        rows += [(f"s{a}", DAY + dt.timedelta(int(i)), float(close[i])) for i in range(n) if rng.random() > 0.1 * a and (a < 5 or late[i])]
    return rows


@pytest.fixture(scope="module")
def closes(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/closes"
    spark.createDataFrame(made(), "asset string, ts date, close double").repartition(1).write.partitionBy("ts").parquet(path)
    return path


def told(spark, folder, version):
    return sorted(str((r.section, r.subject, r.change, None if r.before is None else round(r.before, 9), None if r.now is None else round(r.now, 9))) for r in runs.report(spark, folder, version).collect())


def plain_edges(rows, until, least_rows, least):
    by = {}
    for a, t, c in rows:
        by.setdefault(a, {})[t] = c
    rets = {}
    for a, s in by.items():
        days = sorted(s)
        rets[a] = {t: s[t] / s[p] - 1 for p, t in zip(days, days[1:]) if t <= until}
    out = {}
    for a in rets:
        for b in rets:
            common = sorted(rets[a].keys() & rets[b].keys())
            if a < b and len(common) >= least_rows:
                r = np.corrcoef([rets[a][t] for t in common], [rets[b][t] for t in common])[0, 1]
                if abs(r) >= least:
                    out[a, b] = r
    return out


def test_runs_over_new_days_equal_one_from_scratch(spark, closes):
    step, whole = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    copy = tempfile.mkdtemp(prefix="spark-") + "/closes"
    shutil.copytree(closes, copy)
    cuts = [DAY + dt.timedelta(129), DAY + dt.timedelta(200), DAY + dt.timedelta(400)]
    for k, cut in enumerate(cuts, 1):
        assert runs.discovered(spark.read.parquet(copy), step, str(cut), 40, 0.3) == k
        for name in os.listdir(copy):  # days that a run has read are not needed again
            if name.startswith("ts=") and name[3:] <= str(cut):
                shutil.rmtree(f"{copy}/{name}")
        os.makedirs(f"{copy}/ts={DAY + dt.timedelta(900)}", exist_ok=True) if k == 3 else None
    want = plain_edges(made(), DAY + dt.timedelta(400), 40, 0.3)
    got = {(r.a, r.b): r.r for r in runs.table(spark, step, "edges", 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    first = plain_edges(made(), cuts[0], 40, 0.3)
    assert {(r.a, r.b) for r in runs.table(spark, step, "edges", 1).collect()} == first.keys() != want.keys()
    assert runs.discovered(spark.read.parquet(closes), whole, str(cuts[1]), 40, 0.3) == 1
    assert runs.discovered(spark.read.parquet(closes), whole, None, 40, 0.3) == 2
    assert told(spark, whole, 2) == told(spark, step, 3)
    rank = {r.node: r["rank"] for r in runs.table(spark, step, "ranking", 3).collect()}
    size = {n: sum(abs(r) for e, r in want.items() if n in e) for n in rank}
    assert [n for n, _ in sorted(rank.items(), key=lambda i: i[1])] == sorted(size, key=lambda n: (-size[n], n))


def test_a_run_without_new_days_writes_nothing(spark, closes):
    folder = tempfile.mkdtemp(prefix="spark-")
    found = spark.read.parquet(closes)
    assert runs.discovered(found.limit(0), folder) is None and runs.discovered(found, folder, None, 40, 0.3) == 1
    files = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, n in os.walk(folder) for f in n}
    assert runs.discovered(found, folder, None, 40, 0.3) == 1
    assert {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, n in os.walk(folder) for f in n} == files
    led = runs.ledger(spark, folder).collect()
    assert [(r.version, r.upto, r.n_closes) for r in led] == [(1, DAY + dt.timedelta(259), len(made()))]


def test_a_run_that_was_cut_short_is_made_again(spark, closes):
    folder, found = tempfile.mkdtemp(prefix="spark-"), spark.read.parquet(closes)
    runs.discovered(found, folder, str(DAY + dt.timedelta(150)), 40, 0.3)
    runs.discovered(found, folder, None, 40, 0.3)
    want = told(spark, folder, 2)
    ledger = spark.createDataFrame([r for r in runs.ledger(spark, folder).collect() if r.version == 1], runs.LEDGER)
    ledger.write.parquet(f"{folder}/other")
    shutil.rmtree(f"{folder}/ledger")
    shutil.move(f"{folder}/other", f"{folder}/ledger")
    shutil.rmtree(f"{folder}/edges/version=2")
    assert runs.discovered(found, folder, None, 40, 0.3) == 2 and told(spark, folder, 2) == want


def test_changes_of_edges_and_ranks(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a string, b string, n long, r double")
    before, now = edges([("a", "b", 9, 0.5), ("a", "c", 9, -0.6), ("c", "d", 9, 0.5), ("x", "y", 9, 0.9)]), edges([("a", "b", 9, 0.7), ("a", "c", 9, 0.5), ("c", "d", 9, 0.505), ("e", "f", 9, 0.4)])
    got = {(r.a, r.b): r.change for r in runs.edge_changes(before, now).collect()}
    assert got == {("a", "b"): "strengthened", ("a", "c"): "weakened", ("x", "y"): "lost", ("e", "f"): "gained"}
    ranks = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "node string, rank int")
    moved = {r.node: (r.change, r.previous_rank, r.current_rank) for r in runs.rank_changes(ranks("abcd"), ranks("bacx")).collect()}
    assert moved == {"a": ("down", 1, 2), "b": ("up", 2, 1), "x": ("entered", None, 4)}
    assert {r.metric: r.value for r in runs.metrics_of(now, runs.ranking_of(now)).collect()}["n_nodes"] == 6


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=6), c, max_size=5), max_leaves=25)


@settings(max_examples=25, deadline=None)
@given(st.lists(values, min_size=1, max_size=20))
def test_canonical_json_is_that_of_the_library(spark, found):
    bodies = [json.dumps(v, ensure_ascii=False, indent=1) for v in found] + [None, "", "{", "nul", '{"a": 1, "a": 2}', "[" * 100000]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = [r.c for r in rows.select("i", canonical.canonical("body").alias("c")).orderBy("i").collect()]
    assert got == [json.dumps(v, sort_keys=True) for v in found] + [None, None, None, None, '{"a": 2}', None]
