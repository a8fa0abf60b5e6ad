"""Online regimes: the stream, in one batch or many, equals the replay, and both equal a plain detector."""

import datetime as dt
import itertools
import math
import tempfile

import numpy as np
import pytest

from tidemark.streaming import regimes

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, vector array<double>"


def made(seed, n, d=2):
    """Vectors of three states that follow each other."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, size=(3, d))
    return [(centres[(i // 17) % 3] + rng.normal(0, 0.7, d)).tolist() for i in range(n)]


def plain(vectors, k, window):
    """Numbers of a mixture written out as loops, refitted from the one before."""

    def densities(x, mix):
        return [w * math.prod(math.exp(-((a - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v) for a, m, v in zip(x, mean, var)) for w, mean, var in mix]

    def maximised(ring, share):
        mix = []
        for j in range(k):
            n = sum(s[j] for s in share) + 10 * np.finfo(float).eps
            mean = [sum(s[j] * x[c] for s, x in zip(share, ring)) / n for c in range(len(ring[0]))]
            var = [max(sum(s[j] * x[c] ** 2 for s, x in zip(share, ring)) / n - mean[c] ** 2, 0) + 1e-6 for c in range(len(ring[0]))]
            mix.append((n, mean, var))
        total = sum(m[0] for m in mix)
        return [(n / total, mean, var) for n, mean, var in mix]

    ring, mix, out, seen = [], None, [], 0
    for x in vectors:
        if x is None or not x or any(a is None or not math.isfinite(a) for a in x) or (ring and len(x) != len(ring[0])):
            out.append((None, None, seen))
            continue
        ring, seen = [*ring, x][-window:], seen + 1
        if len(ring) < 10 * k:
            out.append((None, None, seen))
            continue
        old = mix
        likelihood = lambda mix: sum(math.log(sum(densities(r, mix))) for r in ring) / len(ring)  # noqa: E731, B023

        def run(mix):
            before = -math.inf
            for _ in range(100):
                dens = [densities(r, mix) for r in ring]  # noqa: B023
                now = likelihood(mix)  # noqa: B023
                if now - before < 1e-3:
                    break
                before, mix = now, maximised(ring, [[a / sum(p) for a in p] for p in dens])  # noqa: B023
            return mix

        first = regimes.first_fit(np.array(ring), k)
        fresh = run(list(zip(first.weight.tolist(), first.mean.tolist(), first.variance.tolist()))) if mix is None or seen % 20 == 0 else None
        if mix is None:
            mix = fresh
        else:
            mix = run(mix)
            mix = fresh if fresh and likelihood(fresh) > likelihood(mix) + 1e-3 else mix
        if old:
            cost = lambda order: sum((a - b) ** 2 for i, j in enumerate(order) for a, b in zip(mix[j][1], old[i][1]))
            mix = [mix[j] for j in min(itertools.permutations(range(k)), key=cost)]
        p = densities(x, mix)
        out.append((p.index(max(p)), max(p) / sum(p), seen))
    return out


VECTORS = {"a": made(1, 90), "b": made(2, 45), "short": made(3, 7), "odd": [None, [], [1.0, math.nan], [1.0], *made(4, 40), [1.0, 2.0], None]}


def rows():
    return [(k, DAY + dt.timedelta(days=i), v) for k, vectors in VECTORS.items() for i, v in enumerate(vectors)]


def told(df):
    return sorted((r.key, r.ts, r.regime, None if r.probability is None else round(r.probability, 9), r.n_seen) for r in (df.collect() if hasattr(df, "collect") else df))


def streamed(spark, parts, name):
    """The rows that a stream of one file a batch gives."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = regimes.regimes(events, 3, 60).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive
    return spark.table(name)


@pytest.fixture(scope="module")
def replay(spark):
    return told(regimes.replayed(spark.createDataFrame(rows(), SCHEMA).repartition(6), 3, 60))


def test_replay_equals_a_plain_detector(replay):
    for key, vectors in VECTORS.items():
        got = [r[2:] for r in replay if r[0] == key]
        want = plain(vectors, 3, 60)
        assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
        assert [g[1] for g in got if g[1] is not None] == pytest.approx([w[1] for w in want if w[1] is not None], abs=1e-6)


def test_regimes_follow_the_states(replay):
    found = [r[2] for r in replay if r[0] == "a"][60:]  # each state is 17 vectors long
    blocks = [found[0:8], found[8:25], found[25:30]]
    assert all(len(set(b)) == 1 for b in blocks) and len({b[0] for b in blocks}) == 3


def test_one_batch_equals_the_replay(spark, replay):
    assert told(streamed(spark, [rows()], "one_batch")) == replay


def test_many_batches_equal_the_replay(spark, replay):
    edges = [0, 5, 31, 33, 60, 200]
    parts = [[r for r in rows() if DAY + dt.timedelta(days=a) <= r[1] < DAY + dt.timedelta(days=b)][::-1] for a, b in zip(edges, edges[1:])]
    assert told(streamed(spark, parts, "many_batches")) == replay


def test_components_keep_their_labels():
    rng = np.random.default_rng(5)
    for _ in range(20):
        old = regimes.Mixture(np.full(5, 0.2), rng.normal(size=(5, 3)), np.ones((5, 3)))
        order = rng.permutation(5)
        new = regimes.Mixture(np.arange(5.0)[order], old.mean[order] + 0.01, np.ones((5, 3)))
        assert regimes.matched(new, old).weight.tolist() == [0, 1, 2, 3, 4]
        far = regimes.Mixture(np.arange(5.0), rng.normal(size=(5, 3)), np.ones((5, 3)))
        cost = lambda p: ((far.mean[list(p)] - old.mean) ** 2).sum()  # noqa: E731, B023
        assert tuple(regimes.matched(far, old).weight.astype(int)) == min(itertools.permutations(range(5)), key=cost)


def test_empty_and_constant_series(spark):
    assert regimes.replayed(spark.createDataFrame([], SCHEMA)).collect() == []
    same = [("c", DAY + dt.timedelta(days=i), [1.0, 2.0]) for i in range(40)]
    got = regimes.replayed(spark.createDataFrame(same, SCHEMA), 3, 60).orderBy("ts").collect()
    assert [r.regime is None for r in got] == [i < 29 for i in range(40)]
