"""The quality classifier: its parts against plain versions, held-out labels, awkward rows."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import DIR, docs, real  # noqa: F401
from tidemark.llm import quality_classifier as q
from tidemark.llm.textarrays import buffers


def arrays(texts):
    return buffers(pa.array(texts, pa.string()))


def plain_features(text):
    """What n-grams a text has, as text: of folded bytes, and of word shapes."""
    b = re.sub(rb"[0-9]", b"0", text.encode())
    found = {("bytes", b[i : i + n]) for n in q.BYTES for i in range(len(b) - n + 1)}
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    shapes = []
    for before, w in zip([None, *words], words):
        s = re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[0-9]+", b"0", re.sub(rb"[a-z\x80-\xff]+", b"a", w))))
        shapes.append((s, before == w))
    return found | {("shapes", tuple(shapes[i : i + n])) for n in q.SHAPES for i in range(len(shapes) - n + 1)}


TEXTS = ["", "A", "The cat, the cat sat.", "THE!! CAT!! 12 345 cat cat cat", "é ü ß Éa aÉ", "  x\n\ty | z ", "no no No NO 1 1 22 22", "a" * 70 + " " + "a" * 70, "x", "x"]


def test_features_tell_texts_apart_as_plain_ones_do():
    own = [set(b.tolist()) for b in q.present(*arrays(TEXTS))]
    assert [len(b) for b in q.present(*arrays(TEXTS))] == [len(o) for o in own]  # each once
    plain = [plain_features(t) for t in TEXTS]
    assert [len(o) for o in own] == pytest.approx([len(p) for p in plain], abs=2)  # buckets can coincide
    for i in range(len(TEXTS)):
        for j in range(len(TEXTS)):
            assert len(own[i] & own[j]) == pytest.approx(len(plain[i] & plain[j]), abs=2)
        assert [set(b.tolist()) for b in q.present(*arrays([TEXTS[i]]))] == [own[i]]  # neighbours in the array do not matter


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_long_texts_in_slices_have_the_same_features(monkeypatch, size):
    whole = [set(b.tolist()) for b in q.present(*arrays(TEXTS))]
    alone = [set(next(q.present(*arrays([t]))).tolist()) for t in TEXTS]
    monkeypatch.setattr(q, "SLICE", size)
    assert [set(b.tolist()) for b in q.present(*arrays(TEXTS))] == whole == alone
    assert [set(next(q.present(*arrays([t]))).tolist()) for t in TEXTS] == alone


def test_coordinate_descent_finds_the_least_loss():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio, cost = rng.normal(size=12), np.where(y > 0, 0.3, 0.7)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r], 1
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, b = q.descend(rows, y, ratio, cost, 2000)
    best = np.append(w, b)
    plain, low = np.zeros(13), math.inf
    for t in range(1, 60001):  # plain subgradient steps
        plain -= (plain - x.T @ (cost * y * (y * (x @ plain) < 1))) / t
        if t % 50 == 0:
            low = min(low, loss(plain))
    assert loss(best) <= low + 1e-3
    for i in range(13):
        for step in (1e-3, -1e-3):
            assert loss(best + step * np.eye(13)[i]) >= loss(best) - 1e-4  # steps of a descent end at 1e-4 of a multiplier


def test_curve_follows_the_labels():
    rng = np.random.default_rng(3)
    margin = rng.normal(size=4000) * 3
    good = (rng.random(4000) < 1 / (1 + np.exp(-(0.8 * margin - 0.5)))).astype(int)
    slope, shift = q.curve(margin, good, np.ones(4000))
    assert slope == pytest.approx(0.8, abs=0.08) and shift == pytest.approx(-0.5, abs=0.12)
    assert q.curve(np.ones(10), np.array([0, 1] * 5), np.ones(10))[0] >= 0
    assert q.curve(-margin, good, np.ones(4000))[0] == 0  # never falls


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return q.train(docs, labels.where(~q.held_out("doc_id")))


def test_held_out_labels(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = q.quality(docs, model).join(labels, "doc_id").where(q.held_out("doc_id") & F.col("quality").isNotNull()).collect()
    assert len(rows) > 900 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in bad) <= 0.03 * len(bad)
    good = [r for r in rows if r.quality == 1]
    assert sum(1 - r.predicted for r in good) <= 0.005 * len(good)


def test_scores_equal_plain_ones_and_ignore_neighbours(model):
    texts = [*TEXTS, "Some prose of the usual kind, with words that end. " * 30]
    got = q.scores(model, *arrays(texts))
    for t, s in zip(texts, got):
        margin = model.intercept + sum(float(model.weights[k]) for k in set(next(q.present(*arrays([t]))).tolist()))
        assert s == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-6)


def test_awkward_rows_and_tables(spark, docs, model):  # noqa: F811
    got = q.quality(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect()) and all(0 <= r.score <= 1 for r in got)
    none = next(r.score for r in got if r.doc_id == 1)
    assert none == next(r.score for r in got if r.doc_id == 2)  # null and empty
    assert q.quality(docs.limit(0), model).collect() == []
    labels = "doc_id long, quality int, text string"
    for rows, score in (([], 0.5), ([(3, 1, "x")], 1.0), ([(3, 0, "x"), (6, 0, "x")], 0.0), ([(None, 1, "x"), (3, None, "x")], 0.5)):
        found = q.quality(docs, q.train(docs, spark.createDataFrame(rows, labels))).collect()
        assert [r.score for r in found] == pytest.approx([score] * len(found), abs=1e-5)
    two = q.train(docs, spark.createDataFrame([(3, 1, "x"), (3, 1, "x"), (4, 0, "y"), (4, 1, "y"), (6, 1, "z"), (7, 0, "z")], labels))
    assert all(0 <= r.score <= 1 for r in q.quality(docs, two).collect())


def test_labels_and_ids_are_no_inputs(spark, real, model):  # noqa: F811
    one = {r.doc_id: r.score for r in q.quality(real, model).collect()}
    other = real.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(1).alias("quality"))
    assert {r.doc_id - 10**6: r.score for r in q.quality(other, model).collect()} == pytest.approx(one)
    assert DIR
