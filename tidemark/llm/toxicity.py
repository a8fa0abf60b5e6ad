"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of folded bytes (A-Z lower-cased, other ASCII that is not a
letter as space). The labelled training rows give each feature's log-count ratio between toxic and clean
texts; features whose ratio is not significant have none. A logistic regression with an L2 penalty then
weights the scaled features. A text's score is the logistic of its features' weights.

The classifier is fitted on a bounded sample of the labelled rows: at most ``MAX_ROWS`` of each label,
those of the smallest hash of doc_id (all, where there are fewer), with texts of at most ``MAX_TEXT``
bytes. Scoring covers every text whole.

Labels that are null are no labels. A document with several labels is toxic if one of them is 1;
of several texts with one id that of the least hash is learned from. Null and
empty texts have no features and get the score of the intercept. Without labels of both kinds every
score is the share of toxic labels (0 without labels). Equal rows get equal results; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.llm.textarrays import chunks

ORDERS = (4, 5, 6, 7)
BITS = 20
#: Bounds of the sample that the classifier is fitted on: rows of each label, bytes of a text.
MAX_ROWS, MAX_TEXT = {0: 3000, 1: 1500}, 16 << 10
#: Least document count and least z of a feature that is kept; smoothing of counts; L2 penalty.
MIN_DOCS, MIN_Z, SMOOTHING, PENALTY = 3, 3.2, 0.5, 0.5
STEPS = 300
#: Texts whose features the driver unpacks at once when it fits.
BLOCK = 256

CODE = np.full(256, 32, np.uint32)
CODE[128:] = np.arange(128, 256)
CODE[97:123] = np.arange(97, 123)
CODE[65:91] = np.arange(97, 123)


def ngrams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram at each byte) for each order."""
    codes = CODE[data]
    h = codes.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            yield n, x >> np.uint32(32 - BITS)


def features(data: np.ndarray) -> np.ndarray:
    """Distinct buckets of one text."""
    found = [b for _, b in ngrams(data)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


class Model(NamedTuple):
    weights: np.ndarray  # of each bucket
    intercept: float


class Scale(NamedTuple):
    """What the label counts of the sample say about each bucket."""

    ratio: np.ndarray
    kept: np.ndarray


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> Scale:
    """From the toxic and the clean training texts that hold each bucket, and the numbers of all such texts."""
    p, q = (pos + SMOOTHING) / (n_pos + 2 * SMOOTHING), (neg + SMOOTHING) / (n_neg + 2 * SMOOTHING)
    ratio = np.log(p / q)
    error = np.sqrt((1 - p) / (p * (n_pos + 1)) + (1 - q) / (q * (n_neg + 1)))
    return Scale(ratio, (pos + neg >= MIN_DOCS) & (np.abs(ratio) >= MIN_Z * error))


class Block(NamedTuple):
    """Some texts' kept features one after the other, and where each text begins."""

    columns: np.ndarray
    start: np.ndarray
    row: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each text the sum of x over its features."""
        total = np.concatenate([[0.0], np.cumsum(x[self.columns])])
        return np.diff(total[self.start])


def fit(scale: Scale, rows: list[tuple[int, np.ndarray]]) -> Model:
    """From (label, distinct kept buckets) of the sample, which has both labels; the list is used up, a block of texts at a time is unpacked."""
    weights = np.zeros(1 << BITS, np.float32)
    labels = np.array([y for y, _ in rows], float)
    n_pos, n_neg = labels.sum(), (1 - labels).sum()
    place = (np.cumsum(scale.kept) - 1).astype(np.int32)
    k = int(scale.kept.sum())
    blocks, rows = [], rows[::-1]
    while rows:
        some = [place[rows.pop()[1]] for _ in range(min(BLOCK, len(rows)))]
        start = np.concatenate([[0], np.cumsum([len(c) for c in some])])
        blocks.append(Block(np.concatenate(some), start, np.repeat(np.arange(len(some), dtype=np.int16), np.diff(start))))
    factor = scale.ratio[scale.kept]
    balance = np.where(labels == 1, 0.5 / n_pos, 0.5 / n_neg)
    w, b = np.zeros(k), 0.0
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, STEPS + 1):  # Adam; the problem is convex and small
        z = b + np.concatenate([block.sums(w * factor) for block in blocks])
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        slope, first = np.zeros(k), 0
        for block in blocks:
            slope += np.bincount(block.columns, g[first : first + len(block.start) - 1][block.row], k)
            first += len(block.start) - 1
        gradient = np.append(slope * factor + PENALTY / len(labels) * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights[scale.kept] = w * factor
    return Model(weights, float(b))


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logistic scores of texts that stand one after the other."""
    n = len(offsets) - 1
    used = model.weights != 0
    docs, buckets = [], []
    for order, bucket in ngrams(data):
        at = np.flatnonzero(used[bucket])
        doc = np.searchsorted(offsets, at, "right") - 1
        whole = at + order <= offsets[doc + 1]
        docs.append(doc[whole])
        buckets.append(bucket[at[whole]])
    total = np.full(n, model.intercept)
    if docs:
        one = np.unique(np.concatenate(docs).astype(np.uint64) << np.uint64(BITS) | np.concatenate(buckets))
        total += np.bincount((one >> np.uint64(BITS)).astype(np.int64), model.weights[(one & np.uint64((1 << BITS) - 1)).astype(np.int64)], n)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the training rows: ``labels`` (doc_id, toxic) joined to their texts.

    Tasks count the buckets; the driver gets their sums, and then of each sampled text the buckets whose
    ratio is significant, one partition at a time.
    """
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.octet_length("text") <= MAX_TEXT).select("doc_id", "text")
    usable = one.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    few = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in MAX_ROWS.items()]
    sample = written(texts.join(F.broadcast(few[0].unionAll(few[1])), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("toxic", "text"), F.xxhash64("text")).alias("row")).select("doc_id", "row.*"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                for y, a, b in zip(rows.column("toxic").to_pylist(), offsets[:-1], offsets[1:]):
                    held[int(y == 1)][features(data[a:b])] += 1
                    n[int(y == 1)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["clean", "toxic", "held"])

    held, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for r in sample.mapInArrow(count, "clean long, toxic long, held binary").toLocalIterator():
        held += np.frombuffer(r.held, np.int32).reshape(2, -1)
        n += (r.clean, r.toxic)
    if not n.all():
        share = min(max(n[1] / max(1, n.sum()), 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    scale = log_count_ratios(held[1], held[0], int(n[1]), int(n[0]))
    kept = docs.sparkSession.sparkContext.broadcast(scale.kept)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                own = [features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                packed = [f[kept.value[f]].astype("<u4").tobytes() for f in own]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("toxic"), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "packed"])

    packed = sample.mapInArrow(found, "doc_id long, toxic int, packed binary").toLocalIterator()
    rows = sorted(((r.doc_id, int(r.toxic == 1), np.frombuffer(r.packed, "<u4")) for r in packed), key=lambda r: r[0])
    return fit(scale, [r[1:] for r in rows])


SCORED = "doc_id long, score double, predicted int"


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted: one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                s = scores(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, SCORED)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                yield rows.filter(pa.array(scores(shared.value, data, offsets) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id) -> Column:
    """Rows that no label is learned from: a fifth by the CRC of doc_id; not those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
