"""Quality: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

Features of a text are which n-grams it has: of its folded bytes (digits as 0), and of the shapes of its
words (letters of a kind and digits run together, signs kept, with a mark where a word repeats the one
before). The labelled training rows give each hashed n-gram's log-count ratio between good and bad texts;
n-grams whose ratio is not significant have none. A linear model with hinge loss and an L2 penalty over the
indicators times their ratios is then fitted by dual coordinate descent, and a logistic curve over the margins of
rows kept apart from that fit turns margins into scores.

The model is fitted on a bounded sample of the labelled rows: at most ``MAX_ROWS`` of each
label, those of the smallest hash of doc_id, with texts of at most ``MAX_TEXT`` bytes; a fifth of these are for the
curve, weighted as the labels stand in all training rows. Scoring covers every text whole.

Labels that are null are no labels, nor are those of a null doc_id; a document with several labels is bad if one of them is 0; of
several texts with one id that of the least hash is learned from. Null and empty texts have no features and score as the intercept. Without
labels of both kinds every score is the share of good labels (1/2 without labels). Without a kind in the sample or the part kept apart, the rows of the other part stand in. Equal rows get equal
results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, written
from tidemark.llm.textarrays import Words, chunks, inside, joined, mixed, span_hashes, window_hashes

#: Lengths of n-grams of bytes and of word shapes; buckets that they are hashed to.
BYTES, SHAPES, BITS = (2, 3, 4), (1, 2, 3), 19
#: Bounds of the sample of the fit: rows of each label, bytes of a text.
MAX_ROWS, MAX_TEXT = 2500, 16 << 10
#: Least document count and least z of a feature that is kept; smoothing of counts; bound of a row's multiplier; passes over the rows.
MIN_DOCS, MIN_Z, SMOOTHING, COST, PASSES = 4, 4.0, 1.0, 0.1, 30
#: Bytes whose n-grams are made at once.
SLICE = 4 << 20
#: Score from which a text is predicted to be good.
GOOD = 0.7

FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[48:58] = 48
SHAPE = FOLDED.copy()
SHAPE[65:91], SHAPE[97:123], SHAPE[128:] = 65, 97, 97
SHAPE[[9, 10, 11, 12, 13]] = 32
RUNS = np.zeros(256, bool)
RUNS[[32, 48, 65, 97]] = True
_TOP = np.uint64(64 - BITS)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams of texts that stand one after the other, some of them several times."""
    number = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    most = max(BYTES) - 1
    for at in range(0, len(data), SLICE):  # a long text takes no more memory at once
        packed = folded = FOLDED[data[at : at + SLICE + most]].astype(np.uint64)
        text = number[at : at + SLICE + most]
        for n in range(2, most + 2):
            packed = packed[:-1] | folded[n - 1 :] << np.uint64(8 * (n - 1)) if len(packed) > 1 else packed[:0]
            if n in BYTES:
                whole = np.flatnonzero(text[: len(packed)][:SLICE] == text[n - 1 :][:SLICE]) if len(packed) else np.zeros(0, np.int64)
                bucket = (mixed(packed[whole] + np.uint64(n << 40)) >> _TOP).astype(np.int32)
                if len(data) > SLICE and len(offsets) == 2:
                    bucket = np.unique(bucket)
                    yield np.zeros(len(bucket), np.int32), bucket
                else:
                    yield text[whole], bucket
    words = Words(data, offsets)
    if not len(words.start):
        return
    kind = SHAPE[data]
    kept = np.ones(len(kind), bool)
    kept[1:] = (kind[1:] != kind[:-1]) | ~RUNS[kind[1:]]
    kept[words.start] = True  # also where a text begins within a run
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = span_hashes(kind[kept], place[words.start], place[words.end])
    own = words.hashes()
    again = np.zeros(len(own), np.uint64)
    again[1:] = own[1:] == own[:-1]
    again[words.first[words.first < len(own)]] = 0
    shapes = joined(shapes, again)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(words.first))
    for n in SHAPES:
        ok = np.flatnonzero(inside(words.first, n, len(shapes) - n + 1))
        if len(ok):
            yield text[ok], (window_hashes(shapes, n)[ok] >> _TOP).astype(np.int32)


def present(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, in no order."""
    found = [(np.searchsorted(text, np.arange(len(offsets))).tolist(), bucket) for text, bucket in ngrams(data, offsets)]
    last = np.zeros(1 << BITS, np.int32)  # where a bucket was seen last, so each is kept once
    for i in range(len(offsets) - 1):
        own = [bucket[at[i] : at[i + 1]] for at, bucket in found]
        own = np.concatenate(own) if own else np.zeros(0, np.int32)
        place = np.arange(len(own), dtype=np.int32)
        last[own] = place
        yield own[last[own] == place]


class Model(NamedTuple):
    weights: np.ndarray  # of each bucket
    intercept: float
    slope: float  # of the logistic curve over margins
    shift: float


class Scale(NamedTuple):
    """The buckets that count (ascending) and their log-count ratios."""

    buckets: np.ndarray
    ratio: np.ndarray


def log_count_ratios(buckets: np.ndarray, good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> Scale:
    """From the good and the bad training texts that hold each bucket, and the numbers of all such texts."""
    p, q = (good + SMOOTHING) / (n_good + 2 * SMOOTHING), (bad + SMOOTHING) / (n_bad + 2 * SMOOTHING)
    ratio = np.log(p / q)
    error = np.sqrt((1 - p) / (p * (n_good + 1)) + (1 - q) / (q * (n_bad + 1)))
    kept = (good + bad >= MIN_DOCS) & (np.abs(ratio) >= MIN_Z * error)
    return Scale(buckets[kept], ratio[kept])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and intercept that minimise |w|^2 / 2 + sum of cost * hinge loss.

    Each step sets one row's multiplier, within 0 and its cost, to the best value while the others stay; the
    intercept is a further feature, 1 in every row.
    """
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    square = np.array([1 + (ratio[r] ** 2).sum() for r in rows])
    rng = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, scale = rows[i], ratio[rows[i]]
            slope = y[i] * (w[r] @ scale + b) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * scale
                b += step
                moved, alpha[i] = max(moved, abs(step) / cost[i]), new
        if moved < 1e-4:
            break
    return w, b


def curve(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve through the labels, by Newton's method with a weak penalty on the slope."""
    n = [weight[good == k].sum() for k in (0, 1)]
    target = np.where(good == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))  # never quite 0 or 1
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x, ab = np.stack([margin / scale, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + [1e-3 * ab[0], 0]
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9]), gradient)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
        ab -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(ab[0], 0.0) / scale, ab[1]


def fit(scale: Scale, rows: list[np.ndarray], good: np.ndarray, apart: np.ndarray, share: float) -> Model:
    """From the kept buckets of the sample's texts (places within ``scale.buckets``), their labels, which are for the curve, and the share of good labels in all."""
    inner, outer = (k if set(good[k]) == {0, 1} else np.ones(len(good), bool) for k in (~apart, apart))
    used = np.flatnonzero(inner)
    n = np.bincount(good[used], minlength=2)
    w, b = descend([rows[i] for i in used], 2.0 * good[used] - 1, scale.ratio, COST * len(used) / (2 * n[good[used]]))
    own = w * scale.ratio
    margin = np.array([own[rows[i]].sum() + b for i in np.flatnonzero(outer)])
    n = np.bincount(good[outer], minlength=2)
    slope, shift = curve(margin, good[outer], np.where(good[outer] == 1, share * outer.sum() / n[1], (1 - share) * outer.sum() / n[0]))
    weights = np.zeros(1 << BITS, np.float32)
    weights[scale.buckets] = own
    return Model(weights, b, slope, shift)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of texts that stand one after the other."""
    margin = model.intercept + np.array([model.weights[own].sum(dtype=float) for own in present(data, offsets)])
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the training rows: ``labels`` (doc_id, quality) joined to their texts.

    Ids alone meet to find the sample; its texts are then picked by a broadcast of its ids, so no text of another
    document is moved. Tasks count the buckets of the sample, Spark adds the counts; the driver gets at most 2^BITS of them, and then the
    sampled texts' buckets whose ratio is significant.
    """
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    short = docs.where(F.octet_length("text") <= MAX_TEXT).select("doc_id", "text")
    total = {r.quality: r.n for r in one.groupBy((F.col("quality") == 1).cast("int").alias("quality")).agg(F.count("*").alias("n")).collect()}
    n_all = [total.get(y, 0) for y in (0, 1)]
    if not all(n_all):
        return constant(n_all[1], n_all[0])
    known = one.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    few = [known.where((F.col("quality") == 1) == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS) for good in (False, True)]
    ids = F.broadcast(few[0].unionAll(few[1]))
    sample = written(short.join(ids, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("quality", "text"), F.xxhash64("text")).alias("row")).select("doc_id", "row.*"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, (1 << BITS) + 1), np.int64)  # the last counts the texts
        for batch in batches:
            for part, data, offsets in chunks(batch):
                for y, own in zip(part.column("quality").to_pylist(), present(data, offsets)):
                    held[int(y == 1)][own] += 1
                    held[int(y == 1)][-1] += 1
        some = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[0, some]), pa.array(held[1, some])], names=["bucket", "bad", "good"])

    counts = sample.mapInArrow(count, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    held = counts.where((F.col("bad") + F.col("good") >= MIN_DOCS) | (F.col("bucket") == 1 << BITS)).toArrow().sort_by("bucket")
    bucket, bad, good = (held[c].to_numpy() for c in ("bucket", "bad", "good"))
    if not len(bucket) or not (bad[-1] and good[-1]):
        return constant(n_all[1], n_all[0])
    scale = log_count_ratios(bucket[:-1], good[:-1], bad[:-1], int(good[-1]), int(bad[-1]))
    place = np.full(1 << BITS, -1, np.int32)
    place[scale.buckets] = np.arange(len(scale.buckets))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                packed = [np.sort(own[own >= 0]).tobytes() for own in (shared.value[b] for b in present(data, offsets))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality"), pa.array(packed, pa.binary())], names=["doc_id", "quality", "packed"])

    picked = sorted(((r.doc_id, r.quality, np.frombuffer(r.packed, np.int32)) for r in sample.mapInArrow(found, "doc_id long, quality int, packed binary").toLocalIterator()), key=lambda r: r[0])
    forget(sample)
    labelled = np.array([int(r[1] == 1) for r in picked])
    apart = np.array([int(mixed(np.array([r[0]], np.int64).view(np.uint64))[0] % np.uint64(5)) == 0 for r in picked])
    return fit(scale, [r[2] for r in picked], labelled, apart, n_all[1] / sum(n_all))


def constant(n_good: int, n_bad: int) -> Model:
    share = min(max(n_good / (n_good + n_bad), 1e-6), 1 - 1e-6) if n_good + n_bad else 0.5
    return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted: one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                s = scores(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")


def held_out(doc_id: str) -> Column:
    """Rows that no label is learned from: a quarter by the CRC of doc_id; not those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
