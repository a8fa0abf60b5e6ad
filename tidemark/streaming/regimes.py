"""Regimes of a series told online: a Gaussian mixture that is refitted inside the state of its stream.

Each key has a detector: a ring of the last ``window`` vectors and a mixture of ``k`` components with
diagonal covariances. From ``10 k`` vectors on, every new vector refits the mixture, starting from the one
before (the first from k-means), and is then assigned to the most probable component. Every ``REFRESH`` vectors a
fit from k-means is made as well and taken if it is likelier: a start from before can miss a state that is new. The components of a
fit are matched to those of the fit before, so a label keeps its meaning.

The events of a key must come in the order of ``ts`` over the micro-batches; within one they are sorted. Then one
batch, many batches and the replay of a finished table give the same rows. A vector with a null or a
number that is not finite, or of another length than the key's first, is no observation: its row has no regime and the detector does not
see it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW, WARM, REFRESH = 8, 756, 10, 20
STEPS, LEAST_GAIN, LEAST_VARIANCE = 100, 1e-3, 1e-6

COLUMNS = "regime int, probability double, n_seen long"


class Mixture(NamedTuple):
    weight: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row under each component."""
        precision = 1 / self.variance
        square = x**2 @ precision.T - 2 * x @ (self.mean * precision).T + (self.mean**2 * precision).sum(1)
        return np.log(self.weight) - 0.5 * (square + np.log(2 * np.pi * self.variance).sum(1))

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Of each component for each row, and the mean log likelihood."""
        logs = self.logs(x)
        top = logs.max(1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        return np.exp(logs - total), float(total.mean())


def moments(x: np.ndarray, share: np.ndarray) -> Mixture:
    n = share.sum(0) + 10 * np.finfo(float).eps
    mean = share.T @ x / n[:, None]
    variance = share.T @ x**2 / n[:, None] - mean**2
    return Mixture(n / n.sum(), mean, np.maximum(variance, 0) + LEAST_VARIANCE)


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def first_fit(x: np.ndarray, k: int, tries: int = 4) -> Mixture:
    """Moments of the best of some k-means clusterings: centres start far from each other, drawn with a fixed seed; ordered by their coordinates."""
    rng, best, at = np.random.default_rng(42), None, x.mean(0)
    x = x - at
    for _ in range(tries):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            far = apart(x, centres).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]])
        for _ in range(50):
            own = np.eye(k)[apart(x, centres).argmin(1)]
            n = own.sum(0)
            moved = np.where(n[:, None] > 0, own.T @ x / np.maximum(n, 1)[:, None], centres)
            if np.abs(moved - centres).max() < 1e-9:
                break
            centres = moved
        spread = float(apart(x, centres).min(1).sum())
        if best is None or spread < best[0] - 1e-12:
            best = spread, centres
    centres = best[1][np.lexsort(best[1].T[::-1])]
    return moments(x + at, np.eye(k)[apart(x, centres).argmin(1)])


def fitted(x: np.ndarray, start: Mixture) -> Mixture:
    """Expectation and maximisation from ``start`` until the mean log likelihood gains less than ``LEAST_GAIN``."""
    before = -np.inf
    for _ in range(STEPS):
        share, likelihood = start.probabilities(x)
        if likelihood - before < LEAST_GAIN:
            break
        start, before = moments(x, share), likelihood
    return start


def matched(new: Mixture, old: Mixture) -> Mixture:
    """``new`` with its components in the order of ``old``: the assignment of the least sum of squared distances, by sets of old ones that are taken."""
    k = len(old.mean)
    cost = ((new.mean[:, None] - old.mean[None]) ** 2).sum(2)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for i in range(k):  # the new component i takes one old place
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for taken, (total, places) in best.items():
            for j in range(k):
                if not taken >> j & 1:
                    option = (total + float(cost[i, j]), (*places, j))
                    if taken | 1 << j not in step or option < step[taken | 1 << j]:
                        step[taken | 1 << j] = option
        best = step
    order = np.argsort(best[(1 << k) - 1][1])
    return Mixture(*(part[order] for part in new))


class Detector:
    """The state of one key."""

    def __init__(self, k: int = K, window: int = WINDOW):
        self.k, self.window, self.seen = k, window, 0
        self.ring, self.mixture = np.zeros((0, 0)), None

    def update(self, vector: list[float] | None) -> tuple[int | None, float | None, int]:
        """regime, its probability, vectors seen; no regime before the first fit."""
        x = np.array([np.nan] if vector is None else vector, float)
        if not len(x) or not np.isfinite(x).all() or self.seen and len(x) != self.ring.shape[1]:
            return None, None, self.seen
        self.ring = np.vstack([self.ring[-(self.window - 1) :], x]) if self.seen else x[None]
        self.seen += 1
        if len(self.ring) < WARM * self.k:
            return None, None, self.seen
        if self.mixture is None:
            self.mixture = fitted(self.ring, first_fit(self.ring, self.k))
        else:
            new = fitted(self.ring, self.mixture)
            if self.seen % REFRESH == 0:
                other = fitted(self.ring, first_fit(self.ring, self.k))
                new = other if other.probabilities(self.ring)[1] > new.probabilities(self.ring)[1] + LEAST_GAIN else new
            near = ((new.mean[:, None] - self.mixture.mean[None]) ** 2).sum(2)
            self.mixture = new if (near.argmin(0) == np.arange(self.k)).all() and (near.argmin(1) == np.arange(self.k)).all() else matched(new, self.mixture)
        p = self.mixture.probabilities(x[None])[0][0]
        return int(p.argmax()), float(p.max()), self.seen


def _rows(detector: Detector, events: pd.DataFrame) -> pd.DataFrame:
    events = events.sort_values("ts", kind="stable")
    found = [detector.update(None if v is None else list(v)) for v in events["vector"]]
    return pd.DataFrame(
        {"key": events["key"], "ts": events["ts"], "regime": pd.array([f[0] for f in found], "Int32"), "probability": pd.array([f[1] for f in found], "Float64"), "n_seen": np.array([f[2] for f in found], np.int64)}
    )


def _output(events: DataFrame) -> str:
    return f"key {events.schema['key'].dataType.simpleString()}, ts {events.schema['ts'].dataType.simpleString()}, {COLUMNS}"


def regimes(events: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """key, ts, regime, probability, n_seen of a stream (key, ts, vector): the detector of each key is its state.

    A micro-batch's events of one key are sorted in one task: bound them by the source's trigger limits.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def advance(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(state.get[0]) if state.exists else Detector(k, window)
        events = pd.concat(list(frames), ignore_index=True)
        yield _rows(detector, events)
        state.update((pickle.dumps(detector),))

    return events.select("key", "ts", "vector").groupBy("key").applyInPandasWithState(advance, _output(events), "detector binary", "append", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The same rows of a finished table. A task reads its keys one after the other in the order of ts and holds one detector,

    however long a series is.
    """

    def advance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, detector = None, None
        for frame in frames:
            for own, rows in frame.groupby("key", sort=False, dropna=False):
                if detector is None or not (own == key or pd.isna(own) and pd.isna(key)):
                    key, detector = own, Detector(k, window)
                yield _rows(detector, rows)

    dealt = events.select("key", "ts", "vector").repartition("key").sortWithinPartitions("key", "ts")
    return dealt.mapInPandas(advance, _output(events))


def market_vectors(bars: DataFrame) -> DataFrame:
    """(key, ts, vector): each bar's log return, log range and change of log volume; no vector on an asset's first bar."""
    from tidemark.functions.windows import lag

    step = bars.withColumns({"_r": F.ln(F.try_divide("close", lag("close"))), "_h": F.ln(F.try_divide("high", "low")), "_v": F.ln(F.try_divide("volume", lag("volume")))})
    return step.where("_r is not null").select(F.col("asset").alias("key"), "ts", F.array("_r", "_h", "_v").alias("vector"))
