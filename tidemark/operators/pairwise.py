"""Measures of all pairs of series, in pairs of blocks of packed series.

Each series (asset, ts, value; one value a ts) is packed once, as one row with its values in time order; its
length is bounded by the calendar. Series are dealt into blocks of about ``SIZE``, and two blocks
meet once: what is shuffled is each series as often as there are blocks, not a row for each pair and day.
A measure sees the values of the days that both series have. Nulls and not-a-numbers are no values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 32
Measure = Callable[[np.ndarray, np.ndarray], list[tuple]]


def packed(series: DataFrame, value: str) -> DataFrame:
    """(asset, at, x): times as whole numbers and values, in time order."""
    at = F.unix_date("ts") if series.schema["ts"].dataType.typeName() == "date" else F.unix_micros(F.col("ts").cast("timestamp"))
    rows = series.select("asset", F.struct(at.cast("long").alias("at"), F.col(value).cast("double").alias("x")).alias("p")).where("p.at is not null and p.x is not null and not isnan(p.x)")
    return rows.groupBy("asset").agg(F.sort_array(F.collect_list("p")).alias("p")).select("asset", F.col("p.at").alias("at"), F.col("p.x").alias("x"))


def pairwise(series: DataFrame, measure: Measure, columns: str, value: str = "ret", size: int = SIZE) -> DataFrame:
    """(a, b, ``columns``): the rows that ``measure`` gives for the common values of each pair a < b."""
    rows = packed(series, value)
    n = rows.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("n"))  # one row
    dealt = rows.crossJoin(F.broadcast(n)).withColumn("own", F.pmod(F.xxhash64("asset"), F.col("n")).cast("int"))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("n") - 1)))
    right = dealt.select([F.col(c).alias(c) for c in dealt.columns]).withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own"))))

    def unpacked(table: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray]]:
        at, x = ([v.values.to_numpy() for v in table[c]] for c in ("at", "x"))
        return list(zip(table["asset"].to_pylist(), at, x))

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        found = []
        others = unpacked(other)
        for a, at, x in unpacked(one):
            for b, bt, y in others:
                if a < b or a > b and one["i"][0] != one["j"][0]:  # a block with itself has each pair both ways
                    if len(at) == len(bt) and (at == bt).all():
                        u, v = x, y
                    else:
                        _, p, q = np.intersect1d(at, bt, assume_unique=True, return_indices=True)
                        u, v = x[p], y[q]
                    found += [(a, b, *r) for r in measure(u, v)] if a < b else [(b, a, *r) for r in measure(v, u)]
        names = ["a", "b", *(c.split()[0].strip("`") for c in columns.split(", "))]
        made = list(zip(*found)) if found else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(made, kinds)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"a string, b string, {columns}"
    kinds = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's; None if one does not vary."""
    if len(x) < 2 or (x == x[0]).all() or (y == y[0]).all():
        return None
    u, v = x - x.mean(), y - y.mean()
    below = np.sqrt((u @ u) * (v @ v))
    return float(np.clip(u @ v / below, -1, 1)) if below > 0 else None


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def spearman(x: np.ndarray, y: np.ndarray) -> float | None:
    return correlation(average_ranks(x), average_ranks(y))


def inversions(y: np.ndarray) -> int:
    """Pairs that stand in falling order, by merging runs: where an element of a right run goes, the left ones still to come are larger."""
    y, n, width, total = y.copy(), len(y), 1, 0
    place = np.arange(n)
    while width < n:
        block = place // (2 * width)
        order = np.lexsort((y, block))  # stable: of equal ones the left run's first
        right = order % (2 * width) >= width
        here = place - block * 2 * width  # where in its block an element lands
        n_left = np.minimum(width, n - block * 2 * width)
        before = here - (order - block * 2 * width - width)  # elements of the left run before one of the right run
        total += int((n_left - before)[right].sum())
        y, width = y[order], 2 * width
    return total


def tied_pairs(*columns: np.ndarray) -> int:
    n = np.unique(np.column_stack(columns), axis=0, return_counts=True)[1] if len(columns[0]) else np.zeros(0, np.int64)
    return int((n * (n - 1) // 2).sum())


def kendall(x: np.ndarray, y: np.ndarray) -> float | None:
    """Tau-b: concordant less discordant pairs over the root of the pairs not tied in x times those not tied in y; None if one does not vary."""
    n = len(x)
    order = np.lexsort((y, x))
    all_pairs, in_x, in_y = n * (n - 1) // 2, tied_pairs(x), tied_pairs(y)
    if all_pairs in (in_x, in_y):
        return None
    balance = all_pairs - in_x - in_y + tied_pairs(x, y) - 2 * inversions(np.unique(y, return_inverse=True)[1][order])
    return balance / (float(all_pairs - in_x) * float(all_pairs - in_y)) ** 0.5


#: Euler's constant; digamma of a whole number is a harmonic sum less it.
EULER = 0.5772156649015329
#: Distances within this part of a radius count as on it, so not inside.
ON_RADIUS = 1e-9


def digamma(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1."""
    n = np.asarray(n)
    return np.concatenate([[0.0], np.cumsum(1 / np.arange(1, max(int(n.max()), 2)))])[n - 1] - EULER


def neighbour_distance(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Of each point the k-th smallest max-norm distance to another: neighbours in the order of x are looked at, nearest
    first and on both sides, until x alone is farther than what is found."""
    n, order = len(x), np.argsort(x, kind="stable")
    u, v = x[order], y[order]
    best = np.full((n, k), np.inf)
    for side in (1, -1):
        open_ = np.arange(n)
        step = 0
        while len(open_):
            step += 1
            open_ = open_[(open_ + side * step >= 0) & (open_ + side * step < n)]
            other = open_ + side * step
            dx = np.abs(u[other] - u[open_])
            near = dx < best[open_, -1]
            open_, other, dx = open_[near], other[near], dx[near]
            d = np.maximum(dx, np.abs(v[other] - v[open_]))
            better = d < best[open_, -1]
            rows = open_[better]
            best[rows, -1] = d[better]
            best[rows] = np.sort(best[rows], axis=1)
    out = np.empty(n)
    out[order] = best[:, -1]
    return out


def strip_counts(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many values, its own included, are within the radius of each."""
    sorted_ = np.sort(x)
    return np.searchsorted(sorted_, x + radius, "right") - np.searchsorted(sorted_, x - radius, "left")


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float | None:
    """Mutual information in nats by k nearest neighbours (Kraskov's first estimator), at least 0; None for k points or fewer, or if one does not vary.

    Values are centred and brought to deviation 1. A point's radius is its k-th neighbour's distance; points strictly inside it
    count in each of the two strips.
    """
    n = len(x)
    if n <= k or (x == x[0]).all() or (y == y[0]).all():
        return None
    x, y = ((v - v.mean()) / v.std() for v in (x, y))
    radius = neighbour_distance(x, y, k) * (1 - ON_RADIUS)
    inside = [digamma(strip_counts(v, radius)).mean() for v in (x, y)]
    return max(0.0, float(digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - sum(inside)))


def lagged(x: np.ndarray, y: np.ndarray, lags: range) -> list[tuple[int, float | None, int]]:
    """(lag, r, n): x at i + lag with y at i."""
    n, out = len(x), []
    for lag in lags:
        u, v = (x[lag:], y[: n - lag]) if lag >= 0 else (x[:lag], y[-lag:])
        if abs(lag) < n:
            out.append((lag, correlation(u, v), len(u)))
    return out


def best_lag(x: np.ndarray, y: np.ndarray, most: int, least_rows: int) -> list[tuple]:
    """(lag, r, n) of the largest |r|, of equal ones the smallest lag; null if there is no r."""
    found = [f for f in lagged(x, y, range(-most, most + 1)) if f[2] >= least_rows]
    return [min(found, key=lambda f: (f[1] is None, -round(abs(f[1] or 0), 9), f[0]))] if found else []


def by_direction(x: np.ndarray, y: np.ndarray, least_rows: int, least_regime: int, span: int = 63) -> list[tuple]:
    """(n, all, bear, bull): bear days are those whose last ``span`` values of x sum below zero."""
    n = len(x)
    if n < least_rows:
        return []
    total = np.concatenate([[0.0], np.cumsum(x)])
    down = np.zeros(n, bool)
    down[span - 1 :] = (total[span:] - total[:-span]) < 0
    part = lambda m: correlation(x[m], y[m]) if m.sum() >= least_regime else None
    return [(n, correlation(x, y), part(down), part(~down))]


def binned_information(x: np.ndarray, y: np.ndarray, bins: int, least_rows: int) -> list[tuple]:
    """(n, nats) of a table of ``bins`` bins of equal counts each way, the first ones larger by one; ties by time."""
    n = len(x)
    if n < least_rows:
        return []
    edge = np.cumsum([n // bins + (i < n % bins) for i in range(bins)])

    def cut(v: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[np.argsort(v, kind="stable")] = np.searchsorted(edge, np.arange(n), "right")
        return out

    cells = np.bincount(cut(x) * bins + cut(y), minlength=bins * bins).reshape(bins, bins)
    u, v = np.nonzero(cells)
    c = cells[u, v]
    return [(n, float((c / n * np.log(c * n / (cells.sum(1)[u] * cells.sum(0)[v]))).sum()))]


def correlations(series: DataFrame, value: str = "ret", size: int = SIZE) -> DataFrame:
    """(a, b, n, r) of all pairs with a common day."""
    return pairwise(series, lambda x, y: [(len(x), correlation(x, y))] if len(x) else [], "n long, r double", value, size)


def rank_matrix(series: DataFrame, value: str = "ret", least_rows: int = 2, size: int = SIZE) -> DataFrame:
    """(a, b, n, pearson, spearman, kendall) of all pairs with ``least_rows`` common days."""
    return pairwise(series, lambda x, y: [(len(x), correlation(x, y), spearman(x, y), kendall(x, y))] if len(x) >= least_rows else [], "n long, pearson double, spearman double, kendall double", value, size)


def information(series: DataFrame, k: int = 3, least_rows: int = 60, value: str = "ret", size: int = SIZE) -> DataFrame:
    """(a, b, n, nats) by k nearest neighbours."""
    return pairwise(series, lambda x, y: [(len(x), neighbour_information(x, y, k))] if len(x) >= least_rows else [], "n long, nats double", value, size)
