"""Frames over the bars of an asset in time order.

A series is one asset's bars; its length is bounded by the calendar, not by the number of trades, so one
window partition holds it. All features of an asset share that one partitioning (one shuffle).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_time():
    return Window.partitionBy("asset").orderBy("ts")


def so_far():
    return in_time().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int):
    return in_time().rowsBetween(-(n - 1), 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def roll(agg: Callable[[Column], Column], x: str | Column, n: int) -> Column:
    """``agg`` over the last n rows; null unless all n are there and not null."""
    x = col(x)
    return F.when(F.count(x).over(last_rows(n)) == n, agg(x).over(last_rows(n)))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(in_time())


def flag(condition: Column) -> Column:
    """1 or 0; a comparison with a missing value is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def safe_corr(a: str | Column, b: str | Column, over=None) -> Column:
    """Pearson correlation of rows where both are there; null if one does not vary."""
    a, b = col(a), col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    of = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(of(F.covar_pop(x, y)), F.sqrt(F.greatest(of(F.var_pop(x)) * of(F.var_pop(y)), F.lit(0.0))))


def rolling_corr(a: str, b: str, n: int) -> Column:
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    return F.when(F.count(both).over(last_rows(n)) == n, safe_corr(a, b, last_rows(n)))


def ewm(df: DataFrame, columns: dict[str, tuple[str | tuple[str, str], float]], adjust: tuple[str, ...] = ()) -> DataFrame:
    """Adds exponentially weighted means: name -> (column, alpha). The recurrence y + alpha (x - y) starts at the first value.

    For a pair of columns, which may be means made before, the mean is of their difference.

    A recurrence is no window aggregate; a task runs it over one asset's series in one pass.
    """
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{n}` double" for n in columns)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        for name, (x, alpha) in columns.items():
            values = rows[x] if isinstance(x, str) else rows[x[0]] - rows[x[1]]
            rows[name] = values.ewm(alpha=alpha, adjust=name in adjust).mean()
        return rows

    return df.groupBy("asset").applyInPandas(run, schema)


def _rolled(kind: str, n: int, columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), np.nan)
    if len(out) < n:
        return out
    parts = [np.lib.stride_tricks.sliding_window_view(c, n) for c in columns]
    whole = np.flatnonzero(~np.logical_or.reduce([np.isnan(p).any(1) for p in parts]))
    x = parts[0][whole]
    if kind == "rank":
        found = ((x < x[:, -1:]).sum(1) + ((x == x[:, -1:]).sum(1) + 1) / 2) / n
    else:
        y = parts[1][whole]
        u, v = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        both, of_x, of_y = (u * v).sum(1), (u * u).sum(1), (v * v).sum(1)
        below = of_y if kind == "beta" else np.sqrt(of_x * of_y)
        fixed = (y == y[:, :1]).all(1) if kind == "beta" else (x == x[:, :1]).all(1) | (y == y[:, :1]).all(1)
        found = np.divide(both, below, out=np.full(len(below), np.nan), where=~fixed & (below > 0))
    out[whole + n - 1] = found
    return out


def rolled(df: DataFrame, columns: dict[str, tuple[str, int, tuple[str, ...]]]) -> DataFrame:
    """Adds statistics of the last n rows: name -> (kind, n, columns); null unless all n rows have all of them.

    rank: share of the values below the last, its equals counted half; corr: correlation of two; beta: slope of the first on the second. A task
    takes the windows of one asset's series at once; as window aggregates each would carry n values a row.
    """
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{n}` double" for n in columns)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        values = {c: rows[c].to_numpy(float) for _, _, cs in columns.values() for c in cs}
        for name, (kind, n, cs) in columns.items():
            rows[name] = _rolled(kind, n, [values[c] for c in cs])
        return rows

    return df.groupBy("asset").applyInPandas(run, schema)


def span(n: int) -> float:
    return 2 / (n + 1)
