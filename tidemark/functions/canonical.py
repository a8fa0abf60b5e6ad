"""One text for equal JSON values, and short digests of it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(body: str | None) -> str | None:
    try:
        return None if body is None else json.dumps(json.loads(body), sort_keys=True)
    except (ValueError, RecursionError):
        return None


def canonical(body: str | Column) -> Column:
    """The JSON text with the keys of all objects sorted, at any depth; ``, `` and ``: `` between items, numbers in shortest form, other than ASCII escaped.

    Of repeated keys the last counts. Text that is no JSON, and what is nested too deep to read, is null.
    """

    @F.pandas_udf("string")
    def texts(bodies: pd.Series) -> pd.Series:
        return bodies.map(_text).astype(object)

    return texts(body)


def digest(body: str | Column, n: int = 12) -> Column:
    """The first ``n`` hex digits of the SHA-256 of the canonical text."""
    return F.substring(F.sha2(canonical(body), 256), 1, n)


def dataset_digest(symbol: Column, columns: list[str], horizon: int, n_rows: Column, start: Column, end: Column, train: float, val: float, steps: int | None = None) -> Column:
    """The version of a data set by all that identifies it: symbol in capitals, columns in their order, sizes, times to the second, shares to four places."""
    parts = {"symbol": F.upper(symbol), "feature_cols": F.array(*map(F.lit, columns)), "target_horizon": F.lit(horizon), "n_rows": n_rows, "time_range_start": F.substring(start, 1, 19), "time_range_end": F.substring(end, 1, 19), "train_frac": F.lit(round(train, 4)), "val_frac": F.lit(round(val, 4)), "seq_len": F.lit(steps).cast("int")}
    return digest(F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())), {"ignoreNullFields": "false"}))
