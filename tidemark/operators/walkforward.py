"""Walk-forward of fitted models: every (asset, model, fold) is a fit of its own, all of them in one job.

A series is packed once, as one row with its points in time order (its length is bounded by the calendar). Each fold
of each model then meets the packed row by the asset, and a task fits one after the other: scaling and
weights from the fold's train rows alone, a ridge logistic regression by Newton's method, scores of its test rows.
A fold that cannot be fitted is recorded with the reason and has no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest, validation

#: Newton steps at most, and the largest entry of a gradient at the end of a fit.
STEPS, FLAT = 100, 1e-8


class Model(NamedTuple):
    """A logistic model: which columns, how weak the ridge penalty is, whether classes weigh the same, and the score from which a bar is held."""

    name: str
    columns: tuple[str, ...]
    c: float = 1.0
    balanced: bool = True


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def newton(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = True) -> tuple[np.ndarray, float, int]:
    """Coefficients, intercept and steps of the least |w|^2 / 2 + c * sum of weighted logistic losses; the intercept is not penalised.

    A step is halved until the loss falls. Raises ValueError where there is no finite minimum or it is not reached.
    """
    n, ones = len(y), int(y.sum())
    if not 0 < ones < n:
        raise ValueError("one class in train" if n else "no train rows")
    weight = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones))) if balanced else np.ones(n)
    design, ridge = np.column_stack([x, np.ones(n)]), np.append(np.ones(x.shape[1]), 0.0)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(ridge @ w**2 / 2 + c * weight @ (np.logaddexp(0, z) - y * z))

    w = np.zeros(design.shape[1])
    before = loss(w)
    for step in range(STEPS):
        p = sigmoid(design @ w)
        slope = ridge * w + c * design.T @ (weight * (p - y))
        if np.abs(slope).max() < FLAT * max(1.0, c * n):
            return w[:-1], float(w[-1]), step
        curvature = np.diag(ridge) + c * (design * (weight * p * (1 - p))[:, None]).T @ design
        try:
            move = np.linalg.solve(curvature, slope)
        except np.linalg.LinAlgError:
            raise ValueError("singular") from None
        size, after = 1.0, loss(w - move)
        while not after <= before and size > 1e-6:
            size /= 2
            after = loss(w - size * move)
        if not after <= before:  # rounding: as flat as it gets
            return w[:-1], float(w[-1]), step
        w, before = w - size * move, after
    raise ValueError("no convergence")


def standardised(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Less the mean over the population's standard deviation of the train rows; a column that does not vary there is only centred."""
    sd = train.std(0)
    return (x - train.mean(0)) / np.where(sd > 0, sd, 1.0)


def packed(series: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(asset, n, points): the rows (asset, ts, close, label, columns) without a null or a not-a-number, in time order, as one row an asset."""
    rows = series.select("asset", "ts", "close", F.col(label).cast("int").alias("y"), *columns).dropna()
    point = F.struct("ts", "close", "y", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    return rows.groupBy("asset").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(point)).alias("points"))


def fits(series: DataFrame, models: list[Model], label: str = "label", **folding) -> DataFrame:
    """One row for each asset, model and fold: status (ok, or why it failed), sizes, Newton steps, intercept, weights, and its scored test rows.

    ``folding`` is that of ``validation.folds``, which sees the rows that have all columns of all models.
    """
    columns = sorted({c for m in models for c in m.columns})
    whole = packed(series, columns, label)
    bounds = validation.folds(whole.select("asset", F.explode("points.ts").alias("ts")), **folding).join(whole, "asset")
    each = bounds.select("*", F.explode(F.array(*(F.lit(m.name) for m in models))).alias("model")).repartition("asset", "model", "fold")
    known, place = {m.name: m for m in models}, {c: i for i, c in enumerate(columns)}
    ts = series.schema["ts"].dataType.simpleString()
    out = f"asset string, model string, fold int, status string, n_train int, n_val int, n_test int, steps int, intercept double, weights array<double>, scored array<struct<ts:{ts},close:double,label:int,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                points = one["points"].values  # a struct array
                model, (a, v, e, s, t) = known[one["model"].as_py()], (one[n].as_py() for n in ("train_start", "val_start", "train_end", "test_start", "test_end"))
                x = points.field("x").flatten().to_numpy().reshape(len(points), -1)[:, [place[c] for c in model.columns]]
                y, weights, intercept, steps, score = points.field("y").to_numpy(), None, None, None, None
                try:
                    found, intercept, steps = newton(standardised(x[a:v], x[a:v]), y[a:v], model.c, model.balanced)
                    weights, status = found.tolist(), "ok"
                    score = sigmoid(standardised(x[s:t], x[a:v]) @ found + intercept)
                except ValueError as why:
                    status = str(why)
                tested = None if score is None else pa.StructArray.from_arrays([points.field("ts")[s:t], points.field("close")[s:t], points.field("y")[s:t], pa.array(score)], ["ts", "close", "label", "score"]).to_pylist()
                yield pa.RecordBatch.from_pylist([{"asset": one["asset"].as_py(), "model": model.name, "fold": one["fold"].as_py(), "status": status, "n_train": v - a, "n_val": e - v, "n_test": t - s, "steps": steps, "intercept": intercept, "weights": weights, "scored": tested}], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(out))
    return each.mapInArrow(run, out)


RUN = ["asset", "model", "fold"]


def auc_by(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) of rows (label, score), ties counted half; 0.5 where a group has one class. Scores stay within their group."""
    at = scored.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = at.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return won.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("q")).cast("double")), F.lit(0.5)).alias("auc"))


def fold_metrics(done: DataFrame, threshold: float = 0.55, cost: float = 0.001) -> DataFrame:
    """Of each fold of ``fits``: accuracy, precision, recall, f1, auc of its test rows, and hit_rate, total_return, benchmark_return, sharpe, max_drawdown, beat of holding where the score reaches ``threshold``. Failed folds have nulls."""
    rows = done.where("status = 'ok'").select(*RUN, F.inline("scored")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    named = rows.withColumn("run", F.to_json(F.struct(*RUN)))
    quality = validation.classification(rows, RUN).select(*RUN, "accuracy", "precision", "recall", "f1").join(auc_by(rows, RUN), RUN)
    series = named.select(F.col("run").alias("asset"), "ts", "close", "score")
    held = backtest.positions(series.drop("score"), series.drop("close"), threshold, cost, delay=2)
    hits = backtest.hit_rate(backtest.trades(held, cost))
    market = series.groupBy("asset").agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("benchmark_return"))
    money = backtest.summary(held).join(market, "asset").join(hits, "asset", "left").withColumn("hit_rate", F.coalesce("hit_rate", F.lit(0.0)))
    money = money.select(F.from_json("asset", "asset string, model string, fold int").alias("r"), "total_return", "benchmark_return", "sharpe", "max_drawdown", "hit_rate").select("r.*", "total_return", "benchmark_return", "sharpe", "max_drawdown", "hit_rate")
    found = done.select(*RUN, "status", "n_train", "n_val", "n_test", "steps").join(quality, RUN, "left").join(money, RUN, "left")
    return found.withColumn("beat", F.col("total_return") > F.col("benchmark_return"))


def verdicts(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Whether a model is recommended by the gates over its folds that ran, and how many failed."""
    ran = metrics.where("status = 'ok'")
    told = validation.recommended(validation.gates(ran, by), by)
    runs = metrics.groupBy(*by).agg(F.count("*").alias("n_folds"), F.count_if(F.col("status") != "ok").alias("n_failed"))
    return runs.join(told, by, "left").withColumn("overall", F.coalesce("overall", F.lit(False)))
