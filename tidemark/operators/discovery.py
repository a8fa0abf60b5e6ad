"""Further tests of pairs of series, and groups and factors of rows: Granger causality, mutual information, clusters, components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pairwise import binned_information, pairwise


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees of freedom > x)."""
    half = max(x, 0.0) / 2
    tail, k = (math.erfc(math.sqrt(half)), 1) if df % 2 else (math.exp(-half), 2)
    while k < df:
        tail += half ** (k / 2) * math.exp(-half) / math.gamma(k / 2 + 1)
        k += 2
    return min(tail, 1.0)


def _residual(design: np.ndarray, y: np.ndarray) -> float:
    fit = np.linalg.lstsq(design, y, rcond=None)[0]
    return float(((y - design @ fit) ** 2).sum())


def granger_p(cause: np.ndarray, effect: np.ndarray, most: int = 5) -> float | None:
    """The least p of lags 1 to ``most``: does the cause's past explain more of the effect than its own past? None if too short or constant."""
    if len(effect) < 4 * most + 10:
        return None
    found = []
    for lag in range(1, most + 1):
        past = lambda s: np.column_stack([s[lag - i : len(s) - i] for i in range(1, lag + 1)])  # noqa: E731, B023
        y, own = effect[lag:], np.column_stack([np.ones(len(effect) - lag), past(effect)])
        alone, both = _residual(own, y), _residual(np.column_stack([own, past(cause)]), y)
        if both <= 0:
            return None
        found.append(chi2_tail(len(y) * (alone - both) / both, lag))
    return min(found)


def granger(series: DataFrame, most: int = 5) -> DataFrame:
    """(a, b, n, p_a_causes_b, p_b_causes_a) of all pairs of series (asset, ts, ret) with common days."""
    return pairwise(series, lambda x, y: [(len(x), granger_p(x, y, most), granger_p(y, x, most))] if len(x) else [], "n long, p_a_causes_b double, p_b_causes_a double")


def mutual_information(series: DataFrame, bins: int = 8, least_rows: int = 60) -> DataFrame:
    """(a, b, n, nats): mutual information of the common days of all pairs, each side cut into bins of equal counts within its pair (ties by day)."""
    return pairwise(series, lambda x, y: binned_information(x, y, bins, least_rows), "n long, nats double")


def _assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with none of ``columns`` null, each standardised by the population's deviation (0 counts as 1), as one vector."""
    rows = rows.dropna(subset=columns)
    stats = rows.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = [((F.col(c) - F.lit(stats[f"{c}_m"] or 0.0)) / F.lit(stats[f"{c}_s"] or 1.0)).alias(f"_scaled_{c}") for c in columns]
    return VectorAssembler(inputCols=[f"_scaled_{c}" for c in columns], outputCol="_v").transform(rows.select("*", *scaled)).drop(*(f"_scaled_{c}" for c in columns))


def clustered(rows: DataFrame, columns: list[str], k: int, soft: bool = False, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` (k-means), and with ``soft`` the probabilities of a Gaussian mixture."""
    found = _assembled(rows, columns)
    model = GaussianMixture if soft else KMeans
    fitted = model(featuresCol="_v", predictionCol="cluster", k=k, seed=seed).fit(found).transform(found)
    if soft:
        fitted = fitted.withColumn("probabilities", vector_to_array("probability")).drop("probability")
    return fitted.drop("_v")


def components(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(component, explained, column, loading) of the k principal components; a component's largest loading is positive."""
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(_assembled(rows, columns))
    loadings, found = model.pc.toArray(), []  # columns x k
    for j in range(k):
        sign = np.sign(loadings[np.abs(loadings[:, j]).argmax(), j])
        found += [(j, float(model.explainedVariance[j]), c, float(sign * loadings[i, j])) for i, c in enumerate(columns)]
    return rows.sparkSession.createDataFrame(found, "component int, explained double, column string, loading double")
