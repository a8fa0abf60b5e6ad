"""Baseline models and scaling by folds, and evidence made of results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(rows: DataFrame, columns: list[str], by: list[str], part: str = "part") -> DataFrame:
    """Columns less their mean over their standard deviation (of the population) in the train rows of each group; a column that does not vary is only centred.

    Statistics of nulls and not-numbers are left out; the other parts are scaled by those of train.
    """
    seen = lambda c: F.when((F.col(part) == "train") & ~F.isnan(F.col(c)), F.col(c))
    stats = rows.groupBy(*by).agg(*(F.avg(seen(c)).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(seen(c)).alias(f"_s_{c}") for c in columns))
    done = rows.join(stats, by).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns})
    return done.select(*rows.columns)


def logistic(rows: DataFrame, columns: list[str], label: str = "label", part: str = "part", penalty: float = 1.0) -> DataFrame:
    """Rows with ``score``, the probability of label 1 by a ridge logistic regression with balanced weights, fitted on the train rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows.dropna(subset=[*columns, label]))
    train = made.where(F.col(part) == "train")
    n, ones = train.agg(F.count("*"), F.sum(F.col(label))).first()
    weight = F.when(F.col(label) == 1, n / (2 * max(ones or 0, 1))).otherwise(n / (2 * max((n or 0) - (ones or 0), 1)))
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=penalty / max(n, 1), maxIter=100, standardization=False).fit(train.withColumn("_w", weight))
    return model.transform(made).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, all values at once."""
    tiny = 1e-300
    apart = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / apart(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / apart(1 + top * d)
            c = apart(1 + top / c)
            out = out * c * d
        if (np.abs(c * d - 1) < 1e-13).all():
            break
    return out


def t_tails(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t with n degrees of freedom; nan where one is missing or n is not positive."""
    ok = np.isfinite(t) & (n > 0)
    out = np.where(np.isinf(t) & (n > 0), 0.0, np.nan)
    a, t = n[ok] / 2, t[ok]
    b, x = np.full(len(a), 0.5), 2 * a / (2 * a + t * t)
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    y = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(gamma(a + b).astype(float) - gamma(a).astype(float) - math.lgamma(0.5) + a * np.log(y) + b * np.log1p(-y))
    low = x < (a + 1) / (a + b + 2)
    tail = np.where(low, front * beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, y, 1 - y)) / np.where(low, a, b), 0.0)
    tail = np.where(low, tail, 1 - front * beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, y, 1 - y)) / np.where(low, a, b))
    out[ok] = np.where(t == 0, 1.0, np.clip(tail, 0.0, 1.0))
    return out


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, by Arrow batches; null where t is, or df is not positive."""

    @F.pandas_udf("double")
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(t_tails(t.to_numpy(float), n.to_numpy(float)))

    return F.nanvl(run(t, df.cast("double")), F.lit(None).cast("double"))


#: Confidence of evidence by accuracy: lowest accuracy and confidence (fixed values).
TIERS = ((0.58, 0.70), (0.54, 0.58))
LOWEST = 0.42


def evidence(folds: DataFrame, source_type: str = "walk_forward") -> DataFrame:
    """(evidence_id, source_type, subject, confidence, note) of folds (model, fold, accuracy)."""
    confidence = F.when(F.col("accuracy") >= TIERS[0][0], TIERS[0][1]).when(F.col("accuracy") >= TIERS[1][0], TIERS[1][1]).otherwise(LOWEST)
    name = F.concat_ws(":", F.lit(source_type), F.col("model").cast("string"), F.col("fold").cast("string"))
    return folds.select(F.substring(F.sha2(name, 256), 1, 12).alias("evidence_id"), F.lit(source_type).alias("source_type"), F.col("model").alias("subject"), confidence.alias("confidence"), F.format_string("%s fold %d: accuracy %.3f", F.col("model").cast("string"), F.col("fold").cast("int"), "accuracy").alias("note"))


def saved(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Old rows and the new ones whose key is not there yet; of new ones that share a key the least row."""
    rest = [c for c in new.columns if c != key]
    fresh = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return old.unionByName(fresh.select(old.columns))


def winner(results: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Of each group the model of the best metric (ties by name), its lead on the second, and how sure that is."""
    best = F.array_sort(F.collect_list(F.struct((-F.col(metric)).alias("m"), "model")))
    done = results.where(F.col(metric).isNotNull()).groupBy(*by).agg(best.alias("b"))
    lead = F.when(F.size("b") > 1, F.col("b")[1]["m"] - F.col("b")[0]["m"]).otherwise(0.0)
    return done.select(*by, F.col("b")[0]["model"].alias("winner"), (-F.col("b")[0]["m"]).alias(metric), lead.alias("lead"), F.when(lead >= 0.02, 0.60).otherwise(0.55).alias("confidence"))
