"""Walk-forward folds, their aggregates and gates, classification metrics and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import running


def folds(series: DataFrame, n_folds: int = 5, min_train: int = 120, val_frac: float = 0.15, gap: int = 0, rolling: bool = False) -> DataFrame:
    """Bounds (end exclusive) of each asset's folds, from its number of rows; folds that overflow are left out."""
    sizes = series.groupBy("asset").agg(F.count("*").alias("n")).withColumn("size", F.greatest(F.floor((F.col("n") - min_train) / n_folds), F.lit(1)))
    each = sizes.select("asset", "n", "size", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    end = F.lit(min_train) + F.col("fold") * F.col("size")
    each = each.withColumns({"train_start": F.col("fold") * F.col("size") if rolling else F.lit(0).cast("long"), "train_end": end, "test_start": end + gap, "test_end": end + gap + F.col("size")})
    n_val = F.greatest(F.floor((F.col("train_end") - F.col("train_start")) * val_frac), F.lit(1)) if val_frac else F.lit(0)
    return each.withColumn("val_start", F.col("train_end") - n_val).where("test_end <= n").drop("n", "size")


def sliced(series: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of each fold with their part: train, val or test."""
    rows = series.withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("ts")) - 1)
    part = F.when(F.col("i").between(F.col("train_start"), F.col("val_start") - 1), "train").when(F.col("i").between(F.col("val_start"), F.col("train_end") - 1), "val").when(F.col("i").between(F.col("test_start"), F.col("test_end") - 1), "test")
    return rows.join(bounds, "asset").withColumn("part", part).where("part is not null").select(*series.columns, "fold", "part")


def fold_summary(metrics: DataFrame, by: list[str], value: str) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(value).alias("n_folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def classification(scored: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall and f1 of rows with label and predicted."""
    hit = lambda y, p: F.count_if((F.col("label") == y) & (F.col("predicted") == p))
    n = scored.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    tiny = 1e-9
    n = n.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") + tiny), "precision": F.col("tp") / (F.col("tp") + F.col("fp") + tiny), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + tiny)})
    return n.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + tiny))


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the curve from counts of each distinct score; 0.5 for one class. Running sums go by ranges of scores."""
    at = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    won = running(at, score, "q").withColumn("won", F.col("p") * (F.col("before") + F.col("q") / 2))
    return won.agg(F.coalesce(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("q")).cast("double")), F.lit(0.5)).alias("auc"))


def auc_by_thresholds(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve by the trapezoids of 101 thresholds from 1 to 0; 0.5 for one class. One aggregate."""
    hit = lambda y, k: F.count_if((F.col(label) == y) & (F.col(score) >= k / 100)).cast("double")
    n = scored.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"), F.array(*(F.struct(hit(1, k).alias("t"), hit(0, k).alias("f")) for k in range(100, -1, -1))).alias("at"))
    area = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, i: s + (F.col("at")[i]["f"] - F.col("at")[i - 1]["f"]) * (F.col("at")[i]["t"] + F.col("at")[i - 1]["t"]) / 2)
    return n.select(F.coalesce(F.try_divide(area, (F.col("p") * F.col("q")).cast("double")), F.lit(0.5)).alias("auc"))


def composite(accuracy: str, auc_: str, hit_rate: str, sharpe: str) -> Column:
    """Weighted score of an experiment; the Sharpe ratio is brought from [-3, 3] to [0, 1]."""
    scaled = F.least(F.greatest((F.col(sharpe) + 3) / 6, F.lit(0.0)), F.lit(1.0))
    return F.round(0.30 * F.col(accuracy) + 0.25 * F.col(auc_) + 0.25 * F.col(hit_rate) + 0.20 * scaled, 6)


#: Thresholds of walk-forward gates, then of advice (fixed values).
GATES = {"mean_accuracy": 0.55, "mean_hit_rate": 0.52}
ADVICE = {"mean_auc": 0.52}
MOST_STD = 0.08


def gates(folds_: DataFrame, by: list[str], std_is_gate: bool = False) -> DataFrame:
    """(by, criterion, value, threshold, passed, gate) of folds (accuracy, hit_rate, auc, sharpe, beat): all gates must pass."""
    mean = folds_.groupBy(*by).agg(*(F.avg(c).alias(f"mean_{c}") for c in ("accuracy", "hit_rate", "auc", "sharpe")), F.stddev_pop("accuracy").alias("std_accuracy"), F.count_if("beat").cast("double").alias("beat"), F.ceil(F.count("*") / 2).cast("double").alias("least_beat"))
    one = lambda name, value, limit, ok, gate: F.struct(F.lit(name).alias("criterion"), value.alias("value"), limit.alias("threshold"), ok.alias("passed"), F.lit(gate).alias("gate"))
    rows = [one(c, F.col(c), F.lit(x), F.col(c) >= x, True) for c, x in GATES.items()]
    rows += [one("folds_beat_benchmark", F.col("beat"), F.col("least_beat"), F.col("beat") >= F.col("least_beat"), True), one("std_accuracy", F.col("std_accuracy"), F.lit(MOST_STD), F.col("std_accuracy") <= MOST_STD, std_is_gate)]
    rows += [one(c, F.col(c), F.lit(x), F.col(c) >= x, False) for c, x in ADVICE.items()] + [one("mean_sharpe", F.col("mean_sharpe"), F.lit(0.0), F.col("mean_sharpe") > 0, False)]
    return mean.select(*by, F.inline(F.array(*rows)))


def recommended(criteria: DataFrame, by: list[str]) -> DataFrame:
    """overall, how many criteria passed, and the gates that failed."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("gate") & ~F.col("passed"), F.col("criterion")))), ", ")
    done = criteria.groupBy(*by).agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n"), failed.alias("failed"))
    return done.withColumn("overall", F.col("failed") == "")


def promotion_reasons(folds_: DataFrame, accuracy: float = 0.55, hit_rate: float = 0.52) -> DataFrame:
    """promoted and its three reasons, for each fold or experiment (accuracy, hit_rate, total_return, benchmark_return)."""
    sign = lambda ok, yes, no: F.when(ok, F.lit(yes)).otherwise(F.lit(no))
    good = [F.col("accuracy") >= accuracy, F.col("hit_rate") >= hit_rate, F.col("total_return") > F.col("benchmark_return")]
    reasons = [
        F.format_string(f"accuracy %.3f %s {accuracy}", "accuracy", sign(good[0], ">=", "<")), F.format_string(f"hit rate %.3f %s {hit_rate}", "hit_rate", sign(good[1], ">=", "<")),
        F.format_string("return %+.1f%% %s benchmark %+.1f%%", F.col("total_return") * 100, sign(good[2], "beats", "does not beat"), F.col("benchmark_return") * 100),
    ]
    return folds_.withColumns({"promoted": good[0] & good[1] & good[2], "reasons": F.array(*reasons)})


def ranked(experiments: DataFrame, metric: str, top: int | None = None, status: str | None = "completed") -> DataFrame:
    """Experiments of a status by a metric, the largest first (nulls last, ties by id), with their rank; top: only so many."""
    kept = experiments.where(F.col("status") == status) if status else experiments
    ordered = kept.orderBy(F.desc_nulls_last(metric), "experiment_id")
    ordered = ordered.limit(top) if top else ordered
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(metric), "experiment_id"))) if top else ordered


def chronological(series: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Rows with their part, train, val or test, by their share of an asset's rows in time order."""
    w = Window.partitionBy("asset")
    i, n = F.row_number().over(w.orderBy("ts")), F.count("*").over(w)
    return series.withColumn("part", F.when(i <= F.floor(n * train), "train").when(i <= F.floor(n * train) + F.floor(n * val), "val").otherwise("test"))


def dataset_version(asset: str, columns: list[str], horizon: int, threshold: float) -> Column:
    """The first twelve characters of the SHA-256 of the sorted description of a data set."""
    text = "|".join([f"asset={asset}", f"columns={','.join(sorted(columns))}", f"horizon={horizon}", f"threshold={threshold}"])
    return F.substring(F.sha2(F.lit(text), 256), 1, 12)
