"""Metrics of classifiers and of remaining-life estimates, whole or by slice, and promotion gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assethealth.functions.columns import clamp, rounded
from assethealth.operators.prefix import running_sums


def classification_metrics(rows: DataFrame, by: Sequence[str] = (), label: str = "label_failure", pred: str = "pred_failure") -> DataFrame:
    """Confusion counts, precision, recall, F1, F2, false alarm and missed detection rates, and cost 10 FN + FP."""
    y, p = F.col(label), F.col(pred)
    hit = lambda a, b: F.count_if((y == a) & (p == b))
    counts = rows.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rates = {"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "f2": over(5 * tp, 5 * tp + 4 * fn + fp), "false_alarm_rate": over(fp, fp + tn), "missed_detection_rate": over(fn, fn + tp)}
    return counts.withColumns({k: rounded(v, 4) for k, v in rates.items()}).withColumn("cost", 10 * fn + fp)


def _by_score(rows: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    return rows.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))


def roc_auc(rows: DataFrame, by: Sequence[str] = (), label: str = "label_failure", score: str = "prob_failure") -> DataFrame:
    """Exact area under the ROC curve, ties averaged, from counts by distinct score; null with one class only."""
    groups = running_sums(_by_score(rows, by, label, score).withColumn("neg", F.col("n") - F.col("pos")), "s", ["neg"], by)
    wins = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    area = F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg"))
    return groups.withColumn("wins", wins).groupBy(*by).agg(rounded(area, 4).alias("roc_auc"))


def average_precision(rows: DataFrame, by: Sequence[str] = (), label: str = "label_failure", score: str = "prob_failure") -> DataFrame:
    """Sum of precision times the gain of recall over distinct scores, highest first; null without positives."""
    groups = running_sums(_by_score(rows, by, label, score).withColumn("s", -F.col("s")), "s", ["pos", "n"], by)
    precision = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    return groups.withColumn("part", F.col("pos") * precision).groupBy(*by).agg(rounded(F.try_divide(F.sum("part"), F.sum("pos")), 4).alias("pr_auc"))


def late_penalty(error: Column) -> Column:
    """Penalty of an estimate ``error`` hours above the truth: exponential, steeper when late."""
    return F.when(error < 0, F.exp(-error / 13) - 1).otherwise(F.exp(error / 10) - 1)


def regression_metrics(rows: DataFrame, by: Sequence[str] = (), label: str = "label_rul", pred: str = "pred_rul", cap: float = 120.0) -> DataFrame:
    """RMSE, MAE, R2 (0 if all labels are equal), shares within 12 and 30 hours, mean asymmetric penalty; estimates clipped to 0..cap."""
    rows = rows.withColumn("e", clamp(F.col(pred), 0.0, cap) - F.col(label))
    mse = F.avg(F.col("e") * F.col("e"))
    spread = F.when(F.max(label) > F.min(label), F.var_pop(label))  # the variance of equal labels can be a little above 0, as parts of it are merged
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), rounded(F.sqrt(mse), 4).alias("rmse"), rounded(F.avg(F.abs("e")), 4).alias("mae"), rounded(F.coalesce(1 - F.try_divide(mse, spread), F.lit(0.0)), 4).alias("r2"),
        rounded(F.avg((F.abs("e") <= 0.1 * cap).cast("int")), 4).alias("accuracy_within_10pct"), rounded(F.avg((F.abs("e") <= 0.25 * cap).cast("int")), 4).alias("accuracy_within_25pct"),
        rounded(F.avg(late_penalty(F.col("e"))), 4).alias("asymmetric_penalty"), rounded(F.sqrt(mse) / cap, 4).alias("rmse_to_cap_ratio"),
    )


#: Least (or, for the RMSE ratio, largest) value of each metric for promotion (fixed values).
GATES = {"pr_auc": 0.70, "recall": 0.80, "roc_auc": 0.75, "r2": 0.35, "rmse_to_cap_ratio": 0.30, "accuracy_within_25pct": 0.50}


def promoted(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """CHAMPION if every metric passes its gate and the leakage audit passed, else CANDIDATE. Metrics a table lacks are not asked."""
    passes = [(F.col(k) <= v if k == "rmse_to_cap_ratio" else F.col(k) >= v) for k, v in GATES.items() if k in metrics.columns]
    ok = F.col("leakage_status") == "PASS"
    for p in passes:
        ok = ok & F.coalesce(p, F.lit(False))
    return metrics.groupBy(*by).agg(F.when(F.bool_and(ok), "CHAMPION").otherwise("CANDIDATE").alias("status"), F.count("*").alias("slices"))


def risk_tier(p: Column, rul: Column) -> Column:
    """Maintenance tier of a scored row, without a health state."""
    return F.when((p >= 0.8) | (rul <= 10), "EMERGENCY").when((p >= 0.6) | (rul <= 25), "HIGH").when((p >= 0.35) | (rul <= 50), "MEDIUM").otherwise("LOW")
