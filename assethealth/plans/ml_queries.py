"""Queries of labels, splits, audits, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assethealth.functions.columns import clamp
from assethealth.ml import data, metrics, models
from assethealth.operators import tables
from assethealth.plans.oracle import PARTS, r
from assethealth.plans.queries import R, add, c, scored
from assethealth.plans.store import stored
from assethealth.sources.scratch import scratch


def features(s: SparkSession, d: str) -> DataFrame:
    return data.feature_table(scored(s, d))


def labelled(s: SparkSession, d: str) -> DataFrame:
    """Labels with a horizon of ten steps: runs have some 67."""
    return data.labelled(features(s, d), horizon=10)


def by_run(s: SparkSession, d: str) -> DataFrame:
    return data.split_by_run(labelled(s, d))


def by_time(s: SparkSession, d: str) -> DataFrame:
    return data.split_by_time(labelled(s, d))


def predicted(s: SparkSession, d: str) -> DataFrame:
    """Predictions of the health score alone."""
    rows = labelled(s, d)
    return rows.withColumns({"prob_failure": R(clamp(1 - c("health_score")), 3), "pred_rul": R(c("health_score") * 130, 3)}).withColumn("pred_failure", (c("prob_failure") >= 0.3).cast("int"))


NAMES = {"temp": "temperature", "vib": "vibration", "pres": "pressure", "current": "current"}
W = "(PARTITION BY asset_id ORDER BY t_us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW)"
PARTS["mlfeat"] = f"""SELECT asset_id AS run_id, asset_id, asset_type, timestamp, t_us, arrival, rn - 1 AS step, operating_mode, scenario, temperature, vibration, pressure, current, voltage, power, load AS load_pct, 25e0 AS ambient_temp,
  {", ".join(f"{k}_{v} AS rolling_{k}_{n}" for n, v in NAMES.items() for k in ("mean", "std"))}, {r(f"avg(power) OVER {W}", 3)} AS rolling_mean_power, {r(f"coalesce(stddev_samp(power) OVER {W}, 0e0)", 3)} AS rolling_std_power,
  thermal_rise_rate, vibration_slope, current_ratio AS current_load_ratio, pressure_instability, health_score FROM scored"""
PARTS["mllabel"] = f"""SELECT *, {r("CASE WHEN scenario IN (1, 6) THEN 120e0 ELSE least(120e0, (n - 1 - step) / n * 120) END", 4)} AS label_rul, CASE WHEN scenario NOT IN (1, 6) AND step >= greatest(0, n - 11) THEN 1 ELSE 0 END AS label_failure
FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM mlfeat)"""
PARTS["runs"] = "SELECT run_id, row_number() OVER (ORDER BY md5(run_id), run_id) AS place, count(*) OVER () AS total FROM (SELECT DISTINCT run_id FROM mllabel)"
PARTS["runsplit"] = "SELECT run_id, CASE WHEN place <= round_even(total * 7e-1, 0) THEN 'train' WHEN place <= round_even(total * 7e-1, 0) + round_even(total * 15e-2, 0) THEN 'validation' ELSE 'test' END AS split FROM runs"
PARTS["mlrun"] = "SELECT l.*, split FROM mllabel l JOIN runsplit USING (run_id)"
PARTS["mltime"] = "SELECT *, CASE WHEN step < floor(n * 7e-1) THEN 'train' WHEN step < floor(n * 85e-2) THEN 'validation' ELSE 'test' END AS split FROM mllabel"
PARTS["mlpred"] = f"SELECT *, CASE WHEN prob_failure >= 3e-1 THEN 1 ELSE 0 END AS pred_failure FROM (SELECT *, {r('greatest(0e0, least(1e0, 1 - health_score))', 3)} AS prob_failure, {r('health_score * 130', 3)} AS pred_rul FROM mllabel)"
PARTS["weights"] = "SELECT coalesce(n / nullif(2 * (n - p), 0), 1e0) AS w0, coalesce(n / nullif(2 * p, 0), 1e0) AS w1 FROM (SELECT count(*) AS n, sum(label_failure) AS p FROM mlrun WHERE split = 'train')"

KEPT = ["run_id", "step", *data.FEATURES]
add("m1_trajectory_features", lambda s, d: features(s, d).select(*KEPT), f"SELECT {', '.join(KEPT)} FROM mlfeat")
add("m2_has_failure", lambda s, d: features(s, d).select("run_id", data.has_failure(c("scenario")).alias("has_failure")).distinct(), "SELECT DISTINCT run_id, scenario NOT IN (1, 6) AS has_failure FROM mlfeat")
add("m3_remaining_life", lambda s, d: labelled(s, d).select("run_id", "step", "label_rul"), "SELECT run_id, step, label_rul FROM mllabel")
add("m4_failure_label", lambda s, d: labelled(s, d).select("run_id", "step", "label_failure"), "SELECT run_id, step, label_failure FROM mllabel")
add("m5_feature_isolation", lambda s, d: data.features_only(features(s, d)), f"SELECT {', '.join(data.FEATURES)} FROM mlfeat")
add("m6_split_by_run", lambda s, d: by_run(s, d).select("run_id", "split").distinct(), "SELECT run_id, split FROM runsplit")
add("m6_split_by_run_seeded", lambda s, d: data.split_by_run(labelled(s, d), seed=42).select("run_id", "split").distinct(), "SELECT run_id, CASE WHEN place <= round_even(total * 7e-1, 0) THEN 'train' WHEN place <= round_even(total * 7e-1, 0) + round_even(total * 15e-2, 0) THEN 'validation' ELSE 'test' END AS split FROM (SELECT run_id, row_number() OVER (ORDER BY md5('42:' || run_id), run_id) AS place, count(*) OVER () AS total FROM (SELECT DISTINCT run_id FROM mllabel))")
add("m7_split_by_time", lambda s, d: by_time(s, d).select("run_id", "step", "split"), "SELECT run_id, step, split FROM mltime")
add("m8_class_weights", lambda s, d: data.class_weights(by_run(s, d)).select(R(c("w0"), 6).alias("w0"), R(c("w1"), 6).alias("w1")), f"SELECT {r('w0', 6)} AS w0, {r('w1', 6)} AS w1 FROM weights")
add("m9_sample_weights", lambda s, d: data.with_weights(by_run(s, d)).select("run_id", "step", "sample_weight"), f"SELECT run_id, step, {r('CASE WHEN label_failure = 1 THEN w1 ELSE w0 END', 6)} AS sample_weight FROM mlrun CROSS JOIN weights")
add("m11_temporal_order", lambda s, d: data.order_violations(by_time(s, d).withColumn("timestamp", F.when(c("arrival") % 997 == 0, c("timestamp") - 60).otherwise(c("timestamp")))),
    "SELECT run_id, count(*) FILTER (WHERE back) AS backwards, coalesce(max(CASE WHEN split = 'train' THEN ts END) > min(CASE WHEN split = 'validation' THEN ts END), FALSE) OR coalesce(max(CASE WHEN split = 'validation' THEN ts END) > min(CASE WHEN split = 'test' THEN ts END), FALSE) AS overlapping "
    "FROM (SELECT *, ts < lag(ts) OVER (PARTITION BY run_id ORDER BY step) AS back FROM (SELECT *, CASE WHEN arrival % 997 = 0 THEN timestamp - 60 ELSE timestamp END AS ts FROM mltime)) GROUP BY run_id HAVING backwards > 0 OR overlapping")  # fmt: skip
SOME = ("temperature", "vibration", "pressure", "voltage", "thermal_rise_rate", "health_score")
add("m12_label_correlation", lambda s, d: data.label_correlations(labelled(s, d), "label_failure", SOME),
    " UNION ALL ".join(f"SELECT '{f}' AS feature, x AS correlation, x >= 999e-3 AS flagged FROM (SELECT {r(f'coalesce(CASE WHEN stddev_pop({f}) > 1e-6 AND stddev_pop(label_failure) > 1e-6 THEN abs(corr({f}, label_failure)) END, 0e0)', 6)} AS x FROM mllabel)" for f in SOME))
LEAK = "label_failure * 2 + temperature * 1e-9"


def audited(names: tuple[str, ...], leak: str | None = None) -> str:
    """Names that hold a target's name, runs out of order, and features that go with the label."""
    values = {n: leak if n not in SOME else n for n in names}
    bad = " + ".join(" OR ".join(f"contains(lower('{n}'), '{f}')" for f in data.FORBIDDEN).join(("CAST(", " AS INTEGER)")) for n in names)
    found = " + ".join(f"CAST(coalesce(abs(corr({v}, label_failure)) >= 999e-3 AND stddev_pop({v}) > 1e-6 AND stddev_pop(label_failure) > 1e-6, FALSE) AS INTEGER)" for v in values.values())
    order = "SELECT count(*) FROM (SELECT run_id FROM (SELECT *, timestamp < lag(timestamp) OVER (PARTITION BY run_id ORDER BY step) AS back FROM mltime) GROUP BY run_id HAVING coalesce(bool_or(back), FALSE) OR coalesce(max(timestamp) FILTER (WHERE split = 'train') > min(timestamp) FILTER (WHERE split = 'validation'), FALSE) OR coalesce(max(timestamp) FILTER (WHERE split = 'validation') > min(timestamp) FILTER (WHERE split = 'test'), FALSE))"
    checks = {"feature_whitelist": f"SELECT CAST({bad} AS BIGINT)", "temporal_ordering": order, "label_correlation": f"SELECT CAST({found} AS BIGINT) FROM mltime"}
    return " UNION ALL ".join(f"SELECT '{k}' AS check_name, CASE WHEN found = 0 THEN 'PASS' ELSE 'FAIL' END AS status, found FROM ({v}) x(found)" for k, v in checks.items())


add("m13_leakage_audit", lambda s, d: data.leakage_audit(by_time(s, d), SOME), audited(SOME))
add("m13_leaking_audit", lambda s, d: data.leakage_audit(by_time(s, d).withColumn("leak", F.expr(LEAK)), (*SOME, "leak")), audited((*SOME, "leak"), LEAK))
NULLS = " + ".join(f"count(*) FILTER (WHERE {f} IS NULL)" for f in data.FEATURES)
add("m14_dataset_summary", lambda s, d: data.dataset_summary(labelled(s, d)),
    f"SELECT count(*) AS total_rows, count(DISTINCT run_id) AS runs, count(DISTINCT asset_id) AS assets, count(DISTINCT asset_type) AS asset_types, {r('avg(label_failure)', 6)} AS failure_prevalence, {NULLS} AS null_values, min(label_rul) AS min_rul, max(label_rul) AS max_rul, {r('avg(label_rul)', 4)} AS mean_rul, {r('quantile_cont(label_rul, 5e-1)', 4)} AS median_rul, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM mllabel")
add("m15_label_integrity", lambda s, d: data.label_integrity(labelled(s, d)), "SELECT bool_and(label_rul BETWEEN 0 AND 120) AS rul_in_range, bool_and(label_failure IN (0, 1)) AS labels_binary FROM mllabel")
add("m16_split_disjointness", lambda s, d: data.split_disjointness(by_time(s, d)), "SELECT count(*) AS runs, count(*) FILTER (WHERE k > 1) AS shared_runs FROM (SELECT run_id, count(DISTINCT split) AS k FROM mltime GROUP BY run_id)")
add("m17_split_statistics", lambda s, d: data.split_statistics(by_run(s, d)), f"SELECT split, count(*) AS n, CAST(sum(label_failure) AS BIGINT) AS positives, {r('avg(label_failure)', 6)} AS prevalence, {r('count(*) / sum(count(*)) OVER ()', 6)} AS ratio FROM mlrun GROUP BY split")


def confusion(by: str = "") -> str:
    head = f"{by}, " if by else ""
    rate = lambda a, b, name: f"{r(f'coalesce(({a}) / nullif({b}, 0), 0e0)', 4)} AS {name}"
    parts = [rate("tp", "tp + fp", "precision"), rate("tp", "tp + fn", "recall"), rate("2 * tp", "2 * tp + fp + fn", "f1"), rate("5 * tp", "5 * tp + 4 * fn + fp", "f2"), rate("fp", "fp + tn", "false_alarm_rate"), rate("fn", "fn + tp", "missed_detection_rate")]
    count = lambda y, p: f"count(*) FILTER (WHERE label_failure = {y} AND pred_failure = {p})"
    return f"SELECT {head}tp, fp, tn, fn, {', '.join(parts)}, 10 * fn + fp AS cost FROM (SELECT {head}{count(1, 1)} AS tp, {count(0, 1)} AS fp, {count(0, 0)} AS tn, {count(1, 0)} AS fn FROM mlpred {f'GROUP BY {by}' if by else ''})"


def regression(by: str = "") -> str:
    head = f"{by}, " if by else ""
    return f"""SELECT {head}count(*) AS n, {r("sqrt(avg(e * e))", 4)} AS rmse, {r("avg(abs(e))", 4)} AS mae, {r("coalesce(1 - avg(e * e) / nullif(var_pop(label_rul), 0), 0e0)", 4)} AS r2, {r("avg(CASE WHEN abs(e) <= 12 THEN 1 ELSE 0 END)", 4)} AS accuracy_within_10pct,
      {r("avg(CASE WHEN abs(e) <= 30 THEN 1 ELSE 0 END)", 4)} AS accuracy_within_25pct, {r("avg(CASE WHEN e < 0 THEN exp(-e / 13) - 1 ELSE exp(e / 10) - 1 END)", 4)} AS asymmetric_penalty, {r("sqrt(avg(e * e)) / 120", 4)} AS rmse_to_cap_ratio
      FROM (SELECT *, greatest(0e0, least(120e0, pred_rul)) - label_rul AS e FROM mlpred) {f"GROUP BY {by}" if by else ""}"""


PARTS["byscore"] = "SELECT asset_type, prob_failure AS s, count(*) AS n, sum(label_failure) AS pos FROM mlpred GROUP BY 1, 2"
PARTS["allscore"] = "SELECT prob_failure AS s, count(*) AS n, sum(label_failure) AS pos FROM mlpred GROUP BY 1"
AUC = "SELECT {h}" + r("sum(pos * (coalesce(below, 0) + (n - pos) / 2)) / nullif(sum(pos) * sum(n - pos), 0)", 4) + " AS roc_auc FROM (SELECT *, sum(n - pos) OVER ({p}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM {t}) {g}"
AP = "SELECT {h}" + r("sum(pos * p) / nullif(sum(pos), 0)", 4) + " AS pr_auc FROM (SELECT *, sum(pos) OVER w / sum(n) OVER w AS p FROM {t} WINDOW w AS ({p}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) {g}"
WHOLE = {"h": "", "p": "", "t": "allscore", "g": ""}
SLICE = {"h": "asset_type, ", "p": "PARTITION BY asset_type ", "t": "byscore", "g": "GROUP BY asset_type"}
add("m21_classification_metrics", lambda s, d: metrics.classification_metrics(predicted(s, d)), confusion())
add("m22_roc_auc", lambda s, d: metrics.roc_auc(predicted(s, d)), AUC.format(**WHOLE))
add("m23_average_precision", lambda s, d: metrics.average_precision(predicted(s, d)), AP.format(**WHOLE))
add("m24_regression_metrics", lambda s, d: metrics.regression_metrics(predicted(s, d)), regression())
add("m25_asymmetric_penalty", lambda s, d: predicted(s, d).groupBy("scenario").agg(R(F.avg(metrics.late_penalty(clamp(c("pred_rul"), 0.0, 120.0) - c("label_rul"))), 4).alias("penalty")),
    f"SELECT scenario, {r('avg(CASE WHEN e < 0 THEN exp(-e / 13) - 1 ELSE exp(e / 10) - 1 END)', 4)} AS penalty FROM (SELECT *, greatest(0e0, least(120e0, pred_rul)) - label_rul AS e FROM mlpred) GROUP BY scenario")
add("m26_metrics_by_type", lambda s, d: metrics.classification_metrics(predicted(s, d), ["asset_type"]), confusion("asset_type"))
add("m26_metrics_by_scenario", lambda s, d: metrics.regression_metrics(predicted(s, d), ["scenario"]), regression("scenario"))


def experiment_record(s: SparkSession, d: str) -> DataFrame:
    """An experiment's metrics by asset type, recorded once though written twice."""
    path = scratch(s, "experiments")
    rows = metrics.regression_metrics(predicted(s, d), ["asset_type"]).withColumn("experiment_id", F.lit("heuristic"))
    for _ in range(2):
        tables.append_once(rows, path, 0)
    return s.read.parquet(path).drop("batch_id")


add("u12_experiment_record", experiment_record, f"SELECT 'heuristic' AS experiment_id, * FROM ({regression('asset_type')})")


def model_rows(s: SparkSession, d: str) -> DataFrame:
    """One row of metrics an asset type: the heuristic as a model, by slice."""
    rows = predicted(s, d)
    by = ["asset_type"]
    out = metrics.classification_metrics(rows, by).select("asset_type", "recall")
    for other in (metrics.roc_auc(rows, by), metrics.average_precision(rows, by), metrics.regression_metrics(rows, by).select("asset_type", "r2", "rmse_to_cap_ratio", "accuracy_within_25pct")):
        out = out.join(other, "asset_type")
    return out.withColumn("leakage_status", F.lit("PASS"))


add("m29_promotion_gates", lambda s, d: metrics.promoted(model_rows(s, d), ["asset_type"]),
    f"SELECT asset_type, CASE WHEN recall >= 8e-1 AND coalesce(roc_auc >= 75e-2, FALSE) AND coalesce(pr_auc >= 7e-1, FALSE) AND r2 >= 35e-2 AND rmse_to_cap_ratio <= 3e-1 AND accuracy_within_25pct >= 5e-1 THEN 'CHAMPION' ELSE 'CANDIDATE' END AS status, 1 AS slices "
    f"FROM ({confusion('asset_type')}) JOIN ({AUC.format(**SLICE)}) USING (asset_type) JOIN ({AP.format(**SLICE)}) USING (asset_type) JOIN ({regression('asset_type')}) USING (asset_type)")  # fmt: skip
add("m30_risk_tiers", lambda s, d: predicted(s, d).groupBy(metrics.risk_tier(c("prob_failure"), c("pred_rul")).alias("tier")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN prob_failure >= 8e-1 OR pred_rul <= 10 THEN 'EMERGENCY' WHEN prob_failure >= 6e-1 OR pred_rul <= 25 THEN 'HIGH' WHEN prob_failure >= 35e-2 OR pred_rul <= 50 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS n FROM mlpred GROUP BY 1")


def training(s: SparkSession, d: str) -> DataFrame:
    return data.with_weights(by_run(s, d))


# models go over their rows many times
stored_training = stored("training", training)


def fitted_risk(name: str) -> object:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = stored_training(s, d)
        model = models.fit(rows.where("split = 'train'"), models.classifier(name))
        return models.with_failure_risk(rows.where("split = 'test'"), model).select("run_id", "step", "label_failure", "pred_failure", "prob_failure")

    return run


def fitted_life(name: str) -> object:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = stored_training(s, d)
        model = models.fit(rows.where("split = 'train'"), models.regressor(name))
        return models.with_remaining_life(rows.where("split = 'test'"), model).select("run_id", "step", "label_rul", "pred_rul")

    return run


def scored_batch(s: SparkSession, d: str) -> DataFrame:
    rows = stored_training(s, d)
    train = rows.where("split = 'train'")
    risk, life = models.fit(train, models.classifier("forest")), models.fit(train, models.regressor("forest"))
    return models.scored(rows.where("split = 'test'"), risk, life).select("run_id", "step", "prob_failure", "pred_failure", "pred_rul", "maintenance_priority", F.to_json("top_features").alias("top_features"))


for kind in ("logistic", "forest", "boosted"):
    add(f"m19_{kind}_classifier", fitted_risk(kind))
for kind in ("linear", "forest", "boosted"):
    add(f"m20_{kind}_regressor", fitted_life(kind))
add("m30_batch_scoring", scored_batch)
