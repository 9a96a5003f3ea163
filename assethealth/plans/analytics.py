"""The analytical, dashboard and demo queries over the serving tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assethealth.functions.columns import rul_horizon
from assethealth.operators import sketches
from assethealth.plans.oracle import r
from assethealth.plans.queries import HORIZON, ORDERS, R, add, c, pick, table
from assethealth.plans.queries import stored_alerts as alert_history
from assethealth.plans.queries import stored_current as current
from assethealth.plans.queries import stored_history as history
from assethealth.plans.queries import stored_queue as queue
from assethealth.plans.queries import stored_snapshots as snapshots
from assethealth.sources.scratch import scratch

EACH = "asset_current_state"


def mean(x: str, digits: int, name: str) -> Column:
    return R(F.avg(x), digits).alias(name)


def means(**columns: tuple[str, int]) -> list[Column]:
    return [mean(x, n, name) for name, (x, n) in columns.items()]


def mean_sql(**columns: tuple[str, int]) -> str:
    return ", ".join(f"{r(f'avg({x})', n)} AS {name}" for name, (x, n) in columns.items())


def places(**digits: int) -> list[Column]:
    """Columns to so many places."""
    return [R(F.col(k), n).alias(k) for k, n in digits.items()]


def places_sql(**digits: int) -> str:
    return ", ".join(f"{r(k, n)} AS {k}" for k, n in digits.items())


def percent(condition: Column) -> Column:
    return R(F.try_divide(100.0 * F.count_if(condition), F.count("*")), 2)


# fleet health
by_state = ("healthy", "watch", "degraded", "critical")
add("b1_fleet_health", lambda s, d: current(s, d).agg(F.count("*").alias("total_assets"), mean("health_score", 4, "fleet_avg_health_score"), *[F.count_if(c("health_state") == x.upper()).alias(f"{x}_count") for x in by_state], percent(c("health_state") == "HEALTHY").alias("healthy_percentage")),
    f"SELECT count(*) AS total_assets, {mean_sql(fleet_avg_health_score=('health_score', 4))}, " + ", ".join(f"count(*) FILTER (WHERE health_state = '{x.upper()}') AS {x}_count" for x in by_state)
    + ", " + r("100e0 * count(*) FILTER (WHERE health_state = 'HEALTHY') / nullif(count(*), 0)", 2) + f" AS healthy_percentage FROM {EACH}")
add("b2_health_by_type_and_mode", lambda s, d: current(s, d).groupBy("asset_type", "operating_mode").agg(F.count("*").alias("asset_count"), mean("health_score", 4, "avg_health_score"), R(F.min("health_score"), 4).alias("min_health_score"), R(F.max("health_score"), 4).alias("max_health_score"), F.count_if(c("health_state").isin("DEGRADED", "CRITICAL")).alias("at_risk_count")).orderBy("avg_health_score", F.desc("asset_count")),
    f"SELECT asset_type, operating_mode, count(*) AS asset_count, {r('avg(health_score)', 4)} AS avg_health_score, {r('min(health_score)', 4)} AS min_health_score, {r('max(health_score)', 4)} AS max_health_score, count(*) FILTER (WHERE health_state IN ('DEGRADED', 'CRITICAL')) AS at_risk_count FROM {EACH} GROUP BY asset_type, operating_mode")
add("b3_at_risk_assets", lambda s, d: pick(s, d, current, "asset_id", "asset_type", "operating_mode", "health_state", *places(health_score=3, failure_probability=3, predicted_rul_hours=1), "maintenance_priority", R(c("temperature"), 1).alias("temp_c"), R(c("vibration"), 2).alias("vibration_mms"), R(c("pressure"), 1).alias("pressure_bar"), "last_event_time",
    where=c("health_state").isin("WATCH", "DEGRADED", "CRITICAL"), order=("health_score", F.desc("failure_probability"))),
    f"SELECT asset_id, asset_type, operating_mode, health_state, {places_sql(health_score=3, failure_probability=3, predicted_rul_hours=1)}, maintenance_priority, {r('temperature', 1)} AS temp_c, {r('vibration', 2)} AS vibration_mms, {r('pressure', 1)} AS pressure_bar, last_event_time FROM {EACH} WHERE health_state <> 'HEALTHY'")
# predictive maintenance
add("b4_high_failure_risk", lambda s, d: pick(s, d, current, "asset_id", "asset_type", "operating_mode", *places(failure_probability=4, predicted_rul_hours=1), "health_state", "maintenance_priority", "model_version", "last_prediction_time", where="failure_probability >= 0.5D", order=(F.desc("failure_probability"), "predicted_rul_hours")),
    f"SELECT asset_id, asset_type, operating_mode, {places_sql(failure_probability=4, predicted_rul_hours=1)}, health_state, maintenance_priority, model_version, last_prediction_time FROM {EACH} WHERE failure_probability >= 5e-1")
add("b5_rul_horizons", lambda s, d: current(s, d).groupBy(rul_horizon(c("predicted_rul_hours")).alias("rul_horizon")).agg(F.count("*").alias("asset_count"), *means(avg_health_score=("health_score", 4), avg_failure_probability=("failure_probability", 4)), R(F.min("predicted_rul_hours"), 1).alias("min_rul_hours"), R(F.max("predicted_rul_hours"), 1).alias("max_rul_hours")).orderBy("min_rul_hours"),
    f"SELECT {HORIZON} AS rul_horizon, count(*) AS asset_count, {mean_sql(avg_health_score=('health_score', 4), avg_failure_probability=('failure_probability', 4))}, {r('min(predicted_rul_hours)', 1)} AS min_rul_hours, {r('max(predicted_rul_hours)', 1)} AS max_rul_hours FROM {EACH} GROUP BY 1")
add("b6_priority_queue", lambda s, d: pick(s, d, queue, "ranking", "asset_id", "asset_type", "criticality", "health_state", "maintenance_priority", "priority_score", *places(health_score=3, failure_probability=3, predicted_rul_hours=1), "recommended_action", "evaluated_at", order=("ranking",)),
    f"SELECT ranking, asset_id, asset_type, criticality, health_state, maintenance_priority, priority_score, {places_sql(health_score=3, failure_probability=3, predicted_rul_hours=1)}, recommended_action, evaluated_at FROM maintenance_priority_queue")
# asset performance
LOADS = {"avg_load_pct": ("load", 2), "avg_temp_c": ("temperature", 2), "avg_vibration_mms": ("vibration", 3), "avg_pressure_bar": ("pressure", 2), "avg_rpm": ("rpm", 1), "avg_power_kw": ("power", 2), "avg_health_score": ("health_score", 3)}
add("b7_mode_loads", lambda s, d: current(s, d).groupBy("operating_mode").agg(F.count("*").alias("total_samples"), *means(**LOADS)).orderBy(F.desc("avg_load_pct")), f"SELECT operating_mode, count(*) AS total_samples, {mean_sql(**LOADS)} FROM {EACH} GROUP BY operating_mode")
add("b8_anomalous_assets", lambda s, d: pick(s, d, current, "asset_id", "asset_type", "operating_mode", "anomaly_level", "active_alert_count", "health_state", *places(health_score=3, temperature=1, vibration=2, pressure=1), where="anomaly_level > 0 OR active_alert_count > 0 OR health_state <> 'HEALTHY'", order=(F.desc("anomaly_level"), F.desc("active_alert_count"), "health_score")),
    f"SELECT asset_id, asset_type, operating_mode, anomaly_level, active_alert_count, health_state, {places_sql(health_score=3, temperature=1, vibration=2, pressure=1)} FROM {EACH} WHERE anomaly_level > 0 OR active_alert_count > 0 OR health_state <> 'HEALTHY'")


def fleet_outliers(s: SparkSession, d: str) -> DataFrame:
    rows = current(s, d)
    fleet = rows.agg(*[f(x).alias(f"{n}_{x}") for x in ("temperature", "vibration") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])  # one row
    away = lambda x: c(x) - c(f"mean_{x}")
    std = lambda x: F.nullif(c(f"std_{x}"), F.lit(0.0))
    far = lambda x: F.abs(away(x)) > 1.5 * F.coalesce(std(x), F.lit(1.0))
    out = rows.crossJoin(F.broadcast(fleet)).where(far("temperature") | far("vibration")).orderBy(F.desc(F.abs(away("temperature"))))
    return out.select("asset_id", "asset_type", R(c("temperature"), 1).alias("temp_c"), R(c("mean_temperature"), 1).alias("fleet_avg_temp"), R(away("temperature") / std("temperature"), 2).alias("temp_zscore"), R(c("vibration"), 2).alias("vib_mms"), R(c("mean_vibration"), 2).alias("fleet_avg_vib"), R(away("vibration") / std("vibration"), 2).alias("vib_zscore"))


add("b9_fleet_outliers", fleet_outliers,
    f"SELECT asset_id, asset_type, {r('temperature', 1)} AS temp_c, {r('mt', 1)} AS fleet_avg_temp, {r('(temperature - mt) / nullif(st, 0)', 2)} AS temp_zscore, {r('vibration', 2)} AS vib_mms, {r('mv', 2)} AS fleet_avg_vib, {r('(vibration - mv) / nullif(sv, 0)', 2)} AS vib_zscore "
    f"FROM {EACH}, (SELECT avg(temperature) AS mt, stddev_samp(temperature) AS st, avg(vibration) AS mv, stddev_samp(vibration) AS sv FROM {EACH}) WHERE abs(temperature - mt) > 15e-1 * coalesce(nullif(st, 0), 1e0) OR abs(vibration - mv) > 15e-1 * coalesce(nullif(sv, 0), 1e0)")  # fmt: skip
# across assets
TYPE_MEANS = {"mean_health": ("health_score", 4), "mean_fail_prob": ("failure_probability", 4), "mean_rul_hours": ("predicted_rul_hours", 1), "mean_temp": ("temperature", 2), "mean_vib": ("vibration", 3), "mean_power": ("power", 2)}
add("b10_type_statistics", lambda s, d: current(s, d).groupBy("asset_type").agg(F.count("*").alias("total_units"), *means(**TYPE_MEANS), R(F.min("health_score"), 4).alias("min_health"), R(F.max("health_score"), 4).alias("max_health")).orderBy("mean_health"),
    f"SELECT asset_type, count(*) AS total_units, {mean_sql(**TYPE_MEANS)}, {r('min(health_score)', 4)} AS min_health, {r('max(health_score)', 4)} AS max_health FROM {EACH} GROUP BY asset_type")


def cohort_reliability(s: SparkSession, d: str) -> DataFrame:
    rows = current(s, d)
    cohort = rows.groupBy("asset_type").agg(F.avg("health_score").alias("h"), F.avg("failure_probability").alias("p"))
    out = rows.join(cohort, "asset_type")
    return out.select("asset_id", "asset_type", R(c("health_score"), 3).alias("asset_health"), R(c("h"), 3).alias("cohort_avg_health"), R(c("health_score") - c("h"), 3).alias("health_delta_from_cohort"), R(c("failure_probability"), 3).alias("asset_failure_prob"), R(c("failure_probability") - c("p"), 3).alias("fail_prob_delta_from_cohort"), "health_state").orderBy("health_delta_from_cohort")


add("b11_cohort_reliability", cohort_reliability,
    f"SELECT asset_id, asset_type, {r('health_score', 3)} AS asset_health, {r('h', 3)} AS cohort_avg_health, {r('health_score - h', 3)} AS health_delta_from_cohort, {r('failure_probability', 3)} AS asset_failure_prob, {r('failure_probability - p', 3)} AS fail_prob_delta_from_cohort, health_state "
    f"FROM {EACH} JOIN (SELECT asset_type, avg(health_score) AS h, avg(failure_probability) AS p FROM {EACH} GROUP BY asset_type) USING (asset_type)")  # fmt: skip
SPREADS = {"var_temp": ("temperature", 2), "var_vib": ("vibration", 4), "var_pressure": ("pressure", 2), "var_health": ("health_score", 4)}
add("b12_variance_by_type", lambda s, d: current(s, d).groupBy("asset_type").agg(*[R(F.var_samp(x), n).alias(k) for k, (x, n) in SPREADS.items()]), "SELECT asset_type, " + ", ".join(f"{r(f'var_samp({x})', n)} AS {k}" for k, (x, n) in SPREADS.items()) + f" FROM {EACH} GROUP BY asset_type")
# scenarios
LEVELS = {"Conservative (Risk >= 0.35)": 0.35, "Nominal (Risk >= 0.50)": 0.5, "Aggressive (Risk >= 0.75)": 0.75}


def threshold_sensitivity(s: SparkSession, d: str) -> DataFrame:
    """One scan: each row meets the three thresholds."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario_name"), F.lit(v).alias("least")) for k, v in LEVELS.items()]))
    rows = current(s, d).select("failure_probability", levels.alias("l")).select("failure_probability", "l.*")
    over = c("failure_probability") >= c("least")
    return rows.groupBy("scenario_name").agg(F.count_if(over).alias("triggered_work_orders"), percent(over).alias("fleet_pct_affected"), F.sum(F.when(over, 1500.0).otherwise(0.0)).alias("estimated_cost_usd"))


add("b13_threshold_sensitivity", threshold_sensitivity, " UNION ALL ".join(f"SELECT '{k}' AS scenario_name, count(*) FILTER (WHERE failure_probability >= {v}) AS triggered_work_orders, {r(f'100e0 * count(*) FILTER (WHERE failure_probability >= {v}) / nullif(count(*), 0)', 2)} AS fleet_pct_affected, 1500e0 * count(*) FILTER (WHERE failure_probability >= {v}) AS estimated_cost_usd FROM {EACH}" for k, v in LEVELS.items()))


def repair_top3(s: SparkSession, d: str) -> DataFrame:
    rows = queue(s, d).select("asset_id", "health_score", F.when(c("ranking") <= 3, 1.0).otherwise(c("health_score")).alias("then"))
    return rows.agg(*means(baseline_fleet_health=("health_score", 4), projected_fleet_health_after_top3_repairs=("then", 4)), R(F.avg("then") - F.avg("health_score"), 4).alias("health_score_improvement"))


add("b14_repair_top3", repair_top3, f"SELECT {mean_sql(baseline_fleet_health=('health_score', 4), projected_fleet_health_after_top3_repairs=('later', 4))}, {r('avg(later) - avg(health_score)', 4)} AS health_score_improvement FROM (SELECT a.health_score, CASE WHEN t.asset_id IS NULL THEN a.health_score ELSE 1e0 END AS later FROM {EACH} a LEFT JOIN (SELECT asset_id FROM maintenance_priority_queue ORDER BY ranking LIMIT 3) t USING (asset_id))")
add("b15_accelerated_wear", lambda s, d: pick(s, d, current, "asset_id", "asset_type", R(c("predicted_rul_hours"), 1).alias("nominal_rul_hours"), R(c("predicted_rul_hours") / 1.5, 1).alias("stress_scenario_rul_hours"), F.when(c("predicted_rul_hours") / 1.5 < 24, "CRITICAL INTERVENTION NEEDED").otherwise("MANAGEABLE BUFFER").alias("operational_recommendation"), order=("predicted_rul_hours",)),
    f"SELECT asset_id, asset_type, {r('predicted_rul_hours', 1)} AS nominal_rul_hours, {r('predicted_rul_hours / 15e-1', 1)} AS stress_scenario_rul_hours, CASE WHEN predicted_rul_hours / 15e-1 < 24 THEN 'CRITICAL INTERVENTION NEEDED' ELSE 'MANAGEABLE BUFFER' END AS operational_recommendation FROM {EACH}")
# over time
add("b16_rul_decay", lambda s, d: history(s, d).groupBy("asset_id", F.date_trunc("minute", "event_time").alias("time_window")).agg(*means(avg_failure_probability=("failure_probability", 4), avg_rul_hours=("predicted_rul_hours", 1)), F.count("*").alias("prediction_events")).orderBy("time_window", "asset_id"),
    f"SELECT asset_id, date_trunc('minute', event_time) AS time_window, {mean_sql(avg_failure_probability=('failure_probability', 4), avg_rul_hours=('predicted_rul_hours', 1))}, count(*) AS prediction_events FROM asset_prediction_history GROUP BY 1, 2")
add("b17_alert_velocity", lambda s, d: alert_history(s, d).groupBy("severity").agg(F.count("*").alias("total_alerts"), F.count_distinct("asset_id").alias("distinct_assets_affected"), F.min("event_time").alias("first_alert_time"), F.max("event_time").alias("latest_alert_time")).orderBy(F.desc("total_alerts")),
    "SELECT severity, count(*) AS total_alerts, count(DISTINCT asset_id) AS distinct_assets_affected, min(event_time) AS first_alert_time, max(event_time) AS latest_alert_time FROM asset_alert_history GROUP BY severity")


def sketched_velocity(s: SparkSession, d: str) -> DataFrame:
    """Alerts and assets by severity, exactly and from sketches stored a minute of alerts each and merged; whether the two differ by 3 % at most."""
    path, rows = scratch(s, "alert-sketches"), alert_history(s, d).withColumn("minute", F.date_trunc("minute", "event_time"))
    sketches.sketched(rows, "asset_id", ("severity", "minute")).write.parquet(path)
    merged = sketches.merged(s.read.parquet(path), ("severity",))
    exact = rows.groupBy("severity").agg(F.count_distinct("asset_id").alias("distinct_assets_affected"))
    near = F.abs(c("distinct") - c("distinct_assets_affected")) <= 0.03 * c("distinct_assets_affected")
    return merged.join(exact, "severity").select("severity", c("rows").alias("total_alerts"), "distinct_assets_affected", near.alias("estimate_is_near"))


add("b17_sketched_velocity", sketched_velocity,
    "SELECT severity, count(*) AS total_alerts, count(DISTINCT asset_id) AS distinct_assets_affected, TRUE AS estimate_is_near FROM asset_alert_history GROUP BY severity")
TREND = ["timestamp", "total_assets", "healthy_assets", "critical_assets", "high_risk_assets"]
add("b18_kpi_trend", lambda s, d: pick(s, d, snapshots, *TREND, *places(fleet_health_score=4, avg_predicted_rul_hours=1), "active_alerts_total", order=("timestamp",)), f"SELECT {', '.join(TREND)}, {places_sql(fleet_health_score=4, avg_predicted_rul_hours=1)}, active_alerts_total FROM fleet_kpi_snapshots")
LATEST = ["total_assets", "healthy_assets", "watch_assets", "degraded_assets", "critical_assets", "high_risk_assets", "near_failure_assets", "active_alerts_total", "emergency_maintenance_count", "high_maintenance_count"]
NEWEST = "FROM fleet_kpi_snapshots ORDER BY timestamp DESC LIMIT 1"
add("b19_latest_kpis", lambda s, d: pick(s, d, snapshots, *LATEST, *places(fleet_health_score=4, avg_predicted_rul_hours=1, failure_risk_rate=4), c("timestamp").alias("snapshot_time"), order=(F.desc("timestamp"),), limit=1), f"SELECT {', '.join(LATEST)}, {places_sql(fleet_health_score=4, avg_predicted_rul_hours=1, failure_risk_rate=4)}, timestamp AS snapshot_time {NEWEST}")
add("b20_asset_ranking", lambda s, d: pick(s, d, current, "asset_id", "asset_type", "operating_mode", "health_state", *places(health_score=3, temperature=1, vibration=2, pressure=1, load=1, rpm=0), order=("health_score",)), f"SELECT asset_id, asset_type, operating_mode, health_state, {places_sql(health_score=3, temperature=1, vibration=2, pressure=1, load=1, rpm=0)} FROM {EACH}")
add("b21_work_order_ranking", lambda s, d: pick(s, d, queue, "ranking", "asset_id", "maintenance_priority", "priority_score", *places(health_score=3, failure_probability=3, predicted_rul_hours=1), "recommended_action", order=("ranking",)), f"SELECT ranking, asset_id, maintenance_priority, priority_score, {places_sql(health_score=3, failure_probability=3, predicted_rul_hours=1)}, recommended_action FROM maintenance_priority_queue")

# dashboards
for n, x in enumerate(("total_assets", "healthy_assets", "critical_assets", "high_risk_assets", "avg_predicted_rul_hours", "active_alerts_total", "fleet_health_score"), 1):
    add(f"d{n}_{x}", lambda s, d, x=x: pick(s, d, snapshots, x, order=(F.desc("timestamp"),), limit=1), f"SELECT {x} {NEWEST}")
add("d8_state_breakdown", lambda s, d: pick(s, d, snapshots, *[c(f"{x}_assets").alias(x.upper()) for x in by_state], order=(F.desc("timestamp"),), limit=1), "SELECT " + ", ".join(f'{x}_assets AS "{x.upper()}"' for x in by_state) + f" {NEWEST}")
REGISTRY = ["asset_id", "asset_type", "operating_mode", "health_state", "health_score", "temperature", "vibration", "pressure", "load", "rpm"]
add("d9_asset_registry", lambda s, d: pick(s, d, current, *REGISTRY, order=("health_score",)), f"SELECT {', '.join(REGISTRY)} FROM {EACH}")
add("d10_top_failure_probability", lambda s, d: pick(s, d, current, "asset_id", "failure_probability", order=(F.desc("failure_probability"), "asset_id"), limit=10), f"SELECT asset_id, failure_probability FROM {EACH} ORDER BY failure_probability DESC, asset_id LIMIT 10")
add("d11_least_remaining_life", lambda s, d: pick(s, d, current, "asset_id", "predicted_rul_hours", order=("predicted_rul_hours", "asset_id"), limit=10), f"SELECT asset_id, predicted_rul_hours FROM {EACH} ORDER BY predicted_rul_hours, asset_id LIMIT 10")
WORK = ["ranking", "asset_id", "maintenance_priority", "priority_score", "recommended_action"]
add("d12_work_orders", lambda s, d: pick(s, d, queue, *WORK, order=("ranking",)), f"SELECT {', '.join(WORK)} FROM maintenance_priority_queue")
for n, x in ((13, "failure_probability"), (14, "predicted_rul_hours")):
    add(f"d{n}_{x}_history", lambda s, d, x=x: pick(s, d, history, c("event_time").alias("time"), x, "asset_id", order=("event_time",)), f"SELECT event_time AS time, {x}, asset_id FROM asset_prediction_history")
LOG = ["asset_id", "severity", "current_health_state", "health_score", "event_time"]
add("d15_alert_log", lambda s, d: pick(s, d, alert_history, *LOG, order=(F.desc("event_time"), "asset_id"), limit=50), f"SELECT {', '.join(LOG)} FROM asset_alert_history ORDER BY event_time DESC, asset_id LIMIT 50")


def maintenance(s: SparkSession, d: str) -> DataFrame:
    """Maintenance records made of orders: one a customer's order, the customer being the asset."""
    kinds = F.array(*[F.lit(k) for k in ("PREVENTIVE", "CORRECTIVE", "INSPECTION", "EMERGENCY_REPAIR", "CALIBRATION")])
    return table("orders")(s, d).select(c("o_orderkey").alias("maintenance_id"), c("o_custkey").alias("asset_id"), F.element_at(kinds, (c("o_orderkey") % 5 + 1).cast("int")).alias("maintenance_type"), c("o_orderdate").alias("performed_at"), c("o_totalprice").alias("cost_usd"))


SERVICE = "SELECT o_orderkey AS maintenance_id, o_custkey AS asset_id, (['PREVENTIVE', 'CORRECTIVE', 'INSPECTION', 'EMERGENCY_REPAIR', 'CALIBRATION'])[o_orderkey % 5 + 1] AS maintenance_type, o_orderdate AS performed_at, o_totalprice AS cost_usd FROM orders"
add("d16_maintenance_log", lambda s, d: pick(s, d, maintenance, "*", order=(F.desc("performed_at"), "maintenance_id"), limit=20), f"{SERVICE} ORDER BY performed_at DESC, maintenance_id LIMIT 20")
add("d17_point_lookup", lambda s, d: pick(s, d, current, "asset_id", "health_state", "health_score", where="asset_id = 'MOTOR-005'"), f"SELECT asset_id, health_state, health_score FROM {EACH} WHERE asset_id = 'MOTOR-005'")
add("d18_health_statistics", lambda s, d: current(s, d).agg(mean("health_score", 6, "avg_health"), F.min("health_score").alias("min_health"), F.max("health_score").alias("max_health")), f"SELECT {mean_sql(avg_health=('health_score', 6))}, min(health_score) AS min_health, max(health_score) AS max_health FROM {EACH}")
add("d19_queue_top10", lambda s, d: pick(s, d, queue, *ORDERS[:6], order=("ranking",), limit=10), f"SELECT {', '.join(ORDERS[:6])} FROM maintenance_priority_queue ORDER BY ranking LIMIT 10")
add("d20_alerts_by_severity", lambda s, d: alert_history(s, d).groupBy("severity").agg(F.count("*").alias("n")), "SELECT severity, count(*) AS n FROM asset_alert_history GROUP BY severity")
add("d21_nations_by_region", lambda s, d: table("nation")(s, d).join(table("region")(s, d), F.expr("n_regionkey = r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations")), "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


def row_counts(s: SparkSession, d: str) -> DataFrame:
    one = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = one(EACH, current(s, d))
    for name in ("customer", "nation", "region"):
        out = out.unionAll(one(name, table(name)(s, d)))
    return out


add("d22_row_counts", row_counts, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in (EACH, "customer", "nation", "region")))
add("d23_distinct_assets", lambda s, d: current(s, d).select("asset_id", "asset_type", "operating_mode").distinct(), f"SELECT DISTINCT asset_id, asset_type, operating_mode FROM {EACH}")
add("d24_health_count", lambda s, d: current(s, d).agg(F.count("*").alias("n"), mean("health_score", 6, "avg_health"), F.min("health_score").alias("min_health"), F.max("health_score").alias("max_health")), f"SELECT count(*) AS n, {mean_sql(avg_health=('health_score', 6))}, min(health_score) AS min_health, max(health_score) AS max_health FROM {EACH}")
SENSED = {f"avg_{x}": (x, 4) for x in ("temperature", "vibration", "pressure", "power")}
add("d25_sensors_by_type", lambda s, d: current(s, d).groupBy("asset_type").agg(*means(**SENSED)), f"SELECT asset_type, {mean_sql(**SENSED)} FROM {EACH} GROUP BY asset_type")
add("d26_predictions_by_asset", lambda s, d: history(s, d).groupBy("asset_id").agg(F.count("*").alias("points"), *means(avg_probability=("failure_probability", 4), avg_rul=("predicted_rul_hours", 4))), f"SELECT asset_id, count(*) AS points, {mean_sql(avg_probability=('failure_probability', 4), avg_rul=('predicted_rul_hours', 4))} FROM asset_prediction_history GROUP BY asset_id")
add("d27_assets_by_state", lambda s, d: current(s, d).groupBy("health_state").agg(F.count("*").alias("n")).orderBy(F.desc("n")), f"SELECT health_state, count(*) AS n FROM {EACH} GROUP BY health_state")
add("d28_health_over_time", lambda s, d: pick(s, d, snapshots, "timestamp", "fleet_health_score", "avg_predicted_rul_hours", order=("timestamp",)), "SELECT timestamp, fleet_health_score, avg_predicted_rul_hours FROM fleet_kpi_snapshots")
add("d29_load_by_mode", lambda s, d: current(s, d).groupBy("operating_mode").agg(mean("load", 4, "avg_load")), f"SELECT operating_mode, {mean_sql(avg_load=('load', 4))} FROM {EACH} GROUP BY operating_mode")
add("d30_vibration_temperature", lambda s, d: pick(s, d, current, "asset_id", "vibration", "temperature"), f"SELECT asset_id, vibration, temperature FROM {EACH}")
add("d31_units_by_criticality", lambda s, d: queue(s, d).groupBy("criticality").agg(F.count("*").alias("n")), "SELECT criticality, count(*) AS n FROM maintenance_priority_queue GROUP BY criticality")
