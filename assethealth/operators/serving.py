"""Current state, prognosis, KPIs and work orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.config import CRITICALITY, DEFAULTS, Thresholds
from assethealth.functions.anomaly import highest_level
from assethealth.functions.columns import clamp, looked_up, rounded, stable_id
from assethealth.operators.prefix import numbered


def latest(rows: DataFrame, by: Sequence[str] = ("asset_id",), time: str = "t_us", order: str = "arrival", more: Sequence[Column] = ()) -> DataFrame:
    """The last row of each ``by``, and further aggregates: a partial maximum, without sorting histories."""
    row = F.struct(*[c for c in rows.columns if c not in by])
    found = rows.groupBy(*by).agg(F.max_by(row, F.struct(time, order)).alias("last"), *more)
    return found.select(*by, "last.*", *[c for c in found.columns if c not in by and c != "last"])


def prognosis(health: Column, temperature: Column, vibration: Column, t: Thresholds = DEFAULTS) -> dict[str, Column]:
    """Failure probability, risk flag and remaining life where no model speaks."""
    base = rounded(clamp(1 - health), 4)
    p = F.when((temperature > 90) | (vibration > 5), F.least(F.lit(1.0), base + 0.25)).otherwise(base)
    return {"failure_probability": p, "predicted_failure_risk": (p >= 0.5).cast("int"), "predicted_rul_hours": rounded(clamp(health * t.rul_cap_hours, 0.0, t.rul_cap_hours), 2)}


def priority_tier(p: Column, rul: Column, state: Column) -> Column:
    return (
        F.when((p >= 0.8) | (rul <= 10) | (state == "CRITICAL"), "EMERGENCY")
        .when((p >= 0.6) | (rul <= 25) | (state == "DEGRADED"), "HIGH")
        .when((p >= 0.35) | (rul <= 50) | (state == "WATCH"), "MEDIUM")
        .otherwise("LOW")
    )


def attribution(health: Column, vibration: Column, temperature: Column) -> Column:
    """JSON of the three features that the heuristic rests on."""
    part = lambda name, weight, value: F.struct(F.lit(name).alias("feature"), F.lit(weight).alias("importance"), rounded(value, 4).alias("observed_value"))
    return F.to_json(F.array(part("health_score", 0.38, health), part("vibration", 0.28, vibration), part("temperature", 0.22, temperature)))


#: What a current state is made from, beside anomalies.
CARRIED = ("asset_type", "operating_mode", "health_state", "health_score", "outcome", "is_recovery", "temperature", "vibration", "pressure", "load", "rpm", "power", "criticality", "t_us", "arrival")


def current_state(states: DataFrame, model_version: str = "heuristic", by: Sequence[str] = ("asset_id",)) -> DataFrame:
    """One row an asset (and batch, if ``by`` has it): its last sample, state, prognosis, tier and active alerts."""
    alerts = F.count_if((F.col("outcome") == 2) & ~F.col("is_recovery")).alias("active_alert_count")
    slim = states.select(*by, *CARRIED, highest_level(F.col("anomalies")).alias("anomaly_level"))  # rows are sorted whole
    rows = latest(slim, by, more=[alerts]).withColumns(prognosis(F.col("health_score"), F.col("temperature"), F.col("vibration")))
    when = F.timestamp_micros("t_us")
    return rows.select(
        *by, "asset_type", "operating_mode", F.coalesce("health_state", F.lit("HEALTHY")).alias("health_state"), rounded(F.coalesce("health_score", F.lit(1.0)), 4).alias("health_score"),
        "failure_probability", "predicted_failure_risk", "predicted_rul_hours", priority_tier(F.col("failure_probability"), F.col("predicted_rul_hours"), F.col("health_state")).alias("maintenance_priority"),
        "anomaly_level", "active_alert_count", rounded(F.col("temperature"), 2).alias("temperature"), rounded(F.col("vibration"), 3).alias("vibration"),
        rounded(F.col("pressure"), 2).alias("pressure"), rounded(F.col("load"), 2).alias("load"), rounded(F.col("rpm"), 1).alias("rpm"), rounded(F.col("power"), 2).alias("power"),
        when.alias("last_event_time"), when.alias("last_prediction_time"), F.lit(model_version).alias("model_version"), "criticality",
    )


def prediction_history(scored: DataFrame, model_version: str = "heuristic") -> DataFrame:
    """A prognosis for every sample."""
    rows = scored.withColumns(prognosis(F.col("health_score"), F.col("temperature"), F.col("vibration")))
    return rows.select(
        stable_id("PRED", F.col("asset_id"), F.col("arrival"), length=8).alias("prediction_id"), "asset_id", "asset_type", "timestamp", F.timestamp_micros("t_us").alias("event_time"),
        "failure_probability", "predicted_failure_risk", "predicted_rul_hours", attribution(F.col("health_score"), F.col("vibration"), F.col("temperature")).alias("top_features_summary"),
        F.lit(model_version).alias("model_version"), "arrival",
    )


def fleet_summary(states: DataFrame, active_alerts: int = 0, by: Sequence[str] = (), t: Thresholds = DEFAULTS) -> DataFrame:
    """One row of fleet KPIs; an empty fleet has the defaults.

    ``active_alerts_total`` adds the alerts given to those the states count, so
    a caller that passes the batch's own alerts counts them twice, as the
    published figures do.
    """
    n, c = F.count("*"), F.col
    state = lambda s: F.count_if(c("health_state") == s)
    tier = lambda s: F.count_if(c("maintenance_priority") == s)
    risky = F.count_if(c("failure_probability") >= 0.5)
    return states.groupBy(*by).agg(
        n.alias("total_assets"), state("HEALTHY").alias("healthy_assets"), state("WATCH").alias("watch_assets"), state("DEGRADED").alias("degraded_assets"), state("CRITICAL").alias("critical_assets"),
        risky.alias("high_risk_assets"), F.count_if(c("predicted_rul_hours") < t.near_failure_hours).alias("near_failure_assets"),
        rounded(F.coalesce(F.avg("health_score"), F.lit(1.0)), 6).alias("fleet_health_score"), rounded(F.coalesce(F.avg("predicted_rul_hours"), F.lit(t.rul_cap_hours)), 6).alias("avg_predicted_rul_hours"),
        F.coalesce(F.min("predicted_rul_hours"), F.lit(t.rul_cap_hours)).alias("min_predicted_rul_hours"), rounded(F.coalesce(F.try_divide(risky, n), F.lit(0.0)), 6).alias("failure_risk_rate"),
        (F.coalesce(F.sum("active_alert_count"), F.lit(0)) + active_alerts).alias("active_alerts_total"), tier("EMERGENCY").alias("emergency_maintenance_count"), tier("HIGH").alias("high_maintenance_count"),
    )


def priority_score() -> Column:
    """Urgency from 0 to 100."""
    weight = looked_up(F.upper("criticality"), CRITICALITY, 0.25)
    raw = 0.35 * (1 - clamp(F.col("health_score"))) + 0.35 * clamp(F.col("failure_probability")) + 0.20 * clamp(1 - F.col("predicted_rul_hours") / 120) + 0.10 * weight
    return rounded(clamp(100 * raw, 0.0, 100.0), 2)


def recommended_action() -> Column:
    # fixed values: the texts
    c = F.col
    p, state, tier = c("failure_probability"), c("health_state"), c("maintenance_priority")
    return (
        F.when((tier == "EMERGENCY") | (state == "CRITICAL"), F.format_string("IMMEDIATE SHUTDOWN & INSPECTION: Failure imminent within %.1fh (Risk: %.1f%%)", rounded(c("predicted_rul_hours"), 1), rounded(p * 100, 1)))
        .when((tier == "HIGH") | (p >= 0.5), F.format_string("SCHEDULE EXPEDITED OVERHAUL: Component degradation detected (RUL: %.1fh)", rounded(c("predicted_rul_hours"), 1)))
        .when((tier == "MEDIUM") | (state == "DEGRADED"), F.concat(F.lit("INSPECT WITHIN 48H: Early anomaly progression observed (Health: "), state, F.lit(")")))
        .when(state == "WATCH", "INCREASE TELEMETRY SAMPLING: Minor variance from baseline profile")
        .otherwise("NORMAL OPERATION: Continue routine scheduled lubrication and monitoring")
    )


def ranked(rows: DataFrame, score: str = "priority_score", key: str = "asset_id") -> DataFrame:
    """Adds ``ranking``: 1 for the highest score, ties by key; any number of equal scores is spread over tasks."""
    return numbered(rows, F.desc(score), F.col(key)).withColumn("ranking", F.col("number").cast("int")).drop("number")


def work_orders(states: DataFrame, criticality: DataFrame) -> DataFrame:
    """Ranked maintenance work orders; assets of unknown criticality count as MEDIUM."""
    rows = states.drop("criticality").join(criticality.select("asset_id", "criticality"), "asset_id", "left").withColumn("criticality", F.coalesce("criticality", F.lit("MEDIUM")))
    rows = ranked(rows.withColumn("priority_score", priority_score()))
    return rows.select(
        "ranking", "asset_id", "asset_type", "criticality", "health_state", "health_score", "failure_probability", "predicted_rul_hours", "maintenance_priority", "priority_score",
        recommended_action().alias("recommended_action"), F.col("last_prediction_time").alias("evaluated_at"),
    )
