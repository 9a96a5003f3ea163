"""One query for each operator, over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from assethealth.config import SENSORS
from assethealth.functions import columns as col
from assethealth.functions.health import streaming_priority
from assethealth.operators import alerts, features, serving, windows
from assethealth.plans.oracle import PARTS, REASONS, exact, kpis, r, sql
from assethealth.plans.store import stored
from assethealth.sources.telemetry import read_table, telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, text: str | None = None, instead: dict[str, str] | None = None) -> None:
    QUERIES[name] = query
    if text:
        SQL[name] = sql(text, instead)


# -- tables that the queries share -------------------------------------------


def scored(s: SparkSession, d: str) -> DataFrame:
    return features.scored(telemetry(s, d))


# health states are worked out once and read by all that serves them
states = stored("states", lambda s, d: alerts.with_states(scored(s, d), together=True))


def current(s: SparkSession, d: str) -> DataFrame:
    return serving.current_state(states(s, d))


def registry(s: SparkSession, d: str) -> DataFrame:
    return telemetry(s, d).select("asset_id", "criticality").distinct()


def queue(s: SparkSession, d: str) -> DataFrame:
    return serving.work_orders(stored_current(s, d), registry(s, d))


def history(s: SparkSession, d: str) -> DataFrame:
    return serving.prediction_history(states(s, d))


def alert_history(s: SparkSession, d: str) -> DataFrame:
    return alerts.alert_events(states(s, d))


def snapshots(s: SparkSession, d: str) -> DataFrame:
    """Fleet KPIs of each minute-long batch."""
    batched = states(s, d).withColumn("batch", F.expr("t_us div 60000000"))
    one = serving.fleet_summary(serving.current_state(batched, by=("batch", "asset_id")), by=("batch",))
    return one.withColumn("timestamp", F.timestamp_micros((F.col("batch") + 1) * 60000000))


# the analytical queries read these, as a serving store has them
stored_current, stored_queue, stored_history, stored_alerts, stored_snapshots = (
    stored(name, make) for name, make in (("current-state", current), ("queue", queue), ("predictions", history), ("alerts", alert_history), ("kpis", snapshots))
)


def table(name: str) -> Query:
    return lambda s, d: read_table(s, f"{d}/{name}.parquet")


R = col.rounded
c = F.col


def pick(s: SparkSession, d: str, source: Query, *columns: str | Column, where: str | Column | None = None, order: tuple = (), limit: int | None = None) -> DataFrame:
    """Columns of a table, filtered, sorted and cut: a projection with pushed-down conditions, or a top-k."""
    rows = source(s, d)
    rows = rows.where(where) if where is not None else rows
    rows = rows.orderBy(*order) if order else rows
    rows = rows.select(*columns)
    return rows.limit(limit) if limit else rows


# -- projections, features, anomalies, health --------------------------------

FEATURES = [f"{k}_{x}" for x in ("temperature", "vibration", "pressure", "current") for k in ("mean", "std")]
add("f1_bounded_buffer", lambda s, d: telemetry(s, d).select("arrival", "asset_id", F.count("*").over(Window.partitionBy("asset_id").orderBy("t_us", "arrival").rowsBetween(-119, 0)).alias("buffered")),
    "SELECT arrival, asset_id, count(*) OVER (PARTITION BY asset_id ORDER BY t_us, arrival ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS buffered FROM tel")


def rolling(*columns: str) -> Query:
    return lambda s, d: features.rolling_features(telemetry(s, d)).select("arrival", "asset_id", *columns)


for name, columns in {
    "f2_rolling_mean": [f for f in FEATURES if f.startswith("mean")], "f3_rolling_std": [f for f in FEATURES if f.startswith("std")], "f4_rolling_max": ["max_vibration"],
    "f5_ols_slope": ["thermal_rise_rate", "vibration_slope"], "f6_zscore": ["temperature_zscore", "vibration_zscore", "pressure_zscore"], "f7_pressure_instability": ["pressure_instability"],
    "f8_baselines": ["baseline_temperature", "baseline_vibration", "baseline_pressure", "baseline_current"], "f9_current_ratio": ["current_ratio"], "f10_sample_count": ["sample_count"],
    "p5_power_factor_deviation": ["power_factor_deviation"],
}.items():
    add(name, rolling(*columns), f"SELECT arrival, asset_id, {', '.join(columns)} FROM feat")

add("f11_latest_per_key", lambda s, d: serving.latest(telemetry(s, d)).select("asset_id", "arrival", "temperature"), "SELECT asset_id, max(arrival) AS arrival, arg_max(temperature, arrival) AS temperature FROM tel GROUP BY asset_id")
add("f12_ranking", lambda s, d: queue(s, d).select("ranking", "asset_id", "priority_score"), "SELECT ranking, asset_id, priority_score FROM maintenance_priority_queue")
add("f13_monotonicity", lambda s, d: telemetry(s, d).withColumn("back", c("t_us") < F.lag("t_us").over(Window.partitionBy("asset_id").orderBy("arrival"))).groupBy("asset_id").agg(F.count_if("back").alias("backwards")),
    "SELECT asset_id, count(*) FILTER (WHERE back) AS backwards FROM (SELECT *, t_us < lag(t_us) OVER (PARTITION BY asset_id ORDER BY arrival) AS back FROM tel) GROUP BY asset_id")
add("f14_steps_to_end", lambda s, d: telemetry(s, d).select("arrival", "asset_id", (F.count("*").over(Window.partitionBy("asset_id")) - F.row_number().over(Window.partitionBy("asset_id").orderBy("t_us", "arrival"))).alias("steps_left")),
    "SELECT arrival, asset_id, count(*) OVER (PARTITION BY asset_id) - row_number() OVER (PARTITION BY asset_id ORDER BY t_us, arrival) AS steps_left FROM tel")
# late events: 10 or 40 s back
late_shift = "CASE WHEN arrival % 53 = 0 THEN t_us - 10000000 WHEN arrival % 53 = 1 THEN t_us - 40000000 ELSE t_us END"


def late_samples(s: SparkSession, d: str) -> DataFrame:
    return telemetry(s, d).withColumn("t_us", F.expr(late_shift))


PARTS["late"] = f"SELECT * REPLACE ({late_shift} AS t_us) FROM tel"
PARTS["marks"] = "SELECT *, max(t_us) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM late"
PARTS["classed"] = "SELECT *, (greatest(coalesce(high, t_us), t_us) - 5000000) / 1e6 AS watermark, CASE WHEN high IS NULL OR t_us >= high - 5000000 THEN 'ON_TIME' WHEN t_us >= high - 35000000 THEN 'LATE_ACCEPTED' ELSE 'EXCESSIVELY_LATE' END AS lateness FROM marks"
add("f15_running_max", lambda s, d: windows.running_max_before(late_samples(s, d), "t_us", "arrival").select("arrival", "high"), "SELECT arrival, high FROM marks")
add("f16_fault_count", lambda s, d: scored(s, d).select("arrival", "asset_id", "fault_count"), "SELECT arrival, asset_id, fault_count FROM counts")
add("f17_healthy_samples", lambda s, d: scored(s, d).select("arrival", "asset_id", "healthy_samples"), "SELECT arrival, asset_id, healthy_samples FROM counts")


def power_window() -> WindowSpec:
    return Window.partitionBy("asset_id").orderBy("t_us").rangeBetween(-30_000_000, 0)


add("f18_rolling_power", lambda s, d: telemetry(s, d).select("arrival", R(F.avg("power").over(power_window()), 3).alias("mean_power"), R(F.coalesce(F.stddev_samp("power").over(power_window()), F.lit(0.0)), 3).alias("std_power"), R(0.05 * c("power"), 6).alias("std_power_compat")),
    f"SELECT arrival, {r('avg(power) OVER w', 3)} AS mean_power, {r('coalesce(stddev_samp(power) OVER w, 0e0)', 3)} AS std_power, {r('5e-2 * power', 6)} AS std_power_compat FROM tel WINDOW w AS (PARTITION BY asset_id ORDER BY t_us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW)")

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
add("p1_event_time", lambda s, d: telemetry(s, d).select("arrival", F.when(c("arrival") % 3 == 0, c("timestamp").cast("string")).alias("ts"), F.when(c("arrival") % 3 == 1, col.iso_utc(c("t_us"))).alias("iso")).select("arrival", R(col.epoch_seconds(c("ts"), c("iso")), 6).alias("epoch")),
    f"SELECT arrival, CASE WHEN arrival % 3 < 2 THEN {r('timestamp', 6)} END AS epoch FROM tel")
add("p2_epoch_millis", lambda s, d: telemetry(s, d).select("arrival", col.epoch_millis(F.when(c("arrival") % 3 == 0, F.floor("timestamp").cast("string")).when(c("arrival") % 3 == 1, F.expr("cast(t_us div 1000 as string)")).otherwise(col.iso_utc(c("t_us")))).alias("ms")),
    "SELECT arrival, CASE WHEN arrival % 3 = 0 THEN t_us // 1000000 * 1000 ELSE t_us // 1000 END AS ms FROM tel")
add("p3_asset_type", lambda s, d: telemetry(s, d).select("arrival", col.asset_type_or_default(F.when(c("arrival") % 3 == 0, c("asset_type")), F.when(c("arrival") % 3 == 2, F.lit("X9")).otherwise(c("asset_id"))).alias("kind")), "SELECT arrival, CASE WHEN arrival % 3 = 2 THEN 'GENERIC' ELSE asset_type END AS kind FROM tel")
add("p4_feature_projection", lambda s, d: pick(s, d, telemetry, "event_id", "asset_id", "asset_type", "timestamp", *SENSORS, "operating_mode"), f"SELECT event_id, asset_id, asset_type, timestamp, {', '.join(SENSORS)}, operating_mode FROM tel")
add("p6_priority_names", lambda s, d: states(s, d).select("arrival", streaming_priority(c("health_state")).alias("p")).select("arrival", col.serving_priority_name(c("p")).alias("priority")),
    "SELECT arrival, (['LOW', 'MEDIUM', 'HIGH', 'EMERGENCY'])[health + 1] AS priority FROM states")
add("p7_enum_defaults", lambda s, d: table("events")(s, d).select("event_id", col.severity_name(F.when(c("event_id") % 2 == 0, "critical").otherwise(c("event_type"))).alias("severity"), col.health_name(F.when(c("event_id") % 2 == 0, "Watch").otherwise(c("event_type"))).alias("health")),
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CASE WHEN event_id % 2 = 0 THEN 'WATCH' ELSE 'HEALTHY' END AS health FROM events")
add("p8_iso_time", lambda s, d: telemetry(s, d).select("arrival", col.iso_utc(c("t_us")).alias("iso")), "SELECT arrival, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso FROM tel")
six = ("temperature", "vibration", "pressure", "current", "voltage", "power")
add("p9_trigger_values", lambda s, d: telemetry(s, d).withColumn("pressure", F.when(c("arrival") % 7 > 0, c("pressure"))).select("arrival", F.explode(col.trigger_values()).alias("sensor", "value")),
    "SELECT arrival, sensor, value FROM (" + " UNION ALL ".join(f"SELECT arrival, '{x}' AS sensor, {exact(x, 2)} AS value FROM tel" for x in six) + ") WHERE sensor <> 'pressure' OR arrival % 7 > 0")
seven = {"thermal_rise_rate": "thermal_rise_rate", "vibration_slope": "vibration_slope", "pressure_instability": "pressure_instability", "current_ratio": "current_ratio", "vibration_zscore": "vibration_zscore", "mean_vibration": "mean_vibration", "mean_temperature": "mean_temperature"}
add("p10_supporting_features", lambda s, d: features.rolling_features(telemetry(s, d)).select("arrival", F.explode(col.supporting_features()).alias("feature", "value")), " UNION ALL ".join(f"SELECT arrival, '{k}' AS feature, {v} AS value FROM feat" for k, v in seven.items()))
CODES = {"a1": "ERR_L1_TEMP_EXCEEDED", "a2": "ERR_L1_VIB_ZONE_D", "a3": "ERR_L1_OVERCURRENT", "a4": "WARN_L2_RAPID_HEATING", "a5": "WARN_L2_VIB_STATISTICAL_DEVIATION", "a6": "WARN_L2_PRESSURE_VARIANCE", "a7": "FAULT_L3_BEARING_FRICTION_COUPLING", "a8": "FAULT_L3_CAVITATION_SHOCKWAVES", "a9": "FAULT_L3_WINDING_ASYMMETRY"}
code_list = "list_filter([" + ", ".join(f"CASE WHEN {k} THEN '{v}' END" for k, v in CODES.items()) + "], lambda x: x IS NOT NULL)"
add("p11_reason_codes", lambda s, d: scored(s, d).select("arrival", F.array_join(F.concat(F.transform("anomalies", lambda a: a["reason_code"]), "degradation_reasons"), "|").alias("codes")), f"SELECT arrival, array_to_string(list_concat({code_list}, {REASONS}), '|') AS codes FROM scored")
add("p12_json_encoding", lambda s, d: scored(s, d).select("arrival", F.to_json(F.transform("anomalies", lambda a: a["reason_code"])).alias("codes")),
    f"SELECT arrival, CASE WHEN found = 0 THEN '[]' ELSE '[\"' || array_to_string({code_list}, '\",\"') || '\"]' END AS codes FROM scored")
add("p13_stable_ids", lambda s, d: telemetry(s, d).select("arrival", col.stable_id("alert", c("asset_id"), c("arrival")).alias("id")), "SELECT arrival, 'alert-' || asset_id || '-' || arrival || '-' || left(sha256(asset_id || '|' || arrival), 6) AS id FROM tel")
HORIZON = "CASE WHEN predicted_rul_hours < 24 THEN 'IMMEDIATE (< 24h)' WHEN predicted_rul_hours <= 72 THEN 'SHORT_TERM (24-72h)' WHEN predicted_rul_hours <= 120 THEN 'MEDIUM_TERM (72-120h)' ELSE 'LONG_TERM (> 120h)' END"
add("p14_rul_horizon", lambda s, d: current(s, d).select("asset_id", col.rul_horizon(c("predicted_rul_hours")).alias("horizon")), f"SELECT asset_id, {HORIZON} AS horizon FROM asset_current_state")
add("p15_rounding", lambda s, d: table("lineitem")(s, d).select("l_orderkey", "l_linenumber", col.rounded_exactly(c("l_extendedprice") * (1 - c("l_discount")), 2).alias("net"), col.rounded_exactly(c("l_quantity") / 8, 1).alias("eighths")),
    f"SELECT l_orderkey, l_linenumber, {exact('l_extendedprice * (1 - l_discount)', 2)} AS net, {exact('l_quantity / 8', 1)} AS eighths FROM lineitem")
add("p16_ratio_guards", lambda s, d: telemetry(s, d).groupBy("asset_id").agg(R(F.coalesce(F.try_divide(F.count_if(c("load") > 95), F.nullif(F.count_if(c("load") > 80), F.lit(0))), F.lit(0.0)), 6).alias("ratio")),
    f"SELECT asset_id, {r('coalesce(count(*) FILTER (WHERE load > 95) / nullif(count(*) FILTER (WHERE load > 80), 0), 0e0)', 6)} AS ratio FROM tel GROUP BY asset_id")
add("p17_minute_bucket", lambda s, d: telemetry(s, d).groupBy(F.date_trunc("minute", F.timestamp_micros("t_us")).alias("minute")).agg(F.count("*").alias("n")), "SELECT date_trunc('minute', make_timestamp(t_us)) AS minute, count(*) AS n FROM tel GROUP BY 1")
add("p18_recommended_action", lambda s, d: queue(s, d).select("asset_id", "recommended_action"), "SELECT asset_id, recommended_action FROM maintenance_priority_queue")
add("p19_predicates", lambda s, d: telemetry(s, d).where(c("operating_mode").isin("HIGH_LOAD", "DEGRADED") & (c("load").between(60, 90) | (c("vibration") >= 3)) & (c("asset_type") != "TURBINE") & (F.abs(c("current") - 52) > 1.5 * 0.5)).select("arrival", "asset_id"),
    "SELECT arrival, asset_id FROM tel WHERE operating_mode IN ('HIGH_LOAD', 'DEGRADED') AND (load BETWEEN 60 AND 90 OR vibration >= 3) AND asset_type <> 'TURBINE' AND abs(current - 52) > 15e-1 * 5e-1")

TYPES = ["L1_TEMPERATURE_TRIP", "L1_VIBRATION_CRITICAL_ISO", "L1_OVERCURRENT_TRIP", "L2_THERMAL_RISE_RATE", "L2_VIBRATION_ZSCORE_DEVIATION", "L2_PRESSURE_INSTABILITY", "L3_BEARING_DEGRADATION", "L3_FLUID_CAVITATION", "L3_ELECTRICAL_STATOR_IMBALANCE"]
VALUES = ["temperature", "vibration", "current", "thermal_rise_rate", "vibration_zscore", "pressure_instability", "vibration", "pressure_instability", "current_ratio"]
SEVERITY = ["'CRITICAL'", "'CRITICAL'", "'HIGH'", "CASE WHEN thermal_rise_rate < 8 THEN 'WARNING' ELSE 'HIGH' END", "CASE WHEN abs(vibration_zscore) < 45e-1 THEN 'WARNING' ELSE 'HIGH' END", "'WARNING'", "'HIGH'", "'HIGH'", "'HIGH'"]
LIMITS = ["CASE WHEN contains(asset_id, 'TURBINE') THEN 950e0 ELSE 120e0 END", "12e0", r("coalesce(nullif(baseline_current, 0), 100e0)", 2), "4e0", "3e0", "15e-2", "45e-1", "12e-2", "12e-1"]
for i, kind in enumerate(TYPES):
    add(f"a{i + 1}_{kind.lower()}", lambda s, d, kind=kind: scored(s, d).select("arrival", "asset_id", F.explode("anomalies").alias("a")).where(c("a.anomaly_type") == kind).select("arrival", "asset_id", "a.level", "a.severity", "a.reason_code", "a.triggering_value", "a.threshold_value"),
        f"SELECT arrival, asset_id, {i // 3 + 1} AS level, {SEVERITY[i]} AS severity, '{CODES[f'a{i + 1}']}' AS reason_code, {r(VALUES[i], 2)} AS triggering_value, {LIMITS[i]} AS threshold_value FROM flags WHERE a{i + 1}")
add("a10_anomaly_counts", lambda s, d: scored(s, d).select(F.explode("anomalies").alias("a")).groupBy("a.anomaly_type", "a.level", "a.severity").agg(F.count("*").alias("n")),
    " UNION ALL ".join(f"SELECT '{t}' AS anomaly_type, {i // 3 + 1} AS level, {SEVERITY[i]} AS severity, count(*) AS n FROM flags WHERE a{i + 1} GROUP BY 3" for i, t in enumerate(TYPES)))
add("a11_highest_level", lambda s, d: scored(s, d).select("arrival", serving.highest_level(c("anomalies")).alias("anomaly_level")), "SELECT arrival, anomaly_level FROM anom")

for name, part in {"h1_vibration_part": "vibration_part", "h2_thermal_part": "thermal_part", "h3_pressure_part": "pressure_part", "h4_electrical_part": "electrical_part", "h5_persistence_part": "persistence_part"}.items():
    add(name, lambda s, d, part=part: scored(s, d).select("arrival", R(c(part), 3).alias(part)), f"SELECT arrival, {r(part, 3)} AS {part} FROM parts")
add("h6_health_score", lambda s, d: scored(s, d).select("arrival", "asset_id", "health_score"), "SELECT arrival, asset_id, health_score FROM scored")
add("h7_reasons", lambda s, d: scored(s, d).select("arrival", F.array_join("degradation_reasons", "|").alias("reasons")), f"SELECT arrival, array_to_string({REASONS}, '|') AS reasons FROM scored")
add("h8_health_states", lambda s, d: states(s, d).select("arrival", "asset_id", "health_state"), "SELECT arrival, asset_id, health_state FROM states")
add("h9_transitions", lambda s, d: states(s, d).where("is_state_transition").select("arrival", "asset_id", "previous_health_state", "health_state", "is_recovery"), "SELECT arrival, asset_id, previous_health_state, health_state, is_recovery FROM states WHERE is_state_transition")
add("h10_streaming_priority", lambda s, d: states(s, d).select("arrival", streaming_priority(c("health_state")).alias("priority")), "SELECT arrival, (['NORMAL', 'SCHEDULED', 'URGENT', 'EMERGENCY'])[health + 1] AS priority FROM states")
add("l1_alert_severity", lambda s, d: states(s, d).select("arrival", "severity"), "SELECT arrival, severity FROM states")
add("l2_alert_gating", lambda s, d: states(s, d).select("arrival", "asset_id", "outcome"), "SELECT arrival, asset_id, outcome FROM states")
ALERT = ["asset_id", "asset_type", "event_time", "severity", "previous_health_state", "current_health_state", "health_score", "is_state_transition", "is_recovery"]
add("l3_alerts", lambda s, d: alert_history(s, d).select("arrival", *ALERT, F.array_join("reason_codes", "|").alias("codes"), c("triggering_values")["vibration"].alias("vibration")),
    f"SELECT arrival, asset_id, asset_type, make_timestamp(t_us) AS event_time, severity, previous_health_state, health_state AS current_health_state, health_score, is_state_transition, is_recovery, array_to_string(list_concat({code_list}, {REASONS}), '|') AS codes, {exact('vibration', 2)} AS vibration FROM states WHERE outcome = 2")
add("l4_alert_counters", lambda s, d: alerts.alert_counters(states(s, d)),
    "SELECT count(*) AS evaluated, count(*) FILTER (WHERE outcome = 2) AS emitted, count(*) FILTER (WHERE outcome = 1) AS suppressed, count(*) FILTER (WHERE is_state_transition) AS transitions, count(*) FILTER (WHERE is_recovery) AS recoveries FROM states")

# -- windows and lateness ------------------------------------------------------

SUMMARY = f"""count(*) AS sample_count, {r("avg(temperature)", 2)} AS mean_temperature, {r("coalesce(stddev_samp(temperature), 0e0)", 3)} AS std_temperature,
  {r("CASE WHEN max(t_us) - min(t_us) > 1000 THEN (arg_max(temperature, arrival) - arg_min(temperature, arrival)) / ((arg_max(t_us, arrival) - arg_min(t_us, arrival)) / 1e6) * 60 ELSE 0e0 END", 4)} AS thermal_rise_rate,
  {r("avg(vibration)", 2)} AS mean_vibration, {r("max(vibration)", 2)} AS max_vibration,
  {r("CASE WHEN max(t_us) - min(t_us) > 1000 THEN (arg_max(vibration, arrival) - arg_min(vibration, arrival)) / ((arg_max(t_us, arrival) - arg_min(t_us, arrival)) / 1e6) * 60 ELSE 0e0 END", 4)} AS vibration_slope,
  {r("avg(pressure)", 2)} AS mean_pressure, {r("coalesce(stddev_samp(pressure), 0e0)", 3)} AS std_pressure, CAST(sum(CAST(found > 0 AS INTEGER)) AS BIGINT) AS anomalies_in_window"""


def flagged(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).withColumns({"event_time": F.timestamp_micros("t_us"), "is_anomaly": (F.size("anomalies") > 0).cast("int")})


def windowed(size: int, slide: int, least: int, kind: str) -> None:
    name = {"TUMBLING": "w3_tumbling_window", "SLIDING": "w4_sliding_window", "TREND": "w16_trend_window"}[kind]
    spans = f"SELECT *, (t_us // {slide}000000 - i) * {slide}000000 AS lo FROM anom, range({size // slide}) x(i)"
    add(name, lambda s, d: windows.window_summaries(flagged(s, d), size, slide, least, kind).drop("window_id"),
        f"SELECT asset_id, '{kind}' AS window_type, lo / 1e6 AS window_start, lo / 1e6 + {size} AS window_end, {SUMMARY} FROM ({spans}) GROUP BY asset_id, lo HAVING count(*) >= {least}")


windowed(5, 5, 1, "TUMBLING")
windowed(30, 5, 3, "SLIDING")
windowed(120, 10, 1, "TREND")
PARTS["ends"] = "SELECT *, t_us // 5000000 * 5000000 AS tick FROM anom"
PARTS["closes"] = "SELECT asset_id, arrival AS closed_by, t_us AS now, coalesce(high, tick - 5000000) AS lo, tick AS hi FROM (SELECT *, max(tick) OVER (PARTITION BY asset_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM ends) WHERE high IS NULL OR tick > high"
add("w5_merged_windows", lambda s, d: windows.merged_windows(flagged(s, d)).drop("is_anomaly"),
    f"SELECT asset_id, lo / 1e6 AS window_start, hi / 1e6 AS window_end, {SUMMARY} FROM (SELECT e.*, x.lo, x.hi FROM closes x JOIN ends e ON e.asset_id = x.asset_id AND e.t_us >= x.lo AND e.t_us < x.hi AND e.t_us >= x.now - 60000000 AND e.arrival <= x.closed_by) GROUP BY asset_id, lo, hi")
add("w6_endpoint_slope", lambda s, d: telemetry(s, d).groupBy("asset_id").agg(R(windows.endpoint_slope("temperature"), 4).alias("slope")),
    f"SELECT asset_id, {r('coalesce((arg_max(temperature, arrival) - arg_min(temperature, arrival)) / nullif((arg_max(t_us, arrival) - arg_min(t_us, arrival)) / 1e6, 0) * 60, 0e0)', 4)} AS slope FROM tel GROUP BY asset_id")
add("w2_lateness", lambda s, d: windows.lateness(late_samples(s, d)).select("arrival", R(c("watermark"), 6).alias("watermark"), "lateness"), f"SELECT arrival, {r('watermark', 6)} AS watermark, lateness FROM classed")
add("w17_late_side_output", lambda s, d: windows.lateness(late_samples(s, d)).where("lateness = 'EXCESSIVELY_LATE'").select("arrival", "asset_id", "event_id"), "SELECT arrival, asset_id, event_id FROM classed WHERE lateness = 'EXCESSIVELY_LATE'")
add("w13_stream_metrics", lambda s, d: windows.lateness(late_samples(s, d)).agg(F.count("*").alias("ingested"), F.count_if(c("lateness") == "LATE_ACCEPTED").alias("late"), F.count_if(c("lateness") == "EXCESSIVELY_LATE").alias("dropped"), R(F.max("watermark"), 6).alias("watermark")),
    f"SELECT count(*) AS ingested, count(*) FILTER (WHERE lateness = 'LATE_ACCEPTED') AS late, count(*) FILTER (WHERE lateness = 'EXCESSIVELY_LATE') AS dropped, {r('max(watermark)', 6)} AS watermark FROM classed")
add("w14_latency_percentiles", lambda s, d: windows.nearest_rank(table("events")(s, d), "value"),
    f"SELECT count(*) AS n, {r('avg(value)', 6)} AS mean, min(value) FILTER (WHERE rn > floor(t * 5e-1)) AS p50, min(value) FILTER (WHERE rn > floor(t * 95e-2)) AS p95, min(value) FILTER (WHERE rn > floor(t * 99e-2)) AS p99 FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS t FROM events)")
add("w15_active_assets", lambda s, d: telemetry(s, d).agg(F.count_distinct("asset_id").alias("active_assets")), "SELECT count(DISTINCT asset_id) AS active_assets FROM tel")

# -- serving -------------------------------------------------------------------

STATE = ["asset_id", "asset_type", "operating_mode", "health_state", "health_score", "failure_probability", "predicted_failure_risk", "predicted_rul_hours", "maintenance_priority", "anomaly_level", "active_alert_count", "temperature", "vibration", "pressure", "load", "rpm", "power", "last_event_time", "model_version"]
KPI = ["total_assets", "healthy_assets", "watch_assets", "degraded_assets", "critical_assets", "high_risk_assets", "near_failure_assets", "fleet_health_score", "avg_predicted_rul_hours", "min_predicted_rul_hours", "failure_risk_rate", "active_alerts_total", "emergency_maintenance_count", "high_maintenance_count"]
add("k1_current_state", lambda s, d: pick(s, d, stored_current, *STATE), f"SELECT {', '.join(STATE)} FROM asset_current_state")
add("k2_prognosis", lambda s, d: pick(s, d, history, "arrival", "failure_probability", "predicted_failure_risk", "predicted_rul_hours"), "SELECT arrival, failure_probability, predicted_failure_risk, predicted_rul_hours FROM prog")
add("k3_priority_tier", lambda s, d: pick(s, d, stored_current, "asset_id", "maintenance_priority"), "SELECT asset_id, maintenance_priority FROM asset_current_state")
add("k4_active_alerts", lambda s, d: pick(s, d, stored_current, "asset_id", "active_alert_count"), "SELECT asset_id, active_alert_count FROM asset_current_state")
add("k5_fleet_summary", lambda s, d: serving.fleet_summary(stored_current(s, d)), kpis("asset_current_state"))
add("k6_priority_score", lambda s, d: pick(s, d, queue, "asset_id", "priority_score"), "SELECT asset_id, priority_score FROM maintenance_priority_queue")
ORDERS = ["ranking", "asset_id", "asset_type", "criticality", "health_state", "health_score", "failure_probability", "predicted_rul_hours", "maintenance_priority", "priority_score", "recommended_action", "evaluated_at"]
add("k7_work_orders", lambda s, d: pick(s, d, queue, *ORDERS), f"SELECT {', '.join(ORDERS)} FROM maintenance_priority_queue")
add("k8_kpi_snapshots", lambda s, d: pick(s, d, snapshots, "batch", "timestamp", *KPI), f"SELECT batch, timestamp, {', '.join(KPI)} FROM fleet_kpi_snapshots")
add("k9_attribution", lambda s, d: pick(s, d, history, "arrival", F.get_json_object("top_features_summary", "$[0].observed_value").cast("double").alias("health"), F.get_json_object("top_features_summary", "$[1].feature").alias("second")),
    f"SELECT arrival, {r('health_score', 4)} AS health, 'vibration' AS second FROM prog")
