"""SQL of the same queries for another engine, put together from named parts.

Literals are written 4e-2 rather than 0.04, so that they are doubles.
"""

from __future__ import annotations

import re


def r(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 500001e-6) / 1e{digits})"


def exact(x: str, digits: int) -> str:
    """Python's rounding: whole and half from the exact product, which is ``p`` and its error."""
    scale = f"1e{digits}"
    high = f"(134217729e0 * {scale} - (134217729e0 * {scale} - {scale}))"
    split = f"lambda v: {{'v': v, 'p': v * {scale}, 'h': 134217729e0 * v - (134217729e0 * v - v)}}"
    error = f"((s.h * {high} - s.p) + s.h * ({scale} - {high}) + (s.v - s.h) * {high}) + (s.v - s.h) * ({scale} - {high})"
    rest = "(s.p - round_even(s.p, 0))"
    step = f"CASE WHEN {rest} = 5e-1 AND {error} > 0 THEN 1e0 WHEN {rest} = -5e-1 AND {error} < 0 THEN -1e0 ELSE 0e0 END"
    return f"list_transform(list_transform([CAST({x} AS DOUBLE)], {split}), lambda s: CASE WHEN abs(s.p) < 2251799813685248 THEN (round_even(s.p, 0) + {step}) / {scale} ELSE s.v END)[1]"


PARTS: dict[str, str] = {}

PARTS["tel"] = """
SELECT event_id AS arrival, 'evt-' || event_id AS event_id, kind || '-' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(3, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS asset_id,
  kind AS asset_type, t_us, t_us / 1e6 AS timestamp,
  62 + 4e-2 * k + 25e-2 * greatest(0e0, value - 150) + CASE WHEN kind = 'TURBINE' THEN 600 ELSE 0 END AS temperature,
  1 + value / 40 AS vibration, (5 + 12e-3 * k) * CASE WHEN event_type = 'error' THEN 75e-2 ELSE 1e0 END AS pressure, 1750e0 AS rpm,
  48 + 5e-2 * k + value / 20 AS current, 400e0 AS voltage,
  88e-2 * sqrt(3e0) * 400 * (48 + 5e-2 * k + value / 20) / 1000 - 2e-2 * k * CASE WHEN value > 120 THEN 2 ELSE 1 END AS power,
  least(100e0, 50 + 5e-1 * k) AS load,
  CASE event_type WHEN 'view' THEN 'NORMAL' WHEN 'click' THEN 'HIGH_LOAD' WHEN 'purchase' THEN 'STARTUP' WHEN 'signup' THEN 'IDLE' WHEN 'error' THEN 'DEGRADED' END AS operating_mode,
  CAST(user_id % 8 + 1 AS INTEGER) AS scenario, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[user_id % 4 + 1] AS criticality
FROM (SELECT *, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS k, (['MOTOR', 'PUMP', 'COMPRESSOR', 'CONVEYOR', 'TURBINE'])[user_id % 5 + 1] AS kind,
        1704067200000000 + (epoch_us(ts) - 1704067200000000) // 7200 AS t_us FROM events)
"""

_STATS = ", ".join(f"avg({s}) OVER w AS m_{s}, coalesce(stddev_samp({s}) OVER w, 0) AS d_{s}, first_value({s}) OVER p AS baseline_{s}" for s in ("temperature", "vibration", "pressure", "current"))
_SLOPE = "CASE WHEN count(*) OVER w < 2 OR timestamp - min(timestamp) OVER w <= 1e-3 THEN 0e0 ELSE coalesce(regr_slope({0}, t_us / 1e6 - 1704067200e0) OVER w, 0) * 60 END"
PARTS["frames"] = f"""
SELECT *, count(*) OVER w AS sample_count, {_STATS}, max(vibration) OVER w AS x_vibration, {_SLOPE.format("temperature")} AS s_temperature, {_SLOPE.format("vibration")} AS s_vibration
FROM tel WINDOW w AS (PARTITION BY asset_id ORDER BY t_us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW), p AS (PARTITION BY asset_id ORDER BY t_us, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _z(s: str) -> str:
    return r(f"CASE WHEN d_{s} > 1e-3 THEN ({s} - m_{s}) / (d_{s} + 1e-5) ELSE 0e0 END", 3)


_MEANS = ", ".join(f"{r('m_' + s, 3)} AS mean_{s}, {r('d_' + s, 3)} AS std_{s}" for s in ("temperature", "vibration", "pressure", "current"))
_BASE = "coalesce(nullif(baseline_current, 0), nullif(m_current, 0), 1e0)"
PARTS["feat"] = f"""
SELECT arrival, event_id, asset_id, asset_type, t_us, timestamp, temperature, vibration, pressure, rpm, current, voltage, power, load, operating_mode, scenario, criticality,
  sample_count, baseline_temperature, baseline_vibration, baseline_pressure, baseline_current, {_MEANS}, {r("x_vibration", 3)} AS max_vibration,
  {r("s_temperature", 4)} AS thermal_rise_rate, {r("s_vibration", 4)} AS vibration_slope, {_z("temperature")} AS temperature_zscore, {_z("vibration")} AS vibration_zscore, {_z("pressure")} AS pressure_zscore,
  {r("CASE WHEN m_pressure > 1e-2 THEN d_pressure / (m_pressure + 1e-5) ELSE 0e0 END", 4)} AS pressure_instability,
  {r(f"CASE WHEN {_BASE} > 1e-2 THEN current / {_BASE} ELSE 1e0 END", 3)} AS current_ratio,
  {r("CASE WHEN voltage > 10 AND current > 1e-1 AND power > 1e-1 THEN abs(greatest(0e0, least(1e0, power / (sqrt(3e0) * voltage * current / 1000))) - 88e-2) ELSE 0e0 END", 4)} AS power_factor_deviation
FROM frames
"""
_TURBINE = "contains(asset_id, 'TURBINE')"
_LIMIT = f"CASE WHEN {_TURBINE} THEN 950e0 ELSE 120e0 END"
_RULES = {
    "a1": f"temperature > {_LIMIT}", "a2": "vibration > 12", "a3": "current_ratio > 135e-2", "a4": "thermal_rise_rate > 4", "a5": "abs(vibration_zscore) > 3 AND sample_count >= 5",
    "a6": "pressure_instability > 15e-2 AND sample_count >= 5", "a7": "vibration > 45e-1 AND vibration_slope > 15e-1", "a8": "pressure_instability > 12e-2 AND vibration > 38e-1", "a9": "current_ratio > 12e-1 AND power_factor_deviation > 5e-2",
}
PARTS["flags"] = "SELECT *, " + ", ".join(f"({v}) AS {k}" for k, v in _RULES.items()) + " FROM feat"
_COUNT = " + ".join(f"CAST({k} AS INTEGER)" for k in _RULES)
PARTS["anom"] = f"""
SELECT *, {_COUNT} AS found, (a1 OR a2) AS critical,
  CASE WHEN a1 OR a2 THEN 3 WHEN a3 OR (a4 AND thermal_rise_rate >= 8) OR (a5 AND abs(vibration_zscore) >= 45e-1) OR a7 OR a8 OR a9 THEN 2 WHEN a4 OR a5 OR a6 THEN 1 ELSE 0 END AS worst,
  CASE WHEN a7 OR a8 OR a9 THEN 3 WHEN a4 OR a5 OR a6 THEN 2 WHEN a1 OR a2 OR a3 THEN 1 ELSE 0 END AS anomaly_level
FROM flags
"""
PARTS["walks"] = """
SELECT *, sum(CASE WHEN found > 0 THEN 1 ELSE -1 END) OVER p AS walk, row_number() OVER (PARTITION BY asset_id ORDER BY t_us, arrival) AS rn FROM anom
WINDOW p AS (PARTITION BY asset_id ORDER BY t_us, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
PARTS["counts"] = """
SELECT *, CAST(walk - least(0, min(walk) OVER p) AS BIGINT) AS fault_count, CAST(rn - coalesce(max(CASE WHEN found > 0 THEN rn END) OVER p, 0) AS BIGINT) AS healthy_samples FROM walks
WINDOW p AS (PARTITION BY asset_id ORDER BY t_us, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
_T0 = f"(CASE WHEN {_TURBINE} THEN 650e0 ELSE 65e0 END)"
_HOT = f"(({_LIMIT}) - 15)".replace(_LIMIT, f"({_LIMIT})")
_HEAT = f"(CASE WHEN temperature <= {_T0} THEN 0e0 WHEN temperature < {_HOT} THEN 5e-1 * ((temperature - {_T0}) / greatest(1e0, {_HOT} - {_T0})) ELSE 5e-1 + 5e-1 * least(1e0, (temperature - {_HOT}) / 15) END)"
PARTS["parts"] = f"""
SELECT *,
  CASE WHEN vibration <= 2 THEN 0e0 WHEN vibration <= 45e-1 THEN 4e-1 * ((vibration - 2) / 25e-1) WHEN vibration < 12 THEN 4e-1 + 6e-1 * ((vibration - 45e-1) / (12 - 45e-1)) ELSE 1e0 END AS vibration_part,
  CASE WHEN thermal_rise_rate > 3 THEN least(1e0, {_HEAT} + 3e-1) ELSE {_HEAT} END AS thermal_part,
  CASE WHEN pressure_instability > 8e-2 THEN least(1e0, pressure_instability * 4) ELSE 0e0 END AS pressure_part,
  CASE WHEN current_ratio > 105e-2 THEN least(1e0, (current_ratio - 1) * 3) ELSE 0e0 END AS electrical_part,
  least(1e0, fault_count / 8e0) AS persistence_part
FROM counts
"""
_PENALTY = "35e-2 * vibration_part + 25e-2 * thermal_part + 15e-2 * pressure_part + 15e-2 * electrical_part + 1e-1 * persistence_part"
_REASONS = ", ".join([
    f"CASE WHEN vibration >= 12 THEN printf('Critical ISO Zone D vibration breach (%.2f mm/s)', {r('vibration', 2)}) WHEN vibration > 45e-1 THEN printf('Elevated vibration RMS (%.2f mm/s)', {r('vibration', 2)}) END",
    f"CASE WHEN temperature >= {_HOT} THEN printf('High thermal stress (%.1f°C)', {r('temperature', 1)}) END",
    f"CASE WHEN thermal_rise_rate > 3 THEN printf('Rapid thermal rise (%.1f°C/min)', {r('thermal_rise_rate', 1)}) END",
    f"CASE WHEN pressure_instability > 8e-2 THEN printf('Pressure hydraulic instability (%.3f)', {r('pressure_instability', 3)}) END",
    f"CASE WHEN current_ratio > 12e-1 THEN printf('Motor overcurrent draw (%.2fx rated)', {r('current_ratio', 2)}) END",
])
PARTS["scored"] = f"""
SELECT *, {r(f"greatest(0e0, least(1e0, 1 - ({_PENALTY} + least(4e-1, found * 15e-2))))", 3)} AS health_score FROM parts
"""
# the fold: state, last alert's time and severity are carried from row to row
_NEXT = """CASE WHEN s.critical OR s.health_score < 4e-1 THEN 3 ELSE
  CASE WHEN s.health_score < 5e-1 THEN ([2, 2, 2, 3])[{h} + 1] WHEN s.health_score < 65e-2 THEN 2 WHEN s.health_score < 72e-2 THEN ([1, 1, 2, 2])[{h} + 1]
       WHEN s.health_score < 85e-2 THEN ([1, 1, 1, 2])[{h} + 1] WHEN s.health_score < 9e-1 THEN ([0, 1, 1, 2])[{h} + 1] ELSE ([0, 0, 1, 2])[{h} + 1] END END"""


def _fold(source: str, prior: dict[str, str], tail: str) -> str:
    return f"""SELECT asset_id, rn, health, previous, severity, outcome, CASE WHEN outcome = 2 THEN now ELSE alert_time END AS alert_time, CASE WHEN outcome = 2 THEN severity ELSE alert_severity END AS alert_severity
    FROM (SELECT *, CASE WHEN health = 0 AND found = 0 AND NOT health < previous THEN 0
                         WHEN health <> previous OR (alert_severity >= 0 AND severity > alert_severity) OR (now - alert_time >= 30 AND (found > 0 OR health > 0)) THEN 2 ELSE 1 END AS outcome
          FROM (SELECT *, greatest(health, worst) AS severity
                FROM (SELECT s.asset_id, s.rn, CAST({_NEXT.format(h=prior["h"])} AS INTEGER) AS health, CAST({prior["h"]} AS INTEGER) AS previous, s.found, s.worst, s.t_us / 1e6 AS now,
                             {prior["t"]} AS alert_time, CAST({prior["s"]} AS INTEGER) AS alert_severity FROM {source} {tail})))"""


PARTS["fold"] = _fold("scored s", {"h": "0", "t": "0e0", "s": "-1"}, "WHERE s.rn = 1") + "\nUNION ALL\n" + _fold("fold f JOIN scored s ON s.asset_id = f.asset_id AND s.rn = f.rn + 1", {"h": "f.health", "t": "f.alert_time", "s": "f.alert_severity"}, "")
_S, _V = "(['HEALTHY', 'WATCH', 'DEGRADED', 'CRITICAL'])", "(['INFO', 'WARNING', 'HIGH', 'CRITICAL'])"
PARTS["states"] = f"""
SELECT s.*, f.health, f.previous, {_S}[f.health + 1] AS health_state, {_S}[f.previous + 1] AS previous_health_state, f.health <> f.previous AS is_state_transition, f.health < f.previous AS is_recovery,
  {_V}[f.severity + 1] AS severity, f.outcome FROM scored s JOIN fold f USING (asset_id, rn)
"""
_HEUR = r("greatest(0e0, least(1e0, 1 - health_score))", 4)
_P = f"CASE WHEN temperature > 90 OR vibration > 5 THEN least(1e0, {_HEUR} + 25e-2) ELSE {_HEUR} END"
PARTS["prog"] = f"""
SELECT *, {_P} AS failure_probability, CAST({_P} >= 5e-1 AS INTEGER) AS predicted_failure_risk, {r("greatest(0e0, least(120e0, health_score * 120))", 2)} AS predicted_rul_hours FROM states
"""
PARTS["asset_current_state"] = f"""
SELECT asset_id, asset_type, operating_mode, health_state, {r("health_score", 4)} AS health_score, failure_probability, predicted_failure_risk, predicted_rul_hours,
  CASE WHEN failure_probability >= 8e-1 OR predicted_rul_hours <= 10 OR health_state = 'CRITICAL' THEN 'EMERGENCY' WHEN failure_probability >= 6e-1 OR predicted_rul_hours <= 25 OR health_state = 'DEGRADED' THEN 'HIGH'
       WHEN failure_probability >= 35e-2 OR predicted_rul_hours <= 50 OR health_state = 'WATCH' THEN 'MEDIUM' ELSE 'LOW' END AS maintenance_priority,
  anomaly_level, active_alert_count, {r("temperature", 2)} AS temperature, {r("vibration", 3)} AS vibration, {r("pressure", 2)} AS pressure, {r("load", 2)} AS load, {r("rpm", 1)} AS rpm, {r("power", 2)} AS power,
  make_timestamp(t_us) AS last_event_time, make_timestamp(t_us) AS last_prediction_time, 'heuristic' AS model_version, criticality
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY t_us DESC, arrival DESC) AS back,
             CAST(count(*) FILTER (WHERE outcome = 2 AND NOT is_recovery) OVER (PARTITION BY asset_id) AS BIGINT) AS active_alert_count FROM prog) WHERE back = 1
"""
_SCORE = "35e-2 * (1 - greatest(0e0, least(1e0, health_score))) + 35e-2 * greatest(0e0, least(1e0, failure_probability)) + 2e-1 * greatest(0e0, least(1e0, 1 - predicted_rul_hours / 120)) + 1e-1 * CASE criticality WHEN 'LOW' THEN 1e-1 WHEN 'MEDIUM' THEN 25e-2 WHEN 'HIGH' THEN 4e-1 WHEN 'CRITICAL' THEN 5e-1 ELSE 25e-2 END"
PARTS["maintenance_priority_queue"] = f"""
SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, asset_id) AS INTEGER) AS ranking, asset_id, asset_type, criticality, health_state, health_score, failure_probability, predicted_rul_hours, maintenance_priority, priority_score,
  CASE WHEN maintenance_priority = 'EMERGENCY' OR health_state = 'CRITICAL' THEN printf('IMMEDIATE SHUTDOWN & INSPECTION: Failure imminent within %.1fh (Risk: %.1f%%)', {r('predicted_rul_hours', 1)}, {r('failure_probability * 100', 1)})
       WHEN maintenance_priority = 'HIGH' OR failure_probability >= 5e-1 THEN printf('SCHEDULE EXPEDITED OVERHAUL: Component degradation detected (RUL: %.1fh)', {r('predicted_rul_hours', 1)})
       WHEN maintenance_priority = 'MEDIUM' OR health_state = 'DEGRADED' THEN 'INSPECT WITHIN 48H: Early anomaly progression observed (Health: ' || health_state || ')'
       WHEN health_state = 'WATCH' THEN 'INCREASE TELEMETRY SAMPLING: Minor variance from baseline profile' ELSE 'NORMAL OPERATION: Continue routine scheduled lubrication and monitoring' END AS recommended_action,
  last_prediction_time AS evaluated_at
FROM (SELECT *, {r(f"greatest(0e0, least(100e0, 100 * ({_SCORE})))", 2)} AS priority_score FROM asset_current_state)
"""
PARTS["asset_prediction_history"] = "SELECT asset_id, asset_type, timestamp, make_timestamp(t_us) AS event_time, failure_probability, predicted_failure_risk, predicted_rul_hours, arrival FROM prog"
PARTS["asset_alert_history"] = "SELECT asset_id, asset_type, make_timestamp(t_us) AS event_time, timestamp, severity, previous_health_state, health_state AS current_health_state, health_score, is_state_transition, is_recovery, found, arrival FROM states WHERE outcome = 2"


def kpis(source: str, extra: str = "", group: str = "") -> str:
    return f"""SELECT {extra} count(*) AS total_assets, count(*) FILTER (WHERE health_state = 'HEALTHY') AS healthy_assets, count(*) FILTER (WHERE health_state = 'WATCH') AS watch_assets,
  count(*) FILTER (WHERE health_state = 'DEGRADED') AS degraded_assets, count(*) FILTER (WHERE health_state = 'CRITICAL') AS critical_assets, count(*) FILTER (WHERE failure_probability >= 5e-1) AS high_risk_assets,
  count(*) FILTER (WHERE predicted_rul_hours < 24) AS near_failure_assets, {r("coalesce(avg(health_score), 1e0)", 6)} AS fleet_health_score, {r("coalesce(avg(predicted_rul_hours), 120e0)", 6)} AS avg_predicted_rul_hours,
  coalesce(min(predicted_rul_hours), 120e0) AS min_predicted_rul_hours, {r("coalesce(count(*) FILTER (WHERE failure_probability >= 5e-1) / nullif(count(*), 0), 0e0)", 6)} AS failure_risk_rate,
  CAST(coalesce(sum(active_alert_count), 0) AS BIGINT) AS active_alerts_total, count(*) FILTER (WHERE maintenance_priority = 'EMERGENCY') AS emergency_maintenance_count,
  count(*) FILTER (WHERE maintenance_priority = 'HIGH') AS high_maintenance_count FROM {source} {group}"""


PARTS["batch_states"] = PARTS["asset_current_state"].replace("PARTITION BY asset_id", "PARTITION BY asset_id, t_us // 60000000").replace("SELECT asset_id,", "SELECT t_us // 60000000 AS batch, asset_id,", 1)
PARTS["fleet_kpi_snapshots"] = kpis("batch_states", "batch, make_timestamp((batch + 1) * 60000000) AS timestamp,", "GROUP BY batch")


def needs(text: str, own: dict[str, str] | None = None) -> list[str]:
    """Names of the parts (of ``own``, where given) that a text reads, those they read first."""
    known, found = own or PARTS, []

    def visit(sql: str, own: str) -> None:
        for name in known:
            if name != own and name not in found and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", sql):
                visit(known[name], name)
                found.append(name)

    visit(text, "")
    return found


def sql(text: str, instead: dict[str, str] | None = None) -> str:
    """``text`` with the parts that it reads in front; those of ``instead`` stand for parts of their name."""
    known = PARTS | (instead or {})
    parts = needs(text, known)
    recursive = "RECURSIVE " if "fold" in parts else ""
    heads = [f"{p} AS ({known[p].strip()})" if p != "fold" else f"fold (asset_id, rn, health, previous, severity, outcome, alert_time, alert_severity) AS ({known[p].strip()})" for p in parts]
    return (f"WITH {recursive}" + ",\n".join(heads) + "\n" if parts else "") + text.strip()


REASONS = f"list_filter([{_REASONS}], lambda x: x IS NOT NULL)"
