"""Health sub-scores, the composite score and its reasons, as columns over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assethealth.config import DEFAULTS, Thresholds
from assethealth.functions.anomaly import is_turbine, temperature_limit
from assethealth.functions.columns import clamp, looked_up, rounded


def vibration_part(t: Thresholds = DEFAULTS) -> Column:
    v = F.col("vibration")
    return F.when(v <= 2, 0.0).when(v <= 4.5, 0.4 * ((v - 2) / 2.5)).when(v < t.vibration_limit, 0.4 + 0.6 * ((v - 4.5) / (t.vibration_limit - 4.5))).otherwise(1.0)


def thermal_part(t: Thresholds = DEFAULTS) -> Column:
    temp, limit = F.col("temperature"), temperature_limit(t)
    base = F.when(is_turbine(), 650.0).otherwise(65.0)
    hot = limit - 15
    part = F.when(temp <= base, 0.0).when(temp < hot, 0.5 * ((temp - base) / F.greatest(F.lit(1.0), hot - base))).otherwise(0.5 + 0.5 * F.least(F.lit(1.0), (temp - hot) / 15))
    return F.when(F.col("thermal_rise_rate") > 3, F.least(F.lit(1.0), part + 0.3)).otherwise(part)


def pressure_part() -> Column:
    cv = F.col("pressure_instability")
    return F.when(cv > 0.08, F.least(F.lit(1.0), cv * 4)).otherwise(0.0)


def electrical_part() -> Column:
    ratio = F.col("current_ratio")
    return F.when(ratio > 1.05, F.least(F.lit(1.0), (ratio - 1) * 3)).otherwise(0.0)


def persistence_part() -> Column:
    return F.least(F.lit(1.0), F.col("fault_count") / 8)


def composite(t: Thresholds = DEFAULTS) -> Column:
    """1 less the weighted parts and 0.15 for each anomaly (0.4 at most), to three places."""
    a, b, c, d, e = t.weights
    penalty = a * F.col("vibration_part") + b * F.col("thermal_part") + c * F.col("pressure_part") + d * F.col("electrical_part") + e * F.col("persistence_part")
    return rounded(clamp(1 - (penalty + F.least(F.lit(0.4), F.size("anomalies") * 0.15))), 3)


def reasons(t: Thresholds = DEFAULTS) -> Column:
    """Degradation reasons in their fixed order."""
    # fixed values: the texts
    c = F.col
    found = [
        F.when(c("vibration") >= t.vibration_limit, F.format_string("Critical ISO Zone D vibration breach (%.2f mm/s)", rounded(c("vibration"), 2))).when(c("vibration") > 4.5, F.format_string("Elevated vibration RMS (%.2f mm/s)", rounded(c("vibration"), 2))),
        F.when(c("temperature") >= temperature_limit(t) - 15, F.format_string("High thermal stress (%.1f°C)", rounded(c("temperature"), 1))),
        F.when(c("thermal_rise_rate") > 3, F.format_string("Rapid thermal rise (%.1f°C/min)", rounded(c("thermal_rise_rate"), 1))),
        F.when(c("pressure_instability") > 0.08, F.format_string("Pressure hydraulic instability (%.3f)", rounded(c("pressure_instability"), 3))),
        F.when(c("current_ratio") > 1.2, F.format_string("Motor overcurrent draw (%.2fx rated)", rounded(c("current_ratio"), 2))),
    ]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def streaming_priority(state: Column) -> Column:
    return looked_up(state, {"CRITICAL": "EMERGENCY", "DEGRADED": "URGENT", "WATCH": "SCHEDULED"}, "NORMAL")
