"""The nine anomaly rules, as columns over one row of features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assethealth.config import DEFAULTS, Thresholds
from assethealth.functions.columns import rounded

KIND = "struct<anomaly_type:string,level:int,severity:string,reason_code:string,triggering_value:double,threshold_value:double,timestamp:double>"


def is_turbine() -> Column:
    return F.col("asset_id").contains("TURBINE")


def temperature_limit(t: Thresholds = DEFAULTS) -> Column:
    return F.when(is_turbine(), t.turbine_limit).otherwise(t.temperature_limit)


def rules(t: Thresholds = DEFAULTS) -> list[tuple[str, int, Column, str, Column, Column, Column]]:
    """(type, level, condition, reason code, severity, triggering value, threshold) in rule order."""
    c = F.col
    enough = c("sample_count") >= 5
    fixed = F.lit
    either = lambda low: F.when(low, "WARNING").otherwise("HIGH")
    return [
        ("L1_TEMPERATURE_TRIP", 1, c("temperature") > temperature_limit(t), "ERR_L1_TEMP_EXCEEDED", fixed("CRITICAL"), c("temperature"), temperature_limit(t)),
        ("L1_VIBRATION_CRITICAL_ISO", 1, c("vibration") > t.vibration_limit, "ERR_L1_VIB_ZONE_D", fixed("CRITICAL"), c("vibration"), fixed(t.vibration_limit)),
        ("L1_OVERCURRENT_TRIP", 1, c("current_ratio") > t.overcurrent, "ERR_L1_OVERCURRENT", fixed("HIGH"), c("current"), F.coalesce(F.nullif(c("baseline_current"), fixed(0.0)), fixed(100.0))),
        ("L2_THERMAL_RISE_RATE", 2, c("thermal_rise_rate") > t.thermal_rise, "WARN_L2_RAPID_HEATING", either(c("thermal_rise_rate") < 8), c("thermal_rise_rate"), fixed(t.thermal_rise)),
        ("L2_VIBRATION_ZSCORE_DEVIATION", 2, (F.abs("vibration_zscore") > t.vibration_z) & enough, "WARN_L2_VIB_STATISTICAL_DEVIATION", either(F.abs("vibration_zscore") < 4.5), c("vibration_zscore"), fixed(t.vibration_z)),
        ("L2_PRESSURE_INSTABILITY", 2, (c("pressure_instability") > t.pressure_cv) & enough, "WARN_L2_PRESSURE_VARIANCE", fixed("WARNING"), c("pressure_instability"), fixed(t.pressure_cv)),
        ("L3_BEARING_DEGRADATION", 3, (c("vibration") > 4.5) & (c("vibration_slope") > 1.5), "FAULT_L3_BEARING_FRICTION_COUPLING", fixed("HIGH"), c("vibration"), fixed(4.5)),
        ("L3_FLUID_CAVITATION", 3, (c("pressure_instability") > 0.12) & (c("vibration") > 3.8), "FAULT_L3_CAVITATION_SHOCKWAVES", fixed("HIGH"), c("pressure_instability"), fixed(0.12)),
        ("L3_ELECTRICAL_STATOR_IMBALANCE", 3, (c("current_ratio") > 1.2) & (c("power_factor_deviation") > 0.05), "FAULT_L3_WINDING_ASYMMETRY", fixed("HIGH"), c("current_ratio"), fixed(1.2)),
    ]


def anomalies(t: Thresholds = DEFAULTS) -> Column:
    """The rules that hold, in rule order, as an array of structs (KIND). Null sensors trip nothing."""
    found = [
        F.when(when, F.struct(F.lit(name), F.lit(level), severity, F.lit(code), rounded(value, 2), rounded(limit, 2), F.col("timestamp")).cast(KIND))
        for name, level, when, code, severity, value, limit in rules(t)
    ]
    return F.filter(F.array(*found), lambda a: a.isNotNull())


def highest_level(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda a: a["level"])), F.lit(0))
