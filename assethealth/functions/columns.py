"""Scalar expressions shared by batch and streaming queries."""

from __future__ import annotations

from collections.abc import Mapping
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` places; halves go up, also where binary noise puts them just below."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.500001) / scale


def rounded_exactly(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` places as Python's ``round`` does: by its exact binary value, halves to even.

    The product with the power of ten and the product's own error (Dekker's
    splitting) make up the exact product, so a half is told from what only
    looks like one. Null, not finite and too large values stay as they are.
    """
    scale = 10.0**digits
    high = 134217729.0 * scale - (134217729.0 * scale - scale)
    x = x.cast("double")
    product = x * scale
    upper = 134217729.0 * x - (134217729.0 * x - x)
    error = ((upper * high - product) + upper * (scale - high) + (x - upper) * high) + (x - upper) * (scale - high)
    whole = F.rint(product)
    rest = product - whole
    step = F.when((rest == 0.5) & (error > 0), 1.0).when((rest == -0.5) & (error < 0), -1.0).otherwise(0.0)
    return F.when(F.abs(product) < 2.0**51, (whole + step) / scale).otherwise(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def looked_up(x: Column, names: Mapping[str, object], default: object) -> Column:
    """``names[x]``, or ``default`` for other and null values."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(x, F.lit(""))), F.lit(default))


def epoch_seconds(timestamp: Column, event_time: Column) -> Column:
    """Event time: a numeric timestamp wins over ISO-8601 text; null if there is neither."""
    iso = F.unix_micros(F.try_to_timestamp(event_time)) / 1e6
    return F.coalesce(timestamp.try_cast("double"), iso)


def epoch_millis(value: Column) -> Column:
    """Seconds (below 1e11), milliseconds, numeric text or ISO-8601 text as milliseconds; null if it is none of these."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.when(number < 1e11, number * 1000).otherwise(number)).otherwise(F.unix_millis(F.try_to_timestamp(value))).cast("long")


def asset_type_or_default(asset_type: Column, asset_id: Column) -> Column:
    prefix = F.when(F.instr(asset_id, "-") > 0, F.substring_index(asset_id, "-", 1))
    return F.coalesce(asset_type, prefix, F.lit("GENERIC"))


def power_factor_deviation(voltage: Column, current: Column, power: Column) -> Column:
    apparent = sqrt(3.0) * voltage * current / 1000
    return F.when((voltage > 10) & (current > 0.1) & (power > 0.1), F.abs(clamp(power / apparent) - 0.88)).otherwise(0.0)


PRIORITIES = {"NORMAL": "LOW", "SCHEDULED": "MEDIUM", "URGENT": "HIGH", "EMERGENCY": "EMERGENCY", "CRITICAL": "EMERGENCY", "LOW": "LOW", "MEDIUM": "MEDIUM", "HIGH": "HIGH"}


def serving_priority_name(priority: Column) -> Column:
    return looked_up(F.upper(priority), PRIORITIES, "LOW")


def severity_name(severity: Column) -> Column:
    return looked_up(F.upper(severity), {s: s for s in ("INFO", "WARNING", "HIGH", "CRITICAL")}, "WARNING")


def health_name(state: Column) -> Column:
    return looked_up(F.upper(state), {s: s for s in ("HEALTHY", "WATCH", "DEGRADED", "CRITICAL")}, "HEALTHY")


def iso_utc(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def trigger_values() -> Column:
    """Sensors that have a value, to two places, by name."""
    names = ("temperature", "vibration", "pressure", "current", "voltage", "power")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), rounded_exactly(F.col(n), 2).alias("value")) for n in names])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def supporting_features() -> Column:
    names = {
        "thermal_rise_rate": "thermal_rise_rate", "vibration_slope": "vibration_slope", "pressure_instability": "pressure_instability", "current_ratio": "current_ratio",
        "vibration_zscore": "vibration_zscore", "mean_vibration": "mean_vibration", "mean_temperature": "mean_temperature",
    }
    return F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.col(v))])


def stable_id(prefix: str, *parts: Column, length: int = 6) -> Column:
    """An id that reruns agree on: the prefix, the parts, and the start of their SHA-256."""
    text = [p.cast("string") for p in parts]
    return F.concat_ws("-", F.lit(prefix), *text, F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, length))


def rul_horizon(hours: Column) -> Column:
    return (
        F.when(hours < 24, "IMMEDIATE (< 24h)")
        .when(hours.between(24, 72), "SHORT_TERM (24-72h)")
        .when(hours.between(72, 120), "MEDIUM_TERM (72-120h)")
        .otherwise("LONG_TERM (> 120h)")
    )


