"""Thresholds and weights. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

ASSET_TYPES = ("MOTOR", "PUMP", "COMPRESSOR", "CONVEYOR", "TURBINE")
MODES = ("IDLE", "STARTUP", "NORMAL", "HIGH_LOAD", "MAINTENANCE", "DEGRADED")
STATES = ("HEALTHY", "WATCH", "DEGRADED", "CRITICAL")
SEVERITIES = ("INFO", "WARNING", "HIGH", "CRITICAL")
SENSORS = ("temperature", "vibration", "pressure", "rpm", "current", "voltage", "power", "load")
CRITICALITY = {"LOW": 0.1, "MEDIUM": 0.25, "HIGH": 0.4, "CRITICAL": 0.5}


@dataclass(frozen=True)
class Thresholds:
    frame_seconds: int = 30
    buffer_samples: int = 120
    watermark_delay: float = 5.0
    allowed_lateness: float = 30.0
    temperature_limit: float = 120.0
    turbine_limit: float = 950.0
    vibration_limit: float = 12.0
    overcurrent: float = 1.35
    thermal_rise: float = 4.0
    vibration_z: float = 3.0
    pressure_cv: float = 0.15
    weights: tuple[float, float, float, float, float] = (0.35, 0.25, 0.15, 0.15, 0.10)
    cooldown_seconds: float = 30.0
    near_failure_hours: float = 24.0
    rul_cap_hours: float = 120.0


DEFAULTS = Thresholds()
