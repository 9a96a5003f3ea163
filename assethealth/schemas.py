"""Fixed schemas of the inputs and tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _NUMBER, _WHOLE, _TIME = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


METADATA = _struct(scenario_id=_TEXT, maintenance_state=_TEXT, is_synthetic=T.BooleanType(), ground_truth_rul_hours=_NUMBER)
TELEMETRY = _struct(
    event_id=_TEXT, asset_id=_TEXT, asset_type=_TEXT, timestamp=_NUMBER, event_time=_TIME, ingestion_time=_TIME, temperature=_NUMBER, vibration=_NUMBER, pressure=_NUMBER,
    rpm=_NUMBER, current=_NUMBER, voltage=_NUMBER, power=_NUMBER, load=_NUMBER, operating_mode=_TEXT, sequence_number=_WHOLE, schema_version=_TEXT,
)
RAW = _struct(raw=_TEXT, arrival=_WHOLE)
MAINTENANCE = _struct(maintenance_id=_TEXT, asset_id=_TEXT, maintenance_type=_TEXT, scenario_id=_TEXT, description=_TEXT, technician_id=_TEXT, performed_at=_TIME, cost_usd=_NUMBER)
REGISTRY = _struct(asset_id=_TEXT, asset_type=_TEXT, model_name=_TEXT, criticality=_TEXT, created_at=_TIME, updated_at=_TIME)
PREDICTIONS = _struct(
    prediction_id=_TEXT, asset_id=_TEXT, asset_type=_TEXT, timestamp=_NUMBER, event_time=_TIME, failure_probability=_NUMBER, predicted_failure_risk=T.IntegerType(),
    predicted_rul_hours=_NUMBER, maintenance_priority=_TEXT, top_features_summary=_TEXT, model_version=_TEXT,
)
ALERTS = _struct(
    alert_id=_TEXT, asset_id=_TEXT, asset_type=_TEXT, event_time=_TIME, severity=_TEXT, previous_health_state=_TEXT, health_state=_TEXT, health_score=_NUMBER,
    is_state_transition=T.BooleanType(), is_recovery=T.BooleanType(), reason_codes=_TEXT, triggering_values=_TEXT, maintenance_priority=_TEXT,
)

CURRENT_STATE = _struct(
    asset_id=_TEXT, asset_type=_TEXT, operating_mode=_TEXT, health_state=_TEXT, health_score=_NUMBER, failure_probability=_NUMBER, predicted_failure_risk=T.IntegerType(),
    predicted_rul_hours=_NUMBER, maintenance_priority=_TEXT, active_alert_count=_WHOLE, last_event_time=_TIME, last_prediction_time=_TIME, model_version=_TEXT,
)

#: Keys that every raw event must have.
REQUIRED = (
    "asset_id", "asset_type", "current", "event_id", "load", "operating_mode", "power",
    "pressure", "rpm", "sequence_number", "temperature", "timestamp", "vibration", "voltage",
)
#: Keys that must hold numbers, in the order in which offenders are looked for.
NUMERIC = ("timestamp", "temperature", "vibration", "pressure", "rpm", "current", "voltage", "power", "load")
