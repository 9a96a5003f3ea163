"""Telemetry out of an event table, and as raw JSON with defects for quality tests."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assethealth.config import ASSET_TYPES

T0 = 1704067200000000  # 2024-01-01 in microseconds
#: Gaps between an asset's events shrink by this, to about five seconds.
COMPRESSION = 7200


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is read from a file's footer once a session and path, which saves later reads a job."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/events.parquet")


def from_events(rows: DataFrame) -> DataFrame:
    """One telemetry sample an event; an asset is a user, and time runs 7200 times faster.

    ``arrival`` is the event_id and ``t_us`` the event time in microseconds.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    u, v = F.col("user_id"), F.col("value")
    kind = F.element_at(F.array(*[F.lit(t) for t in ASSET_TYPES]), (u % 5 + 1).cast("int"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    name = F.concat(kind, F.lit("-"), F.lpad(u.cast("string"), F.greatest(F.lit(3), F.length(u.cast("string"))), F.lit("0")))
    current = 48 + 0.05 * k + v / 20
    mode = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "NORMAL", "click", "HIGH_LOAD", "purchase", "STARTUP", "signup", "IDLE", "error", "DEGRADED")]), F.col("event_type"))
    return rows.select(
        F.col("event_id").alias("arrival"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        name.alias("asset_id"),
        kind.alias("asset_type"),
        (T0 + F.expr(f"(unix_micros(cast(ts as timestamp)) - {T0}L) div {COMPRESSION}")).alias("t_us"),
        (62 + 0.04 * k + 0.25 * F.greatest(F.lit(0.0), v - 150) + F.when(kind == "TURBINE", 600).otherwise(0)).alias("temperature"),
        (1 + v / 40).alias("vibration"),
        ((5 + 0.012 * k) * F.when(F.col("event_type") == "error", 0.75).otherwise(1.0)).alias("pressure"),
        F.lit(1750.0).alias("rpm"),
        current.alias("current"),
        F.lit(400.0).alias("voltage"),
        (0.88 * sqrt(3.0) * 400 * current / 1000 - 0.02 * k * F.when(v > 120, 2).otherwise(1)).alias("power"),
        F.least(F.lit(100.0), 50 + 0.5 * k).alias("load"),
        mode.alias("operating_mode"),
        (u % 8 + 1).cast("int").alias("scenario"),
        F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), (u % 4 + 1).cast("int")).alias("criticality"),
        micros.alias("source_us"),
    ).withColumn("timestamp", F.col("t_us") / 1e6).drop("source_us")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(events(spark, sf_dir))
