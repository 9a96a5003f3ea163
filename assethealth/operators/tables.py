"""Writes with semantics: last write wins, replace, append once a batch, run ledger; and the lake table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assethealth.config import SENSORS
from assethealth.schemas import TELEMETRY


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both tables, one a key, the one with the largest ``version``; ``new`` wins ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def upserted_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` registry rows over ``old`` ones by asset_id; an asset keeps its first created_at."""
    columns = [c for c in old.columns if c not in ("asset_id", "created_at")]
    joined = old.alias("o").join(new.alias("n"), "asset_id", "full_outer")
    pick = [F.when(F.col("n.updated_at").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return joined.select("asset_id", *pick, F.coalesce("o.created_at", "n.created_at").alias("created_at"))


def append_once(df: DataFrame, path: str, batch_id: int, partition_by: str | None = None) -> None:
    """Append as the partition of its batch: a batch that is written again replaces itself."""
    columns = ["batch_id", *([partition_by] if partition_by else [])]
    writer = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*columns).option("compression", "zstd").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def normalised(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed lake columns with defaults: type MOTOR, mode NORMAL, sensors 0, version 1.0.0, bad or absent times now."""
    clock = now if now is not None else F.current_timestamp()
    present = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    defaults = {"asset_type": "MOTOR", "operating_mode": "NORMAL", "schema_version": "1.0.0"}
    out = []
    for f in TELEMETRY:
        if f.name in SENSORS:
            c = F.coalesce(present(f.name).try_cast("double"), F.lit(0.0))
        elif f.name in defaults:
            c = F.coalesce(present(f.name).cast("string"), F.lit(defaults[f.name]))
        elif f.name in ("event_time", "ingestion_time"):
            c = F.coalesce(F.try_to_timestamp(present(f.name).cast("string")), clock)
        else:
            c = present(f.name).try_cast(f.dataType)
        out.append(c.alias(f.name))
    return rows.select(*out)


#: Folders of a telemetry table of many assets.
BUCKETS = 64


def bucket(asset_id: Column, buckets: int = BUCKETS) -> Column:
    """Number of the folder that an asset's rows are in."""
    return F.pmod(F.xxhash64(asset_id), F.lit(buckets)).cast("int")


def append_lake(rows: DataFrame, path: str, buckets: int | None = None) -> None:
    """Append to the telemetry table: one folder an asset, or assets dealt over ``buckets`` folders and in order within, so that files and folders do not grow with their number."""
    if buckets:
        rows = rows.withColumn("bucket", bucket(F.col("asset_id"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "asset_id", "timestamp")
    else:
        rows = rows.repartition("asset_id")
    rows.write.mode("append").partitionBy("bucket" if buckets else "asset_id").option("compression", "zstd").parquet(path)


def scan(
    spark: SparkSession, path: str, asset_id: str | None = None, min_ts: float | None = None, max_ts: float | None = None, fields: list[str] | None = None, limit: int | None = None, buckets: int | None = None,
) -> DataFrame:
    """Rows of the telemetry table (written with ``buckets``) within inclusive bounds; conditions and fields reach the files, and an asset its folder."""
    if buckets:
        rows = spark.read.schema(T.StructType([*TELEMETRY, T.StructField("bucket", T.IntegerType())])).parquet(path)
        rows = (rows if asset_id is None else rows.where(F.col("bucket") == bucket(F.lit(asset_id), buckets))).drop("bucket")
    else:
        rows = spark.read.schema(TELEMETRY).parquet(path)
    for given, condition in ((asset_id, lambda v: F.col("asset_id") == v), (min_ts, lambda v: F.col("timestamp") >= v), (max_ts, lambda v: F.col("timestamp") <= v)):
        if given is not None:
            rows = rows.where(condition(given))
    rows = rows.select(*fields) if fields else rows
    return rows.limit(limit) if limit is not None else rows


def provision(spark: SparkSession, database: str, tables: dict[str, tuple[object, str | None]], place: str | None = None) -> None:
    """Create the tables that are not there yet, in the warehouse or at ``place``: schema and partition column by name."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{place}'" if place else ""))
    for name, (schema, partition) in tables.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet {f'PARTITIONED BY ({partition})' if partition else ''} OPTIONS (compression 'zstd')")


def run_ledger(checked: DataFrame, run_id: str = "run") -> DataFrame:
    """One completed ledger row of an ingestion run."""
    return checked.agg(F.count("*").alias("events_generated"), F.count_if("is_valid").alias("events_valid"), F.count_if(~F.col("is_valid")).alias("events_quarantined")).select(
        F.lit(run_id).alias("run_id"), "events_generated", "events_valid", "events_quarantined", F.when(F.col("events_generated") > 0, "COMPLETED").otherwise("EMPTY").alias("status")
    )


def result_summary(rows: DataFrame, query_id: str) -> DataFrame:
    """What a result export says beside its rows: ``query_id, status, row_count, column_count, columns``."""
    names = rows.columns
    return rows.agg(F.count("*").alias("row_count")).select(F.lit(query_id).alias("query_id"), F.lit("SUCCESS").alias("status"), "row_count", F.lit(len(names)).alias("column_count"), F.lit(",".join(names)).alias("columns"))


def commit_history(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a table that ``append_once`` writes: batch, time, rows and files."""
    rows = spark.read.parquet(path).select("batch_id", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("batch_id").agg(F.max("at").alias("committed_at"), F.count("*").alias("rows"), F.count_distinct("file").alias("files"))
