"""Queries of data quality, lake reads, writes and reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assethealth.operators import commits, ingest, quality, tables, windows
from assethealth.plans.oracle import PARTS, exact
from assethealth.plans.queries import SUMMARY, add, c, current, flagged, stored_current, stored_history, stored_queue, stored_snapshots, table
from assethealth.plans.raw_events import with_defects
from assethealth.plans.store import stored
from assethealth.schemas import ALERTS, CURRENT_STATE, PREDICTIONS, TELEMETRY
from assethealth.sources import relational
from assethealth.sources.scratch import scratch
from assethealth.sources.telemetry import telemetry

#: Time that delays are measured against, in epoch seconds.
NOW = 1704067500


def raw(s: SparkSession, d: str) -> DataFrame:
    return with_defects(telemetry(s, d))


# judged once for a session, as an ingestion run does, and read by the queries
checked = stored("checked", lambda s, d: quality.validated(raw(s, d), F.lit(float(NOW))))
# parsed once: a condition on what is worked out from fields would else be sent down to the text, and parse it again for each field
fields = stored("fields", lambda s, d: quality.parsed(raw(s, d)).drop("v", "raw"))


PARTS["ranked"] = "SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY arrival) - 1 AS seq, arrival % 97 AS m FROM tel"
# repeats come after all samples, so that no two events share an arrival
PARTS["step"] = "SELECT greatest(1000000, coalesce(max(arrival) + 1, 0)) AS step FROM tel"
PARTS["copies"] = """SELECT * FROM ranked UNION ALL SELECT * EXCLUDE (step) REPLACE (arrival + step AS arrival) FROM ranked CROSS JOIN step WHERE arrival % 101 = 0
UNION ALL SELECT * EXCLUDE (step) REPLACE (arrival + 2 * step AS arrival, event_id || 'b' AS event_id) FROM ranked CROSS JOIN step WHERE arrival % 103 = 0
UNION ALL SELECT * EXCLUDE (step) REPLACE (arrival + 3 * step AS arrival, event_id || 'b' AS event_id, timestamp + 5e-1 AS timestamp) FROM ranked CROSS JOIN step WHERE arrival % 103 = 0"""
PARTS["typed"] = """SELECT arrival, m, m NOT IN (8, 12) AS fits, CASE WHEN m NOT IN (8, 12) THEN event_id END AS event_id, CASE WHEN m NOT IN (8, 12) THEN asset_id END AS asset_id,
  CASE WHEN m = 2 THEN -5 ELSE timestamp END AS ts, CASE WHEN m = 4 THEN 25005e-1 WHEN m = 11 THEN NULL ELSE temperature END AS temperature, CASE WHEN m = 6 THEN -24e-1 ELSE vibration END AS vibration, pressure,
  CASE WHEN m = 0 THEN NULL WHEN m = 5 THEN 60000 ELSE rpm END AS rpm, current, CASE WHEN m = 1 THEN NULL WHEN m = 7 THEN -1 ELSE voltage END AS voltage, power, load,
  CASE WHEN m = 3 THEN 'TURBO' ELSE operating_mode END AS operating_mode, asset_type, CASE WHEN m = 10 THEN 0 ELSE seq END AS seq FROM copies"""
PARTS["ruled"] = """SELECT *, list_filter([CASE WHEN NOT fits THEN 'DQ-011' END, CASE WHEN fits AND m = 0 THEN 'DQ-001' END, CASE WHEN fits AND (temperature IS NULL OR voltage IS NULL) THEN 'DQ-002' END,
  CASE WHEN fits AND (ts <= 0 OR ts < 1577836800 OR ts > 2051222400) THEN 'DQ-003' END, CASE WHEN fits AND operating_mode NOT IN ('IDLE', 'STARTUP', 'NORMAL', 'HIGH_LOAD', 'MAINTENANCE', 'DEGRADED') THEN 'DQ-004' END,
  CASE WHEN fits AND (temperature < -50 OR temperature > 1500 OR pressure < 0 OR pressure > 2000 OR load < 0 OR load > 200) THEN 'DQ-005' END, CASE WHEN fits AND (rpm < 0 OR rpm > 50000) THEN 'DQ-006' END,
  CASE WHEN fits AND vibration < 0 THEN 'DQ-007' END, CASE WHEN fits AND (voltage < 0 OR current < 0 OR power < 0) THEN 'DQ-008' END], lambda x: x IS NOT NULL) AS found FROM typed"""
PARTS["named"] = f"SELECT *, CASE WHEN fits THEN {exact('ts', 3)} END AS moment FROM ruled"
# sound events that come first by id and by asset and time are valid; what shares either with them goes, and the rest has its turn
PARTS["firsts"] = """WITH RECURSIVE turn AS (
  SELECT arrival, event_id, asset_id, moment, FALSE AS won FROM named WHERE len(found) = 0 UNION ALL
  SELECT arrival, event_id, asset_id, moment, won FROM (SELECT *, bool_or(won) OVER (PARTITION BY event_id) OR bool_or(won) OVER (PARTITION BY asset_id, moment) AS gone
    FROM (SELECT arrival, event_id, asset_id, moment, arrival = min(arrival) OVER (PARTITION BY event_id) AND arrival = min(arrival) OVER (PARTITION BY asset_id, moment) AS won FROM turn WHERE NOT won)) WHERE won OR NOT gone)
SELECT * FROM turn WHERE won"""
PARTS["timed"] = """SELECT n.*, coalesce(i.arrival < n.arrival, FALSE) AS again_id, coalesce(t.arrival < n.arrival, FALSE) AS again_time
FROM named n LEFT JOIN firsts i ON i.event_id = n.event_id LEFT JOIN firsts t ON t.asset_id = n.asset_id AND t.moment = n.moment"""
PARTS["verdicts"] = "SELECT *, list_concat(found, list_filter([CASE WHEN again_id THEN 'DQ-009' END, CASE WHEN again_time THEN 'DQ-010' END], lambda x: x IS NOT NULL)) AS violations FROM timed"
PARTS["checked"] = f"""SELECT *, len(violations) = 0 AS is_valid, coalesce(fits AND {NOW} - ts > 30, FALSE) AS is_delayed,
  coalesce(fits AND seq <= coalesce(max(CASE WHEN len(violations) = 0 THEN seq END) OVER (PARTITION BY asset_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), FALSE) AS is_out_of_order FROM verdicts"""

RULES = {1: "required_fields", 2: "data_types", 3: "timestamp", 4: "operating_mode", 5: "impossible_values", 6: "rpm", 7: "vibration", 8: "electrical", 9: "duplicate_event", 10: "duplicate_time", 11: "malformed_json"}
for n, name in RULES.items():
    add(f"q{n}_{name}", lambda s, d, n=n: checked(s, d).where(F.array_contains("violations", f"DQ-{n:03}")).select("arrival"), f"SELECT arrival FROM checked WHERE list_contains(violations, 'DQ-{n:03}')")
add("q12_delayed", lambda s, d: checked(s, d).select("arrival", "is_delayed"), "SELECT arrival, is_delayed FROM checked")
add("q13_out_of_order", lambda s, d: checked(s, d).where("is_out_of_order").select("arrival", "asset_id"), "SELECT arrival, asset_id FROM checked WHERE is_out_of_order")
add("q14_verdicts", lambda s, d: checked(s, d).select("arrival", "is_valid", F.array_join("violations", ",").alias("violations")), "SELECT arrival, is_valid, array_to_string(violations, ',') AS violations FROM checked")
add("q15_violation_counts", lambda s, d: quality.violation_counts(checked(s, d)), "SELECT rule_code, count(*) AS n FROM (SELECT unnest(CASE WHEN is_valid THEN ['VALID'] ELSE violations END) AS rule_code FROM checked) GROUP BY rule_code")
BREACHES = [f"CASE WHEN NOT coalesce({f} BETWEEN {lo} AND {hi}, FALSE) THEN '{f}' END" for f, (lo, hi) in quality.BOUNDS.items()]
BREACHES += ["CASE WHEN NOT coalesce(regexp_matches(asset_id, '^(MOTOR|PUMP|COMPRESSOR|CONVEYOR|TURBINE)-[0-9]{3}$'), FALSE) THEN 'asset_id' END", "CASE WHEN operating_mode = 'TURBO' THEN 'operating_mode' END"]
add("q16_telemetry_contract", lambda s, d: quality.contract_breaches(fields(s, d).where("keys IS NOT NULL")).where(F.size("breaches") > 0).select("arrival", F.array_join("breaches", ",").alias("breaches")),
    f"SELECT arrival, array_to_string(list_sort(b), ',') AS breaches FROM (SELECT arrival, list_filter([{', '.join(BREACHES)}], lambda x: x IS NOT NULL) AS b FROM typed WHERE fits) WHERE len(b) > 0")


def services(s: SparkSession, d: str) -> DataFrame:
    """Maintenance records out of orders, some of them broken."""
    m = c("o_orderkey") % 11
    kinds = F.array(*[F.lit(k) for k in (*quality.MAINTENANCE_TYPES, "REPAINT")])
    return table("orders")(s, d).select(
        c("o_orderkey").alias("maintenance_id"), F.when(m != 1, c("o_custkey")).alias("asset_id"), F.element_at(kinds, (c("o_orderkey") % 6 + 1).cast("int")).alias("maintenance_type"), c("o_orderdate").alias("performed_at"),
        F.lit("tech").alias("technician_id"), F.lit("service").alias("description"), F.when(m == 2, -c("o_totalprice")).otherwise(c("o_totalprice")).alias("cost_usd"), F.when(m == 3, -1.0).otherwise(2.0).alias("downtime_hours"),
    )


add("q17_maintenance_contract", lambda s, d: quality.maintenance_breaches(services(s, d)).select("maintenance_id", F.array_join("breaches", ",").alias("breaches")),
    "SELECT o_orderkey AS maintenance_id, array_to_string(list_filter([CASE WHEN o_orderkey % 11 = 1 THEN 'asset_id' END, CASE WHEN o_orderkey % 11 = 2 THEN 'cost_usd' END, CASE WHEN o_orderkey % 11 = 3 THEN 'downtime_hours' END, CASE WHEN o_orderkey % 6 = 5 THEN 'maintenance_type' END], lambda x: x IS NOT NULL), ',') AS breaches FROM orders")
NEWEST = "SELECT 'q-' || arrival AS quarantine_id, coalesce(event_id, 'UNKNOWN') AS event_id, coalesce(asset_id, 'UNKNOWN') AS asset_id, arrival FROM checked WHERE NOT is_valid"
add("q18_quarantine_listing", lambda s, d: quality.quarantined(checked(s, d)).orderBy(F.desc("arrival")).limit(20).select("quarantine_id", "event_id", "asset_id", "arrival"), f"{NEWEST} ORDER BY arrival DESC LIMIT 20")
add("u9_run_ledger", lambda s, d: tables.run_ledger(checked(s, d)), "SELECT 'run' AS run_id, count(*) AS events_generated, count(*) FILTER (WHERE is_valid) AS events_valid, count(*) FILTER (WHERE NOT is_valid) AS events_quarantined, 'COMPLETED' AS status FROM checked")
add("u10_quality_log", lambda s, d: quality.quality_log(checked(s, d)).select("event_id", "asset_id", "rule_code", "severity"), "SELECT coalesce(event_id, 'UNKNOWN') AS event_id, coalesce(asset_id, 'UNKNOWN') AS asset_id, unnest(violations) AS rule_code, 'ERROR' AS severity FROM checked WHERE NOT is_valid")
add("u11_quarantine", lambda s, d: quality.quarantined(checked(s, d)).select("quarantine_id", "event_id", "asset_id", "violated_rules", "arrival"), "SELECT 'q-' || arrival AS quarantine_id, coalesce(event_id, 'UNKNOWN') AS event_id, coalesce(asset_id, 'UNKNOWN') AS asset_id, '[\"' || array_to_string(violations, '\",\"') || '\"]' AS violated_rules, arrival FROM checked WHERE NOT is_valid")
# -- lake and relational reads ---------------------------------------------------

add("s6_lake_normalisation", lambda s, d: tables.normalised(telemetry(s, d).select("arrival", "event_id", "asset_id", F.when(c("arrival") % 5 > 0, c("asset_type")).alias("asset_type"), "timestamp", F.when(c("arrival") % 7 > 0, c("temperature")).alias("temperature"), "vibration")).select("event_id", "asset_id", "asset_type", "timestamp", "temperature", "vibration", "pressure", "operating_mode", "schema_version"),
    "SELECT event_id, asset_id, CASE WHEN arrival % 5 > 0 THEN asset_type ELSE 'MOTOR' END AS asset_type, timestamp, CASE WHEN arrival % 7 > 0 THEN temperature ELSE 0e0 END AS temperature, vibration, 0e0 AS pressure, 'NORMAL' AS operating_mode, '1.0.0' AS schema_version FROM tel")


def filtered_scan(s: SparkSession, d: str) -> DataFrame:
    """The lake is written in folders of many assets and read back with bounds that prune folders and reach the files."""
    path = scratch(s, "lake")
    tables.append_lake(tables.normalised(telemetry(s, d)), path, tables.BUCKETS)
    return tables.scan(s, path, "PUMP-001", 1704067220.0, 1704067420.0, ["event_id", "asset_id", "timestamp"], buckets=tables.BUCKETS)


add("s9_filtered_scan", filtered_scan, "SELECT event_id, asset_id, timestamp FROM tel WHERE asset_id = 'PUMP-001' AND timestamp BETWEEN 1704067220 AND 1704067420")


def committed(s: SparkSession, d: str) -> str:
    """Telemetry appended in three batches, one of them twice."""
    path = scratch(s, "commits")
    for batch in (0, 1, 2, 2):
        commits.append(telemetry(s, d).where(c("arrival") % 3 == batch).select("event_id"), path, batch)
    return path


add("s13_commit_history", lambda s, d: commits.commits(s, committed(s, d)).select(c("batch_id").cast("int").alias("batch_id"), "rows", "commit"),
    "SELECT CAST(arrival % 3 AS INTEGER) AS batch_id, count(*) AS rows, CAST(arrival % 3 + 1 AS INTEGER) AS commit FROM tel GROUP BY arrival % 3")
add("s13_read_as_of_commit", lambda s, d: commits.appended(s, committed(s, d), as_of=2), "SELECT event_id FROM tel WHERE arrival % 3 < 2")


def provisioned(s: SparkSession, d: str) -> DataFrame:
    """Four tables, created twice and once, and telemetry put in after each time, in partitions of many assets."""
    place = scratch(s, "tables")
    name = "lake_" + place[-12:]
    shapes = {"telemetry": (T.StructType([*TELEMETRY, T.StructField("bucket", T.IntegerType())]), "bucket"), "predictions": (PREDICTIONS, None), "alerts": (ALERTS, None), "current_state": (CURRENT_STATE, None)}
    for part in (0, 1):
        tables.provision(s, name, shapes, place)
        rows = tables.normalised(telemetry(s, d).where(c("arrival") % 2 == part)).withColumn("bucket", tables.bucket(c("asset_id")))
        rows.repartition(tables.BUCKETS, "bucket").select(*s.table(f"{name}.telemetry").columns).write.insertInto(f"{name}.telemetry")
    return s.table(f"{name}.telemetry").groupBy("asset_id").agg(F.count("*").alias("n")).withColumn("tables", F.lit(len(s.catalog.listTables(name))))


add("s7_provisioned_tables", provisioned, "SELECT asset_id, count(*) AS n, 4 AS tables FROM tel GROUP BY asset_id")
add("s11_row_count", lambda s, d: table("events")(s, d).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events")
add("s12_asset_distribution", lambda s, d: telemetry(s, d).groupBy("asset_id").agg(F.count("*").alias("n")), "SELECT asset_id, count(*) AS n FROM tel GROUP BY asset_id")
_RECORDS: set[tuple] = set()


def record(s: SparkSession, d: str, name: str, *columns: str) -> str:
    """A table of the input as one of the relational catalog, stored once for a session and an input; its full name there."""
    schema = "IN_" + re.sub(r"\W", "_", d.rstrip("/").rsplit("/", 1)[-1]).upper()
    if (s.sparkContext.applicationId, d, name) not in _RECORDS:
        relational.store(table(name)(s, d).select(*columns), schema, name.upper())
        _RECORDS.add((s.sparkContext.applicationId, d, name))
    return f"{schema}.{name.upper()}"


def relational_read(s: SparkSession, d: str) -> DataFrame:
    """The condition is the database's work."""
    customers = s.table(f"{relational.with_catalog(s)}.{record(s, d, 'customer', 'c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment')}")
    return customers.where("c_mktsegment = 'MACHINERY'").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_name", "c_acctbal")


def read_in_parts(s: SparkSession, d: str) -> DataFrame:
    rows = relational.read_parts(s, record(s, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "c_custkey")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def cross_catalog(s: SparkSession, d: str) -> DataFrame:
    """Assets by nation in one SQL text: current states of the session's catalog, nations of the relational one."""
    stored_current(s, d).createOrReplaceTempView("asset_current_state")
    nation = f"{relational.with_catalog(s)}.{record(s, d, 'nation', 'n_nationkey', 'n_name')}"
    return s.sql(f"""SELECT n_name, count(*) AS assets FROM asset_current_state JOIN {nation} ON CAST(right(asset_id, 3) AS INT) % 25 = n_nationkey GROUP BY n_name""")


add("s14_relational_read", relational_read, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
add("s14_read_in_parts", read_in_parts, "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment")
add("s16_cross_catalog", cross_catalog,
    "SELECT n_name, count(*) AS assets FROM asset_current_state JOIN nation ON CAST(right(asset_id, 3) AS INTEGER) % 25 = n_nationkey GROUP BY n_name")
add("s17_result_summary", lambda s, d: current(s, d).select(F.to_json(F.struct("asset_id", "health_state")).alias("row")), "SELECT '{\"asset_id\":\"' || asset_id || '\",\"health_state\":\"' || health_state || '\"}' AS row FROM asset_current_state")
add("s17_result_export", lambda s, d: tables.result_summary(current(s, d).select("asset_id", "health_state", "health_score"), "states"),
    "SELECT 'states' AS query_id, 'SUCCESS' AS status, count(*) AS row_count, 3 AS column_count, 'asset_id,health_state,health_score' AS columns FROM asset_current_state")

# -- writes with semantics -------------------------------------------------------


def upsert_state(s: SparkSession, d: str) -> str:
    """Two batches of current states, the first of even arrivals, upserted into a stored table, the second twice."""
    rows, path = telemetry(s, d).select("asset_id", "arrival", "temperature", "operating_mode"), scratch(s, "state")
    last = lambda part: part.groupBy("asset_id").agg(F.max_by(F.struct("arrival", "temperature", "operating_mode"), "arrival").alias("r")).select("asset_id", "r.*")
    for batch in (0, 1, 1):
        commits.upsert(last(rows.where(c("arrival") % 2 == batch)), path, batch, "asset_id", lambda old, new: tables.upserted(old, new, "asset_id", "arrival"))
    return path


STATE = "SELECT asset_id, max(arrival) AS arrival, arg_max(temperature, arrival) AS temperature, arg_max(operating_mode, arrival) AS operating_mode FROM tel"
add("u1_upsert_state", lambda s, d: commits.upserted(s, upsert_state(s, d)), f"{STATE} GROUP BY asset_id")
add("u1_state_as_of_commit", lambda s, d: commits.upserted(s, upsert_state(s, d), as_of=1), f"{STATE} WHERE arrival % 2 = 0 GROUP BY asset_id")


def upsert_registry(s: SparkSession, d: str) -> DataFrame:
    """A registry of assets upserted twice: the second batch brings new models for some assets and some new ones."""
    rows, path = table("customer")(s, d), scratch(s, "registry")

    def batch(where: str, model: str, at: int) -> DataFrame:
        return rows.where(where).select(c("c_custkey").alias("asset_id"), c("c_mktsegment").alias("asset_type"), F.lit(model).alias("model_name"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))

    for n, new in enumerate((batch("c_custkey % 3 < 2", "old", 1), batch("c_custkey % 3 > 0", "new", 2))):
        commits.upsert(new, path, n, "asset_id", tables.upserted_registry)
    return commits.upserted(s, path)


add(
    "u2_upsert_registry", upsert_registry,
    """SELECT c_custkey AS asset_id, c_mktsegment AS asset_type, CASE WHEN c_custkey % 3 > 0 THEN 'new' ELSE 'old' END AS model_name,
      CASE WHEN c_custkey % 3 > 0 THEN 2 ELSE 1 END AS updated_at, CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 2 END AS created_at FROM customer""",
)
add("u5_window_summaries", lambda s, d: windows.window_summaries(flagged(s, d), 60).drop("window_id", "window_type"),
    f"SELECT asset_id, t_us // 60000000 * 60e0 AS window_start, t_us // 60000000 * 60e0 + 60 AS window_end, {SUMMARY} FROM anom GROUP BY asset_id, t_us // 60000000")



def appended(s: SparkSession, rows: DataFrame, batch: Column, name: str) -> DataFrame:
    """``rows`` appended in two batches, the second of them twice."""
    path = scratch(s, name)
    for n in (0, 1, 1):
        tables.append_once(rows.where(batch == n), path, n)
    return s.read.parquet(path).drop("batch_id")


def replaced_queue(s: SparkSession, d: str) -> DataFrame:
    """The queue of the first work orders, replaced by that of all."""
    path, rows = scratch(s, "queue"), stored_queue(s, d)
    tables.replace(rows.where("ranking <= 5"), path)
    tables.replace(rows, path)
    return s.read.parquet(path)


WORK = ["ranking", "asset_id", "priority_score", "recommended_action"]
PREDICTED = ["asset_id", "arrival", "failure_probability", "predicted_failure_risk", "predicted_rul_hours"]
SNAPSHOT = ["batch", "timestamp", "total_assets", "fleet_health_score", "active_alerts_total"]
add("u3_append_predictions", lambda s, d: appended(s, stored_history(s, d).select(*PREDICTED), c("arrival") % 2, "predictions"), f"SELECT {', '.join(PREDICTED)} FROM asset_prediction_history")
add("u6_replace_queue", lambda s, d: replaced_queue(s, d).select(*WORK), f"SELECT {', '.join(WORK)} FROM maintenance_priority_queue")
add("u7_append_kpis", lambda s, d: appended(s, stored_snapshots(s, d).select(*SNAPSHOT), c("batch") % 2, "kpis"), f"SELECT {', '.join(SNAPSHOT)} FROM fleet_kpi_snapshots")
add("u8_record_maintenance", lambda s, d: appended(s, quality.maintenance_breaches(services(s, d)).where(F.size("breaches") == 0).select("maintenance_id", "asset_id", "maintenance_type", "performed_at", "cost_usd"), c("maintenance_id") % 2, "maintenance"),
    "SELECT o_orderkey AS maintenance_id, o_custkey AS asset_id, (['PREVENTIVE', 'CORRECTIVE', 'INSPECTION', 'EMERGENCY_REPAIR', 'CALIBRATION'])[o_orderkey % 6 + 1] AS maintenance_type, o_orderdate AS performed_at, o_totalprice AS cost_usd FROM orders WHERE o_orderkey % 11 NOT IN (1, 2, 3) AND o_orderkey % 6 < 5")

# -- reports ---------------------------------------------------------------------

add("x1_ingestion_report", lambda s, d: checked(s, d).groupBy(F.coalesce("asset_type", F.lit("UNKNOWN")).alias("kind")).agg(F.count("*").alias("generated"), F.count_if("is_valid").alias("valid"), F.count_if(~c("is_valid")).alias("quarantined")),
    "SELECT CASE WHEN fits THEN asset_type ELSE 'UNKNOWN' END AS kind, count(*) AS generated, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS quarantined FROM checked GROUP BY 1")


def ingestion(s: SparkSession, d: str) -> tuple[list[ingest.Run], str]:
    """An ingestion in three runs, each counted while it is written."""
    path, rows = scratch(s, "lake"), checked(s, d).select("arrival", "event_id", "asset_id", "is_valid", "is_delayed", "is_out_of_order")
    return [ingest.ingested(rows.where(c("arrival") % 3 == batch), path, batch, f"run-{batch}") for batch in range(3)], path


def ingestion_report(s: SparkSession, d: str) -> DataFrame:
    return ingest.run_report(s, *ingestion(s, d))


add(
    "x1_run_report", ingestion_report,
    """SELECT 'events_generated' AS metric, '' AS name, count(*) AS value FROM checked UNION ALL SELECT 'events_valid', '', count(*) FILTER (WHERE is_valid) FROM checked
    UNION ALL SELECT 'events_quarantined', '', count(*) FILTER (WHERE NOT is_valid) FROM checked UNION ALL SELECT 'events_delayed', '', count(*) FILTER (WHERE is_delayed) FROM checked
    UNION ALL SELECT 'events_out_of_order', '', count(*) FILTER (WHERE is_out_of_order) FROM checked UNION ALL SELECT 'table_rows', '', count(*) FILTER (WHERE is_valid) FROM checked
    UNION ALL SELECT 'snapshots', '', 3 UNION ALL SELECT 'asset_rows', asset_id, count(*) FROM checked WHERE is_valid GROUP BY asset_id""",
)
add("u9_observed_ledger", lambda s, d: reduce(DataFrame.union, [run.ledger(s) for run in ingestion(s, d)[0]]),
    "SELECT 'run-' || arrival % 3 AS run_id, count(*) AS events_generated, count(*) FILTER (WHERE is_valid) AS events_valid, count(*) FILTER (WHERE NOT is_valid) AS events_quarantined, 'COMPLETED' AS status FROM checked GROUP BY arrival % 3")
add("x2_lake_report", lambda s, d: telemetry(s, d).groupBy("asset_id").agg(F.count("*").alias("n"), F.round(F.min("timestamp"), 6).alias("first_ts"), F.round(F.max("timestamp"), 6).alias("last_ts")), "SELECT asset_id, count(*) AS n, round(min(timestamp), 6) AS first_ts, round(max(timestamp), 6) AS last_ts FROM tel GROUP BY asset_id")
add("x7_unregistered_assets", lambda s, d: quality.unregistered(telemetry(s, d), telemetry(s, d).where("criticality <> 'LOW'")), "SELECT DISTINCT asset_id FROM tel WHERE criticality = 'LOW'")
