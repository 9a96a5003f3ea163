"""Streams run to their end over the driver's tables, and tables written and read back."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assethealth.functions.columns import rounded
from assethealth.ml import models
from assethealth.operators import alerts, tables, windows
from assethealth.plans.ml_queries import KEPT, features, training
from assethealth.plans.oracle import PARTS, exact, r
from assethealth.plans.quality_queries import checked, raw
from assethealth.plans.queries import SUMMARY, Query, add, alert_history, flagged, late_samples, scored, stored_alerts, telemetry
from assethealth.plans.raw_events import stream_messages
from assethealth.sources.scratch import kept, scratch
from assethealth.sources.telemetry import events
from assethealth.streaming import asset_stream, jobs
from assethealth.streaming.progress import REPORT as progress_report


def finished(stream: DataFrame, spark: SparkSession, places: tuple[str, str] | None = None) -> DataFrame:
    """What a stream has written, with its checkpoint at the second of ``places``, when its input is used up."""
    out, check = places or (scratch(spark, "stream"), scratch(spark, "check"))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed(rows: DataFrame) -> DataFrame:
    """A table as a stream."""
    path = scratch(rows.sparkSession, "source")
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def in_time_order(rows: DataFrame, parts: int = 3) -> tuple[str, list[DataFrame]]:
    """A folder, and the rows in parts by event time, which a stream takes one after another."""
    low, high = rows.agg(F.min("t_us"), F.max("t_us")).first()
    part = F.floor((F.col("t_us") - (low or 0)) * parts / F.lit((high or 0) - (low or 0) + 1))
    return scratch(rows.sparkSession, "source"), [rows.where(part == k) for k in range(parts)]


INPUT = ["asset_id", "arrival", "t_us", "health_score", "critical", "found", "worst"]


def scored_inputs(s: SparkSession, d: str) -> DataFrame:
    """What state streams read of scored samples, worked out once, as each of their parts would score all samples again."""
    return kept(scored(s, d).withColumns(alerts.fold_inputs()).select(*INPUT), scratch(s, "scored"))


def state_stream(s: SparkSession, d: str) -> DataFrame:
    """States of a stream of four files a micro-batch, parts in time order, an asset's rows of a part in one file, so that state is carried from batch to batch."""
    path, parts = in_time_order(scored_inputs(s, d))
    for part in parts:
        part.repartition(4, "asset_id").write.mode("append").parquet(path)
    rows = s.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 4).parquet(path)
    return finished(jobs.state_stream(rows), s)


def restarted(s: SparkSession, d: str) -> DataFrame:
    """States of a stream that stops after each part and starts again from its checkpoint."""
    path, parts = in_time_order(scored_inputs(s, d))
    places = scratch(s, "stream"), scratch(s, "check")
    for part in parts:
        part.repartition(4, "asset_id").write.mode("append").parquet(path)
        out = finished(jobs.state_stream(s.readStream.schema(part.schema).parquet(path)), s, places)
    return out


def expired(s: SparkSession, d: str) -> DataFrame:
    """States of samples, and of the same samples three days later: in between one heartbeat two days later lets the watermark pass, so that all states have gone."""
    rows = scored_inputs(s, d)
    path, places = scratch(s, "source"), (scratch(s, "stream"), scratch(s, "check"))
    day = 24 * 3600 * 1_000_000
    shift = lambda days, to: {"t_us": F.col("t_us") + days * day, "arrival": F.col("arrival") + to}
    beat = rows.orderBy(F.desc("t_us"), "arrival").limit(1).withColumns(shift(2, 10_000_000)).withColumn("asset_id", F.lit("HEARTBEAT"))
    for part in (rows, beat, rows.withColumns(shift(3, 20_000_000))):
        part.repartition(4, "asset_id").write.mode("append").parquet(path)
        out = finished(jobs.state_stream(s.readStream.schema(rows.schema).parquet(path)), s, places)
    return out.where("asset_id <> 'HEARTBEAT'")


OUT = "asset_id, arrival, health_state, previous_health_state, severity, is_recovery, outcome"
add("w7_keyed_state_stream", lambda s, d: state_stream(s, d).select(*OUT.split(", ")), f"SELECT {OUT} FROM states")
add("w9_checkpoint_restore", lambda s, d: restarted(s, d).select(*OUT.split(", ")), f"SELECT {OUT} FROM states")
add("w8_state_expiry", lambda s, d: expired(s, d).select(*OUT.split(", ")), f"SELECT {OUT} FROM states UNION ALL SELECT {OUT.replace('arrival', 'arrival + 20000000')} FROM states")
add("w12_stream_quarantine", lambda s, d: finished(jobs.judged(streamed(raw(s, d))).where("keys IS NULL").select("arrival"), s), "SELECT arrival FROM typed WHERE NOT fits")


def stream_run(s: SparkSession, d: str) -> tuple[dict[str, str], str, list[tuple]]:
    """Outputs, checkpoint and reports of one stream of messages in three parts by time, stopped after each part and started again, several files a micro-batch."""
    path, parts = in_time_order(stream_messages(telemetry(s, d)))
    outputs, check, reports = {k: scratch(s, f"stream-{k}") for k in asset_stream.OUTPUTS}, scratch(s, "check"), []
    for part in parts:
        part.select("raw", "arrival").repartition(4).write.mode("append").parquet(path)
        reports += asset_stream.drained(s.readStream.schema("raw string, arrival long").parquet(path), outputs, check)
    return outputs, check, reports


_RUNS: dict[tuple, tuple[dict[str, str], str, list[tuple]]] = {}


def stream_output(name: str, *columns: str) -> Query:
    """Columns, as SQL, of one output of the run, which is made once for a session and an input."""

    def query(s: SparkSession, d: str) -> DataFrame:
        return s.read.parquet(_run(s, d)[0][name]).selectExpr(*columns)

    return query


def _run(s: SparkSession, d: str) -> tuple[dict[str, str], str, list[tuple]]:
    key = (s.sparkContext.applicationId, *sorted(events(s, d).inputFiles()))
    if key not in _RUNS:
        _RUNS[key] = stream_run(s, d)
    return _RUNS[key]


ALERT = "arrival, asset_id, severity, previous_health_state, current_health_state, health_score, is_state_transition, is_recovery"
add("w10_raw_to_alert_stream", stream_output("alerts", "cast(substring(event_id, 5) AS bigint) AS arrival", *ALERT.split(", ")[1:]), f"SELECT {ALERT} FROM asset_alert_history")
PARTS["sent"] = "SELECT *, CASE WHEN arrival % 107 = 0 THEN 0 ELSE rn END AS seq FROM states"
add(
    "w10_stream_processed", stream_output("processed", "event_id", "asset_id", "health_score", "health_state", "anomalies_count", "alert_emitted", "lateness", "out_of_order"),
    """SELECT event_id, asset_id, health_score, health_state, found AS anomalies_count, outcome = 2 AS alert_emitted, 'ON_TIME' AS lateness,
      seq <= coalesce(max(seq) OVER (PARTITION BY asset_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS out_of_order FROM sent""",
)
WINDOW = ["asset_id", "window_start", "window_end", "sample_count", "mean_temperature", "std_temperature", "thermal_rise_rate", "mean_vibration", "max_vibration", "vibration_slope", "mean_pressure", "std_pressure", "anomalies_in_window"]
add(
    "w10_stream_windows", stream_output("windows", *WINDOW),
    f"""SELECT w.* FROM (SELECT asset_id, t_us // 5000000 * 5e0 AS window_start, t_us // 5000000 * 5e0 + 5 AS window_end, {SUMMARY} FROM anom GROUP BY asset_id, t_us // 5000000) w
    JOIN (SELECT asset_id, max(t_us) AS newest FROM tel GROUP BY asset_id) m ON m.asset_id = w.asset_id AND w.window_end * 1000000 <= (m.newest - 35000000) // 5000000 * 5000000""",
)
add(
    "w10_stream_quarantine", stream_output("quarantine", "event_id", "asset_id", "violations"),
    """SELECT 'UNKNOWN' AS event_id, 'UNKNOWN' AS asset_id, 'DQ-011' AS violations FROM tel WHERE arrival % 97 = 0 UNION ALL
    SELECT event_id, asset_id, 'DQ-009,DQ-010' FROM tel WHERE arrival % 101 = 0 UNION ALL SELECT event_id || 'b', asset_id, 'DQ-010' FROM tel WHERE arrival % 103 = 0""",
)
add("w17_stream_late", stream_output("late", "event_id", "asset_id", "lateness", "out_of_order"), "SELECT event_id || 'l' AS event_id, asset_id, 'EXCESSIVELY_LATE' AS lateness, TRUE AS out_of_order FROM tel WHERE arrival % 89 = 0")
add(
    "w9_state_in_checkpoint", lambda s, d: asset_stream.state_of(s, _run(s, d)[1], "intake", "progress").select(F.col("key.key").alias("asset_id"), F.col("value.value.newest").alias("newest"), F.col("value.value.sequence").alias("sequence")),
    "SELECT asset_id, max(t_us) AS newest, max(seq) AS sequence FROM sent GROUP BY asset_id",
)


def observed_progress(s: SparkSession, d: str) -> DataFrame:
    """What the run's micro-batches have counted of themselves, in all."""
    reports = s.createDataFrame(_run(s, d)[2], progress_report)
    return reports.agg(*[F.sum(x).alias(x) for x in ("input_rows", "processed", "quarantined", "late", "anomalies", "alerts", "windows", "out_of_order")], F.max("newest_us").alias("newest_us"), F.count("*").alias("batches"))


add(
    "w13_observed_progress", observed_progress,
    """SELECT count(*) + count(*) FILTER (WHERE arrival % 97 = 0) + count(*) FILTER (WHERE arrival % 101 = 0) + count(*) FILTER (WHERE arrival % 103 = 0) + count(*) FILTER (WHERE arrival % 89 = 0) AS input_rows,
      count(*) AS processed, count(*) FILTER (WHERE arrival % 97 = 0) + count(*) FILTER (WHERE arrival % 101 = 0) + count(*) FILTER (WHERE arrival % 103 = 0) AS quarantined,
      count(*) FILTER (WHERE arrival % 89 = 0) AS late, CAST(sum(found) AS BIGINT) AS anomalies, count(*) FILTER (WHERE outcome = 2) AS alerts,
      (SELECT count(*) FROM (SELECT DISTINCT asset_id, t_us // 5000000 * 5000000 AS w FROM tel) w JOIN (SELECT asset_id, max(t_us) AS newest FROM tel GROUP BY asset_id) m
        ON m.asset_id = w.asset_id AND w + 5000000 <= (m.newest - 35000000) // 5000000 * 5000000) AS windows,
      count(*) FILTER (WHERE seq <= before) AS out_of_order, max(t_us) AS newest_us, 3 AS batches
    FROM (SELECT *, coalesce(max(seq) OVER (PARTITION BY asset_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM sent)""",
)


def lifetime(s: SparkSession, d: str) -> DataFrame:
    """Health states that a checkpoint holds of all assets, and after their time to live, when another asset alone has sent something."""
    path, check, outputs = scratch(s, "source"), scratch(s, "check"), {"processed": scratch(s, "processed")}
    rows = kept(stream_messages(telemetry(s, d)), scratch(s, "messages"))
    beat = rows.where("get_json_object(raw, '$.event_id') IS NOT NULL").orderBy("t_us", "arrival", "raw").limit(1)
    calm = {"asset_id": "PUMP-BEAT", "event_id": "beat", "temperature": "40.0", "vibration": "1.0"}
    for k, v in calm.items():
        beat = beat.withColumn("raw", F.regexp_replace("raw", rf'"{k}":"?[^",]*"?', f'"{k}":' + (v if v[0].isdigit() else f'"{v}"')))
    found = []
    for when, part in (("before", rows), ("after", beat)):
        part.select("raw", "arrival").repartition(4).write.mode("append").parquet(path)
        asset_stream.drained(s.readStream.schema("raw string, arrival long").parquet(path), outputs, check, ttl_ms=1000)
        state = asset_stream.state_of(s, check, "diagnosis", "health").select(F.lit(when).alias("at"), F.col("key.key").alias("asset_id"), F.col("value.value.health").alias("health"), F.col("value.value.faults").alias("faults"))
        state.write.parquet(f"{path}-{when}")  # before the next run changes it
        found.append(s.read.parquet(f"{path}-{when}"))
    return found[0].union(found[1])


# the stream takes the first of an asset's samples of one millisecond; the others are repeats (DQ-010)
ONCE = f"SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, {exact('t_us / 1e6', 3)} ORDER BY t_us, arrival) AS turn FROM ({PARTS['tel'].strip()})) WHERE turn = 1"
add("w8_state_lifetime", lifetime, """SELECT 'before' AS at, asset_id, health, CAST(fault_count AS INTEGER) AS faults FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY rn DESC) AS back FROM states) WHERE back = 1
  UNION ALL SELECT 'after', 'PUMP-BEAT', 0, 0""", instead={"tel": ONCE})


def stream_lateness(s: SparkSession, d: str) -> DataFrame:
    """Each sample's lateness in the stream, against its own asset's watermark; some are 10 or 40 seconds late."""
    rows = late_samples(s, d).withColumn("timestamp", F.col("t_us") / 1e6).withColumns({"sequence_number": F.col("arrival"), "schema_version": F.lit("1.0.0")})
    fields = [x for x in rows.columns if x not in ("arrival", "t_us", "scenario", "criticality")]
    path, out = scratch(s, "source"), scratch(s, "lateness")
    rows.select(F.to_json(F.struct(*fields)).alias("raw"), "arrival").repartition("arrival").write.parquet(path)  # files grow in number, not in size
    stream = asset_stream.intake(s.readStream.schema("raw string, arrival long").parquet(path)).select("kind", "event_id", "lateness", "out_of_order")
    asset_stream.started(stream, lambda batch, n: tables.append_once(batch, out, n), scratch(s, "check"), drain=True).awaitTermination()
    return s.read.parquet(out).where("kind <> 'quarantine'").select("event_id", "lateness", "out_of_order")  # a shifted time can be another's


add("w2_stream_lateness", stream_lateness, f"""SELECT event_id, CASE WHEN newest IS NULL OR t_us >= newest - 5000000 THEN 'ON_TIME' WHEN t_us >= newest - 35000000 THEN 'LATE_ACCEPTED' ELSE 'EXCESSIVELY_LATE' END AS lateness, FALSE AS out_of_order
  FROM (SELECT *, max(t_us) OVER (PARTITION BY asset_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, moment ORDER BY arrival) AS turn FROM (SELECT *, {exact("t_us / 1e6", 3)} AS moment FROM late)) WHERE turn = 1)""")


def progress(s: SparkSession, d: str) -> DataFrame:
    """Progress of late samples: latency is how far an event's time is behind the newest, in ms."""
    rows = windows.lateness(late_samples(s, d)).withColumn("latency_ms", F.col("watermark") * 1000 + 5000 - F.col("t_us") / 1000)
    found = scored(s, d).select("arrival", F.size("anomalies").alias("anomalies"))
    judged = checked(s, d).select("arrival", (~F.col("is_valid")).alias("quarantined"))
    alerted = stored_alerts(s, d).select("arrival", F.lit(True).alias("alerted"))
    rows = rows.join(found, "arrival").join(judged, "arrival").join(alerted, "arrival", "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    return windows.stream_metrics(rows)


PACE = ", ".join(r(f"coalesce(quantile_cont(greatest(latency, 1e-2), {q}) FILTER (WHERE done), 0e0)", 3) + f" AS processing_latency_{n}_ms" for n, q in (("p50", "5e-1"), ("p95", "95e-2"), ("p99", "99e-2")))
add("w13_stream_progress", progress, f"""SELECT count(*) AS events_ingested, count(*) FILTER (WHERE done) AS events_processed, count(*) FILTER (WHERE lateness = 'LATE_ACCEPTED') AS events_late, count(*) FILTER (WHERE lateness = 'EXCESSIVELY_LATE') AS events_excessively_late,
  count(*) FILTER (WHERE NOT is_valid) AS events_quarantined, CAST(coalesce(sum(anomalies), 0) AS BIGINT) AS anomalies_detected, count(*) FILTER (WHERE outcome = 2) AS alerts_emitted, count(DISTINCT asset_id) AS active_assets_count, {r("max(watermark)", 6)} AS current_watermark,
  {r("max(t_us) / 1e6 - max(watermark)", 6)} AS watermark_lag_sec, {r("count(*) FILTER (WHERE done) / greatest(1e-3, (max(t_us) - min(t_us)) / 1e6)", 2)} AS throughput_events_per_sec, {PACE}
FROM (SELECT x.asset_id, x.t_us, x.lateness, x.watermark, y.found AS anomalies, y.outcome, z.is_valid, x.watermark * 1000 + 5000 - x.t_us / 1000 AS latency, z.is_valid AND x.lateness <> 'EXCESSIVELY_LATE' AS done
  FROM classed x JOIN states y ON y.arrival = x.arrival JOIN checked z ON z.arrival = x.arrival)""")


def drained(s: SparkSession, d: str) -> DataFrame:
    """Rows of each micro-batch of a drain that takes one of four files at a time."""
    path, out = scratch(s, "source"), scratch(s, "drained")
    raw(s, d).withColumn("part", F.col("arrival") % 4).repartition("part").write.partitionBy("part").parquet(path)
    rows = s.readStream.schema("raw string, arrival long, part int").option("maxFilesPerTrigger", 1).parquet(path)
    count = lambda batch, n: tables.append_once(batch.agg(F.count("*").alias("n")), out, n)
    rows.writeStream.foreachBatch(count).option("checkpointLocation", scratch(s, "check")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select("n")


def routed(s: SparkSession, d: str) -> DataFrame:
    """One stream, two outputs: good events and quarantined ones."""
    paths = {k: scratch(s, k) for k in ("good", "bad")}
    code = F.array_join("violations", ",").alias("violations")
    route = jobs.routed({"good": lambda b: b.where(F.size("violations") == 0).select("arrival", code), "bad": lambda b: b.where(F.size("violations") > 0).select("arrival", code)}, paths)
    rows = jobs.judged(streamed(raw(s, d))).select("arrival", "violations")  # a batch is kept whole while its outputs are written
    rows.writeStream.foreachBatch(route).option("checkpointLocation", scratch(s, "check")).trigger(availableNow=True).start().awaitTermination()
    good, bad = (s.read.parquet(paths[k]).select(F.lit(k).alias("output"), "arrival", "violations") for k in ("good", "bad"))
    return good.union(bad)


add("s3_keyed_messages", lambda s, d: finished(jobs.keyed(streamed(stored_alerts(s, d).select("asset_id", "arrival", "severity"))), s),
    """SELECT asset_id AS key, '{"asset_id":"' || asset_id || '","arrival":' || arrival || ',"severity":"' || severity || '"}' AS value FROM asset_alert_history""")  # fmt: skip
add("s2_bounded_drain", drained, "SELECT count(*) AS n FROM copies GROUP BY arrival % 4")
add("s4_routed_outputs", routed, "SELECT CASE WHEN len(found) = 0 THEN 'good' ELSE 'bad' END AS output, arrival, array_to_string(found, ',') AS violations FROM ruled")
add("w1_watermarked_windows", lambda s, d: finished(windows.window_summaries(streamed(flagged(s, d).select("asset_id", "arrival", "t_us", "event_time", "temperature", "vibration", "pressure", "is_anomaly")).withWatermark("event_time", "35 seconds"), 5), s).drop("window_id", "window_type"),
    f"SELECT asset_id, t_us // 5000000 * 5e0 AS window_start, t_us // 5000000 * 5e0 + 5 AS window_end, {SUMMARY} FROM anom GROUP BY asset_id, t_us // 5000000 HAVING t_us // 5000000 * 5000000 + 5000000 <= (SELECT (max(t_us) - 35000000) // 1000 * 1000 FROM anom)")
add("w11_stream_deduplication", lambda s, d: finished(streamed(telemetry(s, d).withColumn("event_time", F.timestamp_micros("t_us")).select("event_id", "event_time").transform(lambda t: t.union(t.where("event_id LIKE '%7'")))).withWatermark("event_time", "1 hour").dropDuplicatesWithinWatermark(["event_id"]), s).select("event_id"), "SELECT event_id FROM tel")
add("s1_event_stream", lambda s, d: finished(jobs.judged(streamed(raw(s, d))).select("arrival", F.array_join("violations", ",").alias("violations")), s), "SELECT arrival, array_to_string(found, ',') AS violations FROM ruled")


def written_alerts(s: SparkSession, d: str) -> DataFrame:
    """Alert history appended in two batches, one of them twice."""
    path = scratch(s, "alerts")
    rows = alert_history(s, d).select("asset_id", "arrival", "severity")
    for batch in (0, 1, 1):
        tables.append_once(rows.where(F.col("arrival") % 2 == batch), path, batch)
    return s.read.parquet(path).select("asset_id", "arrival", "severity")


add("u4_append_alerts", written_alerts, "SELECT asset_id, arrival, severity FROM asset_alert_history")


def written_features(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "features")
    tables.replace(features(s, d).select(*KEPT), path)
    return s.read.parquet(path)


add("s15_feature_table", written_features, f"SELECT {', '.join(KEPT)} FROM mlfeat")


def scaled_features(s: SparkSession, d: str) -> DataFrame:
    rows = training(s, d)
    model = Pipeline(stages=models.feature_stages()).fit(rows.where("split = 'train'"))
    values = vector_to_array("features")
    return model.transform(rows).select("run_id", "step", F.size(values).alias("n"), rounded(values[0], 6).alias("temperature"))


add("m18_feature_pipeline", scaled_features, "SELECT run_id, step, 25 AS n, (floor(((temperature - m) / d) * 1e6 + 500001e-6) / 1e6) AS temperature FROM mlrun CROSS JOIN (SELECT avg(temperature) AS m, stddev_samp(temperature) AS d FROM mlrun WHERE split = 'train')")
