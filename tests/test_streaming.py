"""Streams give what batches give, also over a restart."""

from pyspark.sql import functions as F

from assethealth.operators import alerts, features
from assethealth.plans.raw_events import with_defects
from assethealth.sources.telemetry import telemetry
from assethealth.streaming import jobs

SF = "/root/testdata/sf0.001"


def run(stream, path, checkpoint):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None


def test_states_survive_a_restart(spark, tmp_path):
    rows = features.scored(telemetry(spark, SF)).withColumns(alerts.fold_inputs()).select("asset_id", "arrival", "t_us", "health_score", "critical", "found", "worst")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in (rows.where("arrival < 400"), rows.where("arrival >= 400")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run(jobs.state_stream(stream), out, check)
    streamed = {(r.asset_id, r.arrival): (r.health_state, r.outcome) for r in spark.read.parquet(out).collect()}
    batch = {(r.asset_id, r.arrival): (r.health_state, r.outcome) for r in alerts.with_states(features.scored(telemetry(spark, SF))).collect()}
    assert streamed == batch


def test_quality_routes_and_windows_close(spark, tmp_path):
    raw = with_defects(telemetry(spark, SF)).where("arrival < 1000000")
    source = str(tmp_path / "in")
    raw.orderBy("arrival").coalesce(1).write.parquet(source)
    judged = jobs.judged(jobs.file_events(spark, source))
    paths = {"good": str(tmp_path / "good"), "bad": str(tmp_path / "bad")}
    route = jobs.routed({"good": lambda b: b.where(F.size("violations") == 0).select("event_id"), "bad": lambda b: b.where(F.size("violations") > 0).select("raw", F.to_json("violations").alias("rules"))}, paths)
    q = judged.writeStream.foreachBatch(route).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    good, bad = (spark.read.parquet(paths[k]).count() for k in ("good", "bad"))
    assert good + bad == raw.count() and bad == raw.where("arrival % 97 IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12)").count()
    run(jobs.window_stream(jobs.clean(jobs.judged(jobs.file_events(spark, source))), 60), str(tmp_path / "w"), str(tmp_path / "c2"))
    closed = spark.read.parquet(str(tmp_path / "w"))
    assert closed.count() > 0 and closed.groupBy("window_id").count().where("count > 1").count() == 0
