"""Small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from assethealth.functions.columns import rounded_exactly
from assethealth.ml import data, metrics
from assethealth.operators import alerts, quality, serving, tables, windows
from assethealth.operators.features import rolling_features


def test_fold_follows_the_thresholds():
    """The band table against the thresholds written out."""

    def plain(state, score, critical):
        if critical or score < 0.40:
            return 3
        if state == 3:
            return 2 if score >= 0.50 else 3
        if state == 2:
            return 1 if score >= 0.72 else 2
        if state == 1:
            return 2 if score < 0.65 else 0 if score >= 0.90 else 1
        return 2 if score < 0.65 else 1 if score < 0.85 else 0

    rng = random.Random(5)
    state, want = alerts.State(), 0
    for i in range(5000):
        score, critical = round(rng.random(), 2), rng.random() < 0.02
        state, step = alerts.advance(state, float(i), score, critical, 0, 0)
        want = plain(want, score, critical)
        assert step.health == want


def test_alert_is_emitted_suppressed_and_recovers():
    state, outcomes = alerts.State(), []
    for t, score, found in ((100, 0.75, 1), (105, 0.75, 1), (110, 0.95, 0)):
        state, step = alerts.advance(state, t, score, False, found, 1 if found else 0)
        outcomes.append((step.outcome, step.recovery))
    assert outcomes == [(2, False), (1, False), (2, True)]


def test_rolling_features_of_a_ramp(spark):
    rows = [(i, "MOTOR-001", 1704067300000000 + i * 1000000, 60.0 + i, 1.5 + 0.1 * (i % 2), 4.0, 50.0) for i in range(11)]
    frame = spark.createDataFrame(rows, "arrival long, asset_id string, t_us long, temperature double, vibration double, pressure double, current double")
    frame = frame.withColumns({"voltage": F.lit(400.0), "power": F.lit(20.0), "timestamp": F.col("t_us") / 1e6})
    last = rolling_features(frame).orderBy(F.desc("arrival")).first()
    assert (last.sample_count, last.mean_temperature, last.std_temperature, last.thermal_rise_rate, last.current_ratio) == (11, 65.0, 3.317, 60.0, 1.0)
    assert last.temperature_zscore == pytest.approx(1.508, abs=1e-3)


def test_lateness_is_judged_before_the_event(spark):
    rows = spark.createDataFrame([(i, t * 1000000) for i, t in enumerate((100, 102, 99, 75, 40))], "arrival long, t_us long")
    out = windows.lateness(rows).orderBy("arrival").collect()
    assert [r.lateness for r in out] == ["ON_TIME"] * 3 + ["LATE_ACCEPTED", "EXCESSIVELY_LATE"]
    assert [r.watermark for r in out] == [95, 97, 97, 97, 97]


def test_windows(spark):
    rows = spark.createDataFrame([(t, "A", t * 1000000, 60.0 + t, 1.5, 4.0, int(t == 7)) for t in range(15)], "arrival long, asset_id string, t_us long, temperature double, vibration double, pressure double, is_anomaly int")
    out = windows.window_summaries(rows.withColumn("event_time", F.timestamp_micros("t_us")), 5).orderBy("window_start").collect()
    assert (out[0].sample_count, out[0].mean_temperature, out[0].std_temperature, out[0].thermal_rise_rate) == (5, 62.0, 1.581, 60.0)
    assert [r.anomalies_in_window for r in out] == [0, 1, 0]


FLEET = [("A1", 0.95, 0.05, 115.0, "LOW"), ("A2", 0.80, 0.20, 90.0, "MEDIUM"), ("A3", 0.45, 0.65, 20.0, "HIGH"), ("A4", 0.15, 0.90, 8.0, "CRITICAL")]


def test_fleet_kpis_and_ranking(spark):
    rows = spark.createDataFrame(FLEET, "asset_id string, health_score double, failure_probability double, predicted_rul_hours double, criticality string")
    rows = rows.withColumns({"asset_type": F.lit("MOTOR"), "health_state": F.lit("WATCH"), "maintenance_priority": F.lit("LOW"), "active_alert_count": F.lit(1), "last_prediction_time": F.lit(None).cast("timestamp")})
    one = serving.fleet_summary(rows).first()
    assert (one.fleet_health_score, one.avg_predicted_rul_hours, one.min_predicted_rul_hours, one.failure_risk_rate, one.near_failure_assets) == (0.5875, 58.25, 8.0, 0.5, 2)
    orders = serving.work_orders(rows, rows.select("asset_id", "criticality")).orderBy("ranking").collect()
    assert [(r.asset_id, r.priority_score) for r in orders] == [("A4", 84.92), ("A3", 62.67), ("A2", 21.5), ("A1", 5.33)]
    empty = serving.fleet_summary(rows.limit(0)).first()
    assert (empty.total_assets, empty.fleet_health_score, empty.avg_predicted_rul_hours) == (0, 1.0, 120.0)


def test_metrics(spark):
    y, pred, p = [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 0, 1, 1, 1], [0.1, 0.2, 0.1, 0.7, 0.4, 0.8, 0.9, 0.95]
    rows = spark.createDataFrame(list(zip(y, pred, p, strict=True)), "label_failure int, pred_failure int, prob_failure double")
    one = metrics.classification_metrics(rows).first()
    assert (one.tp, one.fp, one.tn, one.fn, one.precision, one.recall, one.cost, one.false_alarm_rate) == (3, 1, 3, 1, 0.75, 0.75, 11, 0.25)
    assert metrics.roc_auc(rows).first().roc_auc == 0.9375
    assert metrics.average_precision(rows).first().pr_auc == 0.95
    life = spark.createDataFrame([(100.0, 95.0), (80.0, 85.0), (50.0, 48.0), (20.0, 22.0), (0.0, 5.0)], "label_rul double, pred_rul double")
    two = metrics.regression_metrics(life).first()
    assert (two.mae, two.rmse, two.accuracy_within_10pct) == (3.8, 4.0743, 1.0)
    late = spark.createDataFrame([(-10.0,), (10.0,)], "e double").select(metrics.late_penalty(F.col("e")).alias("p")).collect()
    assert [r.p for r in late] == pytest.approx([1.1580, 1.7183], abs=2e-4)


def test_labels(spark):
    rows = spark.range(600).select(F.lit("r").alias("run_id"), F.col("id").alias("step"), F.lit(2).alias("scenario"))
    out = data.labelled(rows).orderBy("step").collect()
    assert (out[0].label_rul, out[-1].label_rul, sum(r.label_failure for r in out)) == (119.8, 0.0, 121)
    assert {(r.label_rul, r.label_failure) for r in data.labelled(rows.withColumn("scenario", F.lit(1))).collect()} == {(120.0, 0)}
    runs = spark.range(1000).select(F.concat(F.lit("r"), (F.col("id") % 20).cast("string")).alias("run_id"))
    assert {r.split: r.n for r in data.split_by_run(runs).select("run_id", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 14, "validation": 3, "test": 3}
    with pytest.raises(ValueError):
        data.features_only(rows.withColumn("label_rul", F.lit(1)), ("label_rul",))


def test_weights(spark):
    rows = spark.range(100).select(F.lit("train").alias("split"), (F.col("id") < 20).cast("int").alias("label_failure"))
    assert tuple(data.class_weights(rows).first()) == (0.625, 2.5)
    assert tuple(data.class_weights(rows.withColumn("label_failure", F.lit(0))).first()) == (1.0, 1.0)


GOOD = '{"event_id":"%s","asset_id":"MOTOR-001","asset_type":"MOTOR","timestamp":1775347200.%d,"temperature":68.5,"vibration":1.25,"pressure":1.0,"rpm":1750,"current":48.2,"voltage":400,"power":27.4,"load":85,"operating_mode":"NORMAL","sequence_number":%d}'


def test_quality_rules(spark):
    base = GOOD % ("e", 0, 1)
    again = ",DQ-009,DQ-010"  # of the first event, whatever else is wrong
    cases = [
        (base, ""), (base.replace('"rpm":1750,', ""), "DQ-001" + again), (base.replace("400", '"x"'), "DQ-002" + again), (base.replace("1775347200.0", "-1"), "DQ-003,DQ-009"), (base.replace("NORMAL", "TURBO"), "DQ-004" + again), (base.replace("68.5", "2000"), "DQ-005" + again),
        (base.replace("1750", "60000"), "DQ-006" + again), (base.replace("1.25", "-1"), "DQ-007" + again), (base.replace('"voltage":400', '"voltage":-4'), "DQ-008" + again), (base, "DQ-009,DQ-010"), (GOOD % ("f", 0, 2), "DQ-010"), (base[:30], "DQ-011"), ("[1]", "DQ-011"), (None, "DQ-011"),
        (GOOD % ("g", 5, 0), ""), (GOOD % ("f", 7, 3), ""), (GOOD % ("f", 8, 4), "DQ-009"),
    ]
    raw = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(cases)], "raw string, arrival long")
    out = quality.validated(raw, F.lit(1775347300.0)).orderBy("arrival").collect()
    assert [",".join(r.violations) for r in out] == [want for _, want in cases]
    assert out[14].is_out_of_order and out[0].is_delayed and not out[0].is_out_of_order
    assert quality.quarantined(quality.validated(raw.limit(0))).count() == 0


def test_repeats_are_judged_in_order_of_arrival(spark):
    """Random ids and times against a plain loop; chains of repeats need several rounds."""
    rng = random.Random(11)
    rows = [(i, rng.random() < 0.8, rng.choice(["", *(f"e{k}" for k in range(60))]), f"A{rng.randrange(3)}", float(rng.randrange(1, 40))) for i in range(300)]
    rows += [(1000 + i, True, f"c{(i + 1) // 2}", "B", float(1 + i // 2)) for i in range(12)]
    ids, slots, want = set(), set(), {}
    for arrival, sound, event, asset, t in rows:
        want[arrival] = (event in ids, (asset, t) in slots)
        if sound and not any(want[arrival]):
            ids |= {event} if event else set()
            slots.add((asset, t))
    frame = spark.createDataFrame([(*r, [""], "STRING") for r in rows], "arrival long, sound boolean, event_id string, asset_id string, timestamp double, keys array<string>, k_event_id string")
    got = {r.arrival: (r.again_id, r.again_time) for r in quality.repeats(frame).collect()}
    assert got == {k: v for k, v in want.items() if any(v)}
    assert quality.repeats(frame.limit(0)).count() == 0


def test_rounding_is_that_of_python(spark):
    rng = random.Random(3)
    values = [2.5, -3.5, 0.5, -0.5, 0.125, 2.675, 1.005, -2.675, 0.4999995, 1e16, 1e300, 0.0, -0.0, 62.0625, *(rng.uniform(-1000, 1000) for _ in range(2000)), *(round(rng.uniform(-100, 100), 4) + 5e-5 for _ in range(2000)), *(rng.randrange(-9999, 9999) / 8 for _ in range(500))]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    for digits in (0, 1, 2, 3, 4):
        got = {r.x: r.y for r in frame.select("x", rounded_exactly(F.col("x"), digits).alias("y")).collect()}
        assert got == {v: round(v, digits) for v in values} | {None: None}


def test_lake_scan_prunes_and_pushes_down(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", "MOTOR-001" if i < 3 else "PUMP-001", 100.0 + 50 * i) for i in range(5)], "event_id string, asset_id string, timestamp double")
    tables.append_lake(tables.normalised(rows), str(tmp_path / "lake"))
    path = str(tmp_path / "lake")
    assert tables.scan(spark, path).count() == 5
    assert tables.scan(spark, path, asset_id="MOTOR-001").count() == 3
    found = tables.scan(spark, path, "PUMP-001", 260.0, 320.0, ["event_id", "timestamp"])
    assert [r.event_id for r in found.collect()] == ["e4"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(asset_id" in plan and "GreaterThanOrEqual(timestamp,260.0)" in plan and "temperature" not in plan.split("ReadSchema")[1]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    rows = spark.range(10)
    for batch in (1, 2, 2):
        tables.append_once(rows, str(tmp_path / "t"), batch)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    assert {(r.batch_id, r.rows) for r in tables.commit_history(spark, str(tmp_path / "t")).collect()} == {(1, 10), (2, 10)}


def test_frames_hold_the_last_120_samples(spark):
    """Asset A sends 200 samples in 20 s, more than a buffer holds; asset B sends 10, after a pause of 40 s."""
    t0 = 1704067200000000
    rows = [(i, "A", t0 + i * 100_000, float(i), float(200 - i), 5.0, 50.0) for i in range(200)]
    rows += [(1000 + i, "B", t0 + i * 1_000_000 + (40_000_000 if i >= 4 else 0), float(i), 1.0, 5.0, 50.0) for i in range(10)]
    frame = spark.createDataFrame(rows, "arrival long, asset_id string, t_us long, temperature double, vibration double, pressure double, current double")
    frame = frame.withColumns({"voltage": F.lit(400.0), "power": F.lit(20.0), "timestamp": F.col("t_us") / 1e6})
    got = {r.arrival: r for r in rolling_features(frame).collect()}
    assert (got[119].sample_count, got[119].mean_temperature, got[119].max_vibration) == (120, 59.5, 200.0)
    assert (got[199].sample_count, got[199].mean_temperature, got[199].max_vibration) == (120, 139.5, 120.0)
    assert got[199].thermal_rise_rate == 600.0 and got[199].baseline_temperature == 0.0
    assert (got[1009].sample_count, got[1009].mean_temperature) == (6, 6.5)
