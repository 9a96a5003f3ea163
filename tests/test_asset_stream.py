"""The one stream of messages: judged in order of arrival, late samples in their frames, whatever the cut of micro-batches."""

import json

from pyspark.sql import functions as F

from assethealth.streaming import asset_stream

T0 = 1704067200.0


def message(event_id, seconds, temperature=60.0, asset="PUMP-001", sequence=1, **more):
    fields = {"event_id": event_id, "asset_id": asset, "asset_type": "PUMP", "timestamp": T0 + seconds, "temperature": temperature, "vibration": 1.0, "pressure": 5.0, "rpm": 1500.0, "current": 50.0, "voltage": 400.0, "power": 30.0, "load": 50.0}
    return json.dumps(fields | {"operating_mode": "NORMAL", "sequence_number": sequence, "schema_version": "1.0.0"} | more)


def run(spark, tmp_path, parts, name="run", ttl_ms=asset_stream.DAY_MS):
    """Outputs of messages in parts, the stream stopped and started between them."""
    path, check = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-check")
    outputs = {k: str(tmp_path / f"{name}-{k}") for k in asset_stream.OUTPUTS}
    first = 0
    for part in parts:
        rows = [(m, first + i) for i, m in enumerate(part)]
        first += len(part)
        spark.createDataFrame(rows, "raw string, arrival long").repartition(3).write.mode("append").parquet(path)
        asset_stream.drained(spark.readStream.schema("raw string, arrival long").parquet(path), outputs, check, ttl_ms=ttl_ms)
    return outputs, check


def rows_of(spark, path, *columns):
    return sorted((tuple(r) for r in spark.read.parquet(path).select(*columns).collect()), key=str)


SENT = [
    message("a", 0, sequence=1),
    message("b", 1, sequence=2, vibration=-1.0),  # broken: does not count as seen
    message("b", 1, sequence=2),
    message("a", 2, sequence=3),  # its id again
    message("c", 1, sequence=3),  # the time of b again
    message("d", 50, temperature=130.0, sequence=9),
    message("e", 20, sequence=4),  # 30 s back: late, taken, and its number is behind
    message("f", 14.9, sequence=10),  # more than 35 s back
    message("f", 51, sequence=11),  # that one counts as seen
    message("g", 51.0004, sequence=12),  # another millisecond than f's second one, which was refused
    "[1, 2]", '{"event_id": "x", "asset_id": "PUMP-0',
    message("a", 0, asset="PUMP-002"),  # ids are told apart within an asset
    message("h", 100, sequence=13),
]


def test_messages_are_judged_in_order_of_arrival(spark, tmp_path):
    outputs, _ = run(spark, tmp_path, [SENT])
    processed = rows_of(spark, outputs["processed"], "asset_id", "event_id", "lateness", "out_of_order")
    on, late = "ON_TIME", "LATE_ACCEPTED"
    assert processed == sorted([("PUMP-001", "a", on, False), ("PUMP-001", "b", on, False), ("PUMP-001", "d", on, False), ("PUMP-001", "e", late, True), ("PUMP-001", "g", on, False), ("PUMP-001", "h", on, False), ("PUMP-002", "a", on, False)], key=str)
    refused = rows_of(spark, outputs["quarantine"], "event_id", "violations")
    assert refused == sorted([("b", "DQ-007"), ("a", "DQ-009"), ("c", "DQ-010"), ("f", "DQ-009"), ("UNKNOWN", "DQ-011"), ("UNKNOWN", "DQ-011")], key=str)
    assert rows_of(spark, outputs["late"], "event_id", "lateness") == [("f", "EXCESSIVELY_LATE")]
    alerts = rows_of(spark, outputs["alerts"], "event_id", "current_health_state")
    assert ("d", "CRITICAL") in alerts and all(e in "deghab" for e, _ in alerts)
    windows = rows_of(spark, outputs["windows"], F.col("window_start") - T0, "sample_count", "asset_id")
    assert windows == sorted([(0.0, 2, "PUMP-001"), (20.0, 1, "PUMP-001"), (50.0, 2, "PUMP-001")], key=str)


def test_results_do_not_depend_on_micro_batches(spark, tmp_path):
    whole, _ = run(spark, tmp_path, [SENT], "whole")
    cut, _ = run(spark, tmp_path, [SENT[:3], SENT[3:8], SENT[8:]], "cut")
    for name in asset_stream.OUTPUTS:
        columns = spark.read.parquet(whole[name]).drop("batch_id").columns
        assert rows_of(spark, whole[name], *columns) == rows_of(spark, cut[name], *columns), name


def test_state_can_be_read_and_expires(spark, tmp_path):
    path = [[message("a", 0), message("b", 1)], [message("z", 5, asset="MOTOR-009")], [message("a", 2)]]
    _, check = run(spark, tmp_path, path[:1], "kept")
    ids = asset_stream.state_of(spark, check, "intake", "ids").select("user_map_key.event_id").collect()
    assert {r.event_id for r in ids} == {"a", "b"}
    frame = asset_stream.state_of(spark, check, "intake", "frame").select("list_element.value.t_us").collect()
    assert sorted(r.t_us for r in frame) == [int(T0 * 1e6), int(T0 * 1e6) + 1_000_000]
    outputs, check = run(spark, tmp_path, path, "gone", ttl_ms=1000)
    assert rows_of(spark, outputs["processed"], "event_id", "asset_id") == sorted([("a", "PUMP-001"), ("b", "PUMP-001"), ("z", "MOTOR-009"), ("a", "PUMP-001")], key=str)
    held = asset_stream.state_of(spark, check, "intake", "progress").select("key.key").collect()
    assert [r.key for r in held] == ["PUMP-001"]


def test_settings_are_as_before(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    run(spark, tmp_path, [[message("a", 0)]], "one")
    assert spark.conf.get(name) == before
