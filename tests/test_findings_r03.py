"""What the third round's review has found."""

import contextlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assethealth.ml import metrics
from assethealth.operators import alerts, features, quality, serving, tables
from assethealth.plans import queries as registry_queries, registry, stream_queries
from assethealth.plans.raw_events import with_defects
from assethealth.schemas import TELEMETRY
from assethealth.sources.scratch import scratch
from assethealth.sources.telemetry import telemetry
from assethealth.streaming import asset_stream

SF = "/root/testdata/sf0.001"


def test_no_two_raw_events_share_an_arrival(spark):
    rows = telemetry(spark, SF)
    many = rows.union(rows.withColumn("arrival", F.col("arrival") + 1_000_000))
    found = with_defects(many).agg(F.count("*").alias("n"), F.count_distinct("arrival").alias("different")).first()
    assert found.n == found.different > 2 * rows.count()


def test_labels_without_spread_have_no_r2(spark):
    rows = spark.range(0, 12_875, 1, 7).select(F.lit(120.0).alias("label_rul"), (100 - F.col("id") % 9).cast("double").alias("pred_rul"))
    assert metrics.regression_metrics(rows).first().r2 == 0


def planned(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_event_text_is_parsed_once(spark):
    raw = spark.createDataFrame([('{"event_id":"a","rpm":1,"load":null,"sequence_number":true,"more":{"x":1}}', 1), ("[1,2]", 2), ('{"rpm":"1","load":2.5', 3), (None, 4), ("{}", 5)], "raw string, arrival long")
    rows = quality.parsed(raw)
    assert planned(rows).lower().count("parsejson") == 1 and "json_object_keys" not in planned(rows)
    found = {r.arrival: r for r in rows.drop("v").collect()}
    assert [found[k]["keys"] for k in (2, 3, 4, 5)] == [None, None, None, []]
    assert sorted(found[1]["keys"]) == ["event_id", "load", "more", "rpm", "sequence_number"]
    assert [found[1][f"k_{f}"] for f in ("event_id", "rpm", "load", "sequence_number", "power")] == ["STRING", "BIGINT", "VOID", "BOOLEAN", None]
    assert (found[1].rpm, found[1].load, found[1].sequence_number, found[1].event_id) == (1.0, None, None, "a")


def test_contract_is_judged_on_stored_fields(spark):
    assert "parsejson" not in planned(registry.queries()["q16_telemetry_contract"](spark, SF)).lower()


def test_state_of_samples_of_one_millisecond_is_that_of_the_first(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    again = rows.where("event_id % 7 = 0").withColumns({"event_id": F.col("event_id") + 100_000, "ts": F.col("ts") + F.expr("INTERVAL 1 SECOND"), "value": F.lit(199.0), "event_type": F.lit("error")})  # 139 microseconds of t_us
    rows.unionByName(again).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = registry.queries()["w8_state_lifetime"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    wanted = con.execute(registry.oracle_sql()["w8_state_lifetime"]).fetchall()
    assert sorted(map(tuple, found)) == sorted(wanted) and len(wanted) > 10


def test_tasks_of_features_and_states_grow_with_samples(spark, monkeypatch):
    rows = telemetry(spark, SF)
    monkeypatch.setattr(features, "A_TASK", 100)
    scored = features.scored(rows)
    assert scored.rdd.getNumPartitions() == -(-rows.count() // 100) > 4
    assert alerts.with_states(scored, together=True).rdd.getNumPartitions() == scored.rdd.getNumPartitions()
    moved = alerts.with_states(scored).select("arrival", "health_state", "outcome")
    assert sorted(alerts.with_states(scored, together=True).select("arrival", "health_state", "outcome").collect()) == sorted(moved.collect())


def test_second_frame_is_made_only_where_an_asset_may_need_it(spark):
    rows = telemetry(spark, SF)
    assert "last_raw" not in planned(features.rolling_features(rows))
    crowd = rows.withColumns({"asset_id": F.lit("PUMP-001"), "t_us": F.expr("t_us div 30")})
    assert "last_raw" in planned(features.rolling_features(crowd))


def test_current_states_are_taken_from_few_columns(spark):
    plan = planned(serving.current_state(registry_queries.states(spark, SF)))
    assert "degradation_reasons" not in plan and "baseline_current" not in plan


class Enough(Exception):
    """A query has given what a test looks at."""


def test_routed_batches_hold_only_what_is_written(spark, monkeypatch):
    def route(outputs, paths):
        def write(batch, batch_id):
            batch.limit(1).write.mode("overwrite").json(seen)

        return write

    seen = scratch(spark, "seen")
    monkeypatch.setattr(stream_queries.jobs, "routed", route)
    with contextlib.suppress(AnalysisException):  # nothing is routed, so there is nothing to read
        stream_queries.routed(spark, SF)
    assert set(spark.read.json(seen).columns) == {"arrival", "violations"}


def test_state_streams_score_samples_once(spark, monkeypatch):
    def look(rows):
        assert "Window" not in planned(rows)
        raise Enough

    monkeypatch.setattr(stream_queries, "in_time_order", look)
    for query in (stream_queries.state_stream, stream_queries.restarted):
        with pytest.raises(Enough):
            query(spark, SF)


def test_folders_of_the_lake_do_not_grow_with_assets(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("PUMP-"), "id").alias("asset_id"), F.col("id").cast("string").alias("event_id"), F.lit(5.0).alias("timestamp"))
    lake = str(tmp_path / "lake")
    for _ in range(2):
        tables.append_lake(tables.normalised(rows), lake, tables.BUCKETS)
    assert len(list((tmp_path / "lake").glob("*=*"))) <= tables.BUCKETS < 500
    one = tables.scan(spark, lake, "PUMP-7", 5.0, 5.0, buckets=tables.BUCKETS)
    assert len(one.inputFiles()) > 2 and "PartitionFilters: [isnotnull(bucket" in planned(one) and one.columns == [f.name for f in TELEMETRY]
    assert [r.event_id for r in one.collect()] == ["7", "7"] and tables.scan(spark, lake, buckets=tables.BUCKETS).count() == 1000
    assert tables.scan(spark, lake, min_ts=5.1, buckets=tables.BUCKETS).count() == 0


def test_provisioned_partitions_do_not_grow_with_assets(spark):
    found = registry.queries()["s7_provisioned_tables"](spark, SF)
    assert {r.tables for r in found.collect()} == {4}
    table = [x.name for x in spark.catalog.listDatabases("lake_*")][-1]
    assert [p.partition for p in spark.sql(f"SHOW PARTITIONS {table}.telemetry").limit(1).collect()][0].startswith("bucket=")


def test_raw_events_come_from_one_window(spark):
    assert planned(with_defects(telemetry(spark, SF))).count("Window [") == 1


def test_judged_events_leave_behind_what_rules_have_read(spark):
    rows = with_defects(telemetry(spark, SF)).limit(50)
    assert not [x for x in quality.validated(rows).columns if x == "keys" or x.startswith("k_")]


class Kept:
    """State of one asset in a dictionary, which counts look-ups of keys."""

    def __init__(self):
        self.value, self.entries, self.looked = None, {}, 0
        self.exists, self.get = lambda: self.value is not None, lambda: self.value
        self.put = self.update = lambda value: setattr(self, "value", value)

    def updateValue(self, key, value):
        self.entries[key] = value

    def containsKey(self, key):
        self.looked += 1
        return key in self.entries


def test_an_asset_without_state_is_judged_without_look_ups():
    intake, made = asset_stream.Intake(), {}
    kept = lambda name, *_: made.setdefault(name, Kept())
    intake.init(SimpleNamespace(getMapState=kept, getValueState=kept, getListState=kept))
    columns = [x.split()[0] for x in asset_stream.MESSAGE.split(", ")]

    def judged(*sent):
        rows = [dict.fromkeys(columns, 1.0) | {"asset_id": "PUMP-1", "event_id": e, "arrival": a, "t_us": a * 1_000_000, "timestamp": float(a), "sequence": a, "moment": m, "broken": "", "raw": ""} for a, e, m in sent]
        out = list(intake.handleInputRows(("PUMP-1",), iter([pd.DataFrame(rows, columns=columns)]), None))[0]
        return list(zip(out["kind"], out["violations"], strict=True))

    good = ("sample", None)
    assert judged((1, "a", "1.0"), (2, "a", "2.0"), (3, "b", "1.0"), (4, "c", "4.0")) == [good, ("quarantine", "DQ-009"), ("quarantine", "DQ-010"), good]
    assert made["ids"].looked == made["moments"].looked == 0
    assert judged((5, "c", "5.0"), (6, "d", "4.0"), (7, "e", "7.0"), (8, "e", "7.0")) == [("quarantine", "DQ-009"), ("quarantine", "DQ-010"), good, ("quarantine", "DQ-009,DQ-010")]
    assert made["ids"].looked == 3


def test_statistics_of_all_sensors_at_once_are_those_of_each():
    frame = np.random.default_rng(3).normal(50, 9, (40, 4))
    for rows in (1, 2, 7, 8, 40):
        each = [s for x in frame[:rows].T for s in asset_stream._mean_std(x)]
        assert asset_stream._stats(frame[:rows]) == pytest.approx(each, rel=1e-12)
    frame[3, 2] = np.nan
    assert asset_stream._stats(frame) == [s for x in frame.T for s in asset_stream._mean_std(x)]


@pytest.fixture(scope="module")
def million(spark, tmp_path_factory):
    """Events a million apart, as repeats once were from their samples."""
    d = tmp_path_factory.mktemp("million")
    rows = spark.read.parquet(f"{SF}/events.parquet")
    far = rows.withColumns({"event_id": F.col("event_id") + 1_000_000, "user_id": F.col("user_id") + 5000})
    rows.unionByName(far).coalesce(1).write.parquet(str(d / "events.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["q13_out_of_order", "q14_verdicts", "q15_violation_counts", "q9_duplicate_event", "u10_quality_log", "u11_quarantine", "u9_observed_ledger", "w13_stream_progress"])
def test_events_a_million_apart_are_judged_as_in_sql(spark, million, name):
    found = registry.queries()[name](spark, million)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{million}/events.parquet/*.parquet')")
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str) and wanted
