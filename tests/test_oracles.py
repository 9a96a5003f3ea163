"""Every query that has SQL gives the same rows as another engine does, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from assethealth.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
# one query of each kind; all of them are compared by the driver
NAMES = ["f2_rolling_mean", "f5_ols_slope", "f16_fault_count", "a10_anomaly_counts", "h6_health_score", "h9_transitions", "l2_alert_gating", "w2_lateness", "w4_sliding_window", "w5_merged_windows", "q14_verdicts", "q16_telemetry_contract",
         "k1_current_state", "k7_work_orders", "k8_kpi_snapshots", "b1_fleet_health", "b9_fleet_outliers", "b13_threshold_sensitivity", "b14_repair_top3", "d15_alert_log", "u1_upsert_state", "u2_upsert_registry", "m3_remaining_life", "m6_split_by_run",
         "m12_label_correlation", "m22_roc_auc", "m23_average_precision", "m24_regression_metrics", "w10_raw_to_alert_stream", "m29_promotion_gates"]


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, other, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = other.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 150


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_queries_are_there_before_any_session():
    """Column expressions need a session, so none may be made when modules are loaded."""
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
