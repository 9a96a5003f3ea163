"""Health states and alerts against a plain fold, also of one asset far longer than a chunk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assethealth.operators import alerts

KIND = "array<struct<level:int,severity:string>>"


def history(n, seed, calm=0.3):
    """Rows of assets: one with half of all, with ties in time; stretches of calm in between."""
    r, out, score = random.Random(seed), [], 0.9
    for i in range(n):
        asset = "long" if i % 2 else f"a{r.randrange(9)}"
        score = min(1.0, max(0.2, score + r.uniform(-0.2, 0.2))) if r.random() > calm else 0.95
        found = [(r.choice([1, 2, 3]), r.choice(["WARNING", "HIGH", "CRITICAL"])) for _ in range(r.choice([0, 0, 0, 1, 2]) if score < 0.9 else 0)]
        out.append((asset, i, i // 3 * 7_000_000, round(score, 3), found))
    return out


def plain(rows):
    states, out = {}, {}
    for asset, arrival, t_us, score, found in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        critical = any(level == 1 and severity == "CRITICAL" for level, severity in found)
        worst = max([["INFO", "WARNING", "HIGH", "CRITICAL"].index(s) for _, s in found], default=0)
        state, step = alerts.advance(states.get(asset, alerts.State()), t_us / 1e6, score, critical, len(found), worst)
        states[asset] = state
        out[asset, arrival] = (step.health, step.previous, step.recovery, step.severity, step.outcome)
    return out


@pytest.mark.parametrize("chunk", [1_000_000, 37, 1])
def test_fold_of_long_and_short_histories(spark, chunk):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # runs go on from batch to batch
    try:
        rows = history(1500, 3)
        frame = spark.createDataFrame([(a, i, t, s, f) for a, i, t, s, f in rows], f"asset_id string, arrival long, t_us long, health_score double, anomalies {KIND}")
        got = alerts.folded(frame.repartition(5), chunk=chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(rows)
    assert len(got) == len(rows)
    assert {(r.asset_id, r.arrival): (r.health_rank, r.previous_rank, r.is_recovery, r.severity_rank, r.outcome) for r in got} == want
    assert {x[4] for x in want.values()} == {0, 1, 2}


def test_a_long_asset_is_spread(spark):
    rows = history(2000, 5)
    frame = spark.createDataFrame(rows, f"asset_id string, arrival long, t_us long, health_score double, anomalies {KIND}").withColumns(alerts.fold_inputs())
    numbered = frame.withColumn("step", alerts.step_code()).withColumn("chunk", F.expr("cast(arrival div 100 as int)")).where("asset_id = 'long'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be put together again
    try:
        spread = alerts._passed(numbered, "asset_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in spread) < 500


def test_composed_steps(spark):
    r = np.random.default_rng(1)
    steps, starts = r.integers(0, 256, 500), np.array([0, 3, 4, 200, 499])
    got = alerts.composed(steps, starts, 0b00_01_10_11)
    for i in range(500):
        first = starts[starts <= i].max()
        for s in range(4):
            state = (0b00_01_10_11 >> 2 * s) & 3 if first == 0 else s
            for k in range(first, i + 1):
                state = (int(steps[k]) >> 2 * state) & 3
            assert (int(got[i]) >> 2 * s) & 3 == state


def test_no_rows(spark):
    frame = spark.createDataFrame([], f"asset_id string, arrival long, t_us long, health_score double, anomalies {KIND}")
    assert alerts.folded(frame).count() == 0
