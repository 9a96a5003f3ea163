"""Stored tables: commits, upserts by buckets, counted runs; ranks under ties; windows from panes."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assethealth.operators import commits, ingest, prefix, serving, tables, windows


def test_appends_are_commits_and_can_be_read_as_of_one(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.commits(spark, path).count() == 0 and commits.appended(spark, path) is None
    rows = spark.range(30).withColumn("part", F.col("id") % 3)
    assert [commits.append(rows.where(F.col("part") == b), path, b) for b in (0, 1, 1, 2)] == [1, 2, None, 3]
    assert [(r.commit, r.batch_id, r.rows) for r in commits.commits(spark, path).orderBy("commit").collect()] == [(1, 0, 10), (2, 1, 10), (3, 2, 10)]
    assert [commits.appended(spark, path, n).count() for n in (1, 2, 3)] == [10, 20, 30] and commits.appended(spark, path).count() == 30


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.append(spark.range(5), path, 1)
    spark.range(99).write.parquet(f"{path}/data/commit=2")  # data without a commit
    assert commits.appended(spark, path).count() == 5
    assert commits.append(spark.range(7), path, 2) == 2 and commits.appended(spark, path).count() == 12


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    merged = lambda old, new: tables.upserted(old, new, "key", "version")
    r, held, steps = random.Random(4), {}, {}
    for batch in range(4):
        keys = range(200) if batch == 0 else r.sample(range(230), 3)
        new = [(k, batch if k % 7 else -1, f"{k}-{batch}") for k in keys]
        for k, version, value in new:
            if k not in held or version >= held[k][0]:
                held[k] = (version, value)
        frame = spark.createDataFrame(new, "key long, version int, value string")
        assert commits.upsert(frame, path, batch, "key", merged, buckets=16) == batch + 1
        assert commits.upsert(frame, path, batch, "key", merged, buckets=16) is None  # the batch again
        steps[batch + 1] = dict(held)
        for n, want in steps.items():
            assert {x.key: (x.version, x.value) for x in commits.upserted(spark, path, n).collect()} == want
    assert len(list(Path(path, "data", "commit=1").glob("bucket=*"))) == 16
    assert all(len(list(Path(path, "data", f"commit={n}").glob("bucket=*"))) <= 3 for n in (2, 3, 4))


def test_runs_count_what_they_write(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").alias("arrival"), F.concat(F.lit("a"), F.col("id") % 4).alias("asset_id"), (F.col("id") % 10 > 0).alias("is_valid"), F.lit(False).alias("is_delayed"), (F.col("id") % 2 == 0).alias("is_out_of_order"))
    runs = [ingest.ingested(rows.where(F.col("arrival") < 60), path, 0, "one"), ingest.ingested(rows.where("arrival >= 60"), path, 1, "two"), ingest.ingested(rows, path, 1, "again")]
    assert [(x.generated, x.valid, x.quarantined, x.out_of_order, x.commit) for x in runs] == [(60, 54, 6, 30, 1), (40, 36, 4, 20, 2), (0, 0, 0, 0, None)]
    assert ingest.lake(spark, path).count() == 90 and ingest.quarantine(spark, path).count() == 10 and ingest.lake(spark, path, 1).count() == 54
    report = {(x.metric, x.name): x.value for x in ingest.run_report(spark, runs, path).collect()}
    assert report["events_generated", ""] == 100 and report["table_rows", ""] == 90 and report["snapshots", ""] == 2 and sum(v for (m, _), v in report.items() if m == "asset_rows") == 90
    assert runs[0].ledger(spark).first().status == "COMPLETED" and ingest.ingested(rows.limit(0), str(tmp_path / "e"), 0).status == "EMPTY"


def test_a_million_equal_scores_are_ranked_in_even_shares(spark, tmp_path, monkeypatch):
    n = 1_000_000
    rows = spark.range(n).select(F.when(F.col("id") < 10, 99.0).otherwise(50.0).alias("priority_score"), F.format_string("asset-%07d", F.col("id")).alias("asset_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(prefix, "scratch", lambda spark, name: str(tmp_path / name))
        out = serving.ranked(rows)
        wrong = out.where(F.col("ranking") != F.substring("asset_id", 7, 7).cast("int") + 1).count()
        tasks = [r["count"] for r in spark.read.parquet(str(tmp_path / "numbered")).groupBy("_task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert wrong == 0 and out.count() == n
    assert len(tasks) >= 4 and max(tasks) < 2 * n / len(tasks)


def test_no_rows_are_ranked(spark):
    assert serving.ranked(spark.createDataFrame([], "asset_id string, priority_score double")).count() == 0


@pytest.mark.parametrize(("size", "slide"), [(30, 5), (60, 5), (20, 10)])
def test_windows_from_panes_are_those_of_all_samples(spark, size, slide):
    r = random.Random(size)
    rows = [(f"PUMP-{i % 3}", i, r.randrange(0, 400) * 500_000 - 50_000_000, r.choice([None, r.uniform(600, 601), 650.0]), r.uniform(0, 9), r.choice([5.0, None, 5.25]), r.randrange(2)) for i in range(900)]
    rows += [("PUMP-8", 5000 + i, 1_000_000 * i, 650.1, 1.0, 5.0, 0) for i in range(200)]  # equal values have no deviation
    frame = spark.createDataFrame(rows, "asset_id string, arrival long, t_us long, temperature double, vibration double, pressure double, is_anomaly long").withColumn("event_time", F.timestamp_micros("t_us"))
    got = {tuple(x) for x in windows.window_summaries(frame, size, slide, 2, "SLIDING").collect()}
    w = F.window("event_time", f"{size} seconds", f"{slide} seconds")
    whole = frame.groupBy("asset_id", w.alias("w")).agg(*windows.summaries()).where("sample_count >= 2")
    want = {(x.asset_id, x.w.start.timestamp(), *[x[c] for c in whole.columns[2:]]) for x in whole.collect()}
    near = lambda x: (x[0], *[round(v, 2) if v is not None else None for v in x[1:]])
    assert Counter(near((x[1], x[3], *x[5:])) for x in got) == Counter(near(x) for x in want)
