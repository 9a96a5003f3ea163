"""Reads of a relational catalog, sketches, and the quality of models on runs with a known wear."""

import random

import pytest
from pyspark.sql import functions as F

from assethealth.ml import data, metrics, models
from assethealth.operators import sketches
from assethealth.sources import relational


@pytest.fixture(scope="module")
def stored(spark):
    rows = spark.range(100).select(F.col("id").alias("asset"), F.concat(F.lit("site-"), F.col("id") % 3).alias("site"), (F.col("id") * 1.5).alias("cost"))
    for _ in range(2):  # the second replaces the first
        relational.store(rows, "TESTS", "REGISTRY")
    return f"{relational.with_catalog(spark)}.TESTS.REGISTRY"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_columns_and_counts_go_down_to_the_database(spark, stored):
    some = spark.table(stored).where("site = 'site-1' AND cost > 20").select("asset")
    assert "site = 'site-1'" in plan(some).replace("site = site-1", "site = 'site-1'") and "PushedFilters: [" in plan(some) and "cost > 20" in plan(some) and "ReadSchema: struct<asset:bigint>" in plan(some)
    assert sorted(r.asset for r in some.collect()) == [i for i in range(100) if i % 3 == 1 and i * 1.5 > 20]
    counts = spark.table(stored).groupBy("site").count()
    assert "PushedAggregates: [COUNT(*)]" in plan(counts) and {r.site: r["count"] for r in counts.collect()} == {"site-0": 34, "site-1": 33, "site-2": 33}


def test_tables_of_two_catalogs_in_one_text(spark, stored):
    spark.createDataFrame([(1, "WATCH"), (2, "HEALTHY"), (200, "WATCH")], "asset long, state string").createOrReplaceTempView("lake_states")
    found = spark.sql(f"SELECT s.state, r.site FROM lake_states s JOIN {stored} r ON s.asset = r.asset")
    assert {tuple(r) for r in found.collect()} == {("WATCH", "site-1"), ("HEALTHY", "site-2")}


def test_a_table_is_read_in_ranges_of_its_key(spark, stored):
    rows = relational.read_parts(spark, "TESTS.REGISTRY", "asset", 4)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100 and len(sizes) == 4 and max(sizes) <= 26


def test_a_cluster_needs_a_named_database(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    with pytest.raises(ValueError, match="relational.url"):
        relational.connection(spark)


def test_sketches_of_batches_add_up(spark):
    rows = spark.range(60_000).select((F.col("id") % 17_000).alias("asset"), (F.col("id") % 5).alias("batch"), F.lit("a").alias("kind"))
    merged = sketches.merged(sketches.sketched(rows, "asset", ("kind", "batch")), ("kind",)).first()
    assert merged["rows"] == 60_000 and abs(merged["distinct"] - 17_000) <= 0.03 * 17_000
    none = sketches.merged(sketches.sketched(rows.withColumn("asset", F.lit(None).cast("long")), "asset", ("kind",)), ("kind",)).first()
    assert none["distinct"] == 0


@pytest.fixture(scope="module")
def worn(spark, tmp_path_factory):
    """Forty runs of 60 steps, half of which wear out in their last third; labels of 15 steps."""
    r, rows = random.Random(11), []
    for run in range(40):
        fails = run % 2 == 0
        for step in range(60):
            wear = max(0, step - 38) / 21 if fails else 0.0
            row = {n: r.gauss(0, 1) for n in models.NUMBERS} | {"vibration": 2 + 6 * wear + r.gauss(0, 0.4), "temperature": 60 + 30 * wear + r.gauss(0, 2)}
            left = max(0, 59 - step) if fails else 120
            rows.append((f"run-{run:02}", step, *[row[n] for n in models.NUMBERS], "PUMP", "NORMAL", int(fails and left <= 15), float(min(left, 120))))
    names = ", ".join(f"{n} double" for n in models.NUMBERS)
    frame = spark.createDataFrame(rows, f"run_id string, step int, {names}, {data.CATEGORIES[0]} string, {data.CATEGORIES[1]} string, label_failure int, label_rul double")
    path = str(tmp_path_factory.mktemp("worn"))
    data.with_weights(data.split_by_run(frame)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["logistic", "forest", "boosted"])
def test_classifiers_reach_the_gates(worn, name):
    model = models.fit(worn.where("split = 'train'"), models.classifier(name))
    scored = models.with_failure_risk(worn.where("split = 'test'"), model)
    found = metrics.classification_metrics(scored).first()
    assert metrics.average_precision(scored).first()["pr_auc"] >= 0.7 and metrics.roc_auc(scored).first()["roc_auc"] >= 0.9
    assert found["recall"] >= 0.8 and found["precision"] >= 0.5
    again = models.with_failure_risk(worn.where("split = 'test'"), models.fit(worn.where("split = 'train'"), models.classifier(name)))
    assert again.select("prob_failure").exceptAll(scored.select("prob_failure")).count() == 0


@pytest.mark.parametrize("name", ["linear", "forest", "boosted"])
def test_regressors_reach_the_gates(worn, name):
    near = worn.where("label_rul < 120")
    scored = models.with_remaining_life(near.where("split = 'test'"), models.fit(near.where("split = 'train'"), models.regressor(name)))
    found = metrics.regression_metrics(scored).first()
    assert found["r2"] >= 0.35 and found["rmse_to_cap_ratio"] <= 0.3 and found["accuracy_within_25pct"] >= 0.5
    assert scored.where("pred_rul < 0 OR pred_rul > 120").count() == 0


def test_scored_batches_have_tiers_and_reasons(worn):
    train = worn.where("split = 'train'")
    risk, life = models.fit(train, models.classifier("forest")), models.fit(train, models.regressor("forest"))
    rows = models.scored(worn.where("split = 'test'"), risk, life).collect()
    tier = lambda p, rul: "EMERGENCY" if p >= 0.8 or rul <= 10 else "HIGH" if p >= 0.6 or rul <= 25 else "MEDIUM" if p >= 0.35 or rul <= 50 else "LOW"
    assert rows and all(r.maintenance_priority == tier(r.prob_failure, r.pred_rul) for r in rows)
    assert {x.feature for x in rows[0].top_features} >= {"vibration", "temperature"} and len(rows[0].top_features) == 3
    assert all(float(r.top_features[0].importance) >= float(r.top_features[1].importance) and r.top_features[0].observed_value == str(r[r.top_features[0].feature]) for r in rows)
