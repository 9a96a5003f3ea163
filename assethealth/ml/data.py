"""Labels, splits, leakage audits and dataset summaries for failure and remaining-life models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.functions.columns import rounded
from assethealth.operators.prefix import numbered

#: Names of this kind are never features (fixed values).
FORBIDDEN = (
    "scenario_id", "scenario_name", "maintenance_state", "degradation_stage", "ground_truth_rul_hours", "ground_truth_rul", "has_failure",
    "label_failure", "label_rul", "failure_time", "target", "label", "is_synthetic",
)
RAW = ("temperature", "vibration", "pressure", "current", "voltage", "power", "load_pct", "ambient_temp")
CATEGORIES = ("asset_type", "operating_mode")
ROLLING = tuple(f"rolling_{k}_{s}" for s in ("temp", "vib", "pres", "current", "power") for k in ("mean", "std"))
FEATURES = (*RAW, *CATEGORIES, *ROLLING, "thermal_rise_rate", "vibration_slope", "current_load_ratio", "pressure_instability", "health_score")
SPLITS = ("train", "validation", "test")
HEALTHY_SCENARIOS = (1, 6)


def feature_table(scored: DataFrame, ambient: float = 25.0, compat: bool = False) -> DataFrame:
    """Features of each sample of each run, a run being an asset's history.

    ``compat`` gives rolling power as the published data set has it (power
    itself and five per cent of it); otherwise it is a true rolling statistic.
    """
    order = Window.partitionBy("asset_id").orderBy("t_us")
    w = order.rangeBetween(-30_000_000, 0)
    step = F.row_number().over(Window.partitionBy("asset_id").orderBy("t_us", "arrival")) - 1
    mean_power = F.col("power") if compat else rounded(F.avg("power").over(w), 3)
    std_power = rounded(0.05 * F.col("power"), 6) if compat else rounded(F.coalesce(F.stddev_samp("power").over(w), F.lit(0.0)), 3)
    names = {"temp": "temperature", "vib": "vibration", "pres": "pressure", "current": "current"}
    return scored.select(
        F.col("asset_id").alias("run_id"), "asset_id", "asset_type", "timestamp", "t_us", "arrival", step.alias("step"), "operating_mode", "scenario",
        "temperature", "vibration", "pressure", "current", "voltage", "power", F.col("load").alias("load_pct"), F.lit(ambient).alias("ambient_temp"),
        *[F.col(f"{k}_{v}").alias(f"rolling_{k}_{s}") for s, v in names.items() for k in ("mean", "std")], mean_power.alias("rolling_mean_power"), std_power.alias("rolling_std_power"),
        "thermal_rise_rate", "vibration_slope", F.col("current_ratio").alias("current_load_ratio"), "pressure_instability", "health_score",
    )


def has_failure(scenario: Column) -> Column:
    return ~scenario.isin(*HEALTHY_SCENARIOS)


def labelled(rows: DataFrame, cap: float = 120.0, to_failure: float = 120.0, horizon: int = 120) -> DataFrame:
    """Adds ``label_rul`` (linear to the end of the run, capped) and ``label_failure`` (1 for the last horizon + 1 steps)."""
    n = F.count("*").over(Window.partitionBy("run_id"))
    left = n - 1 - F.col("step")
    fails = has_failure(F.col("scenario"))
    rul = F.when(fails, F.least(F.lit(cap), left / n * to_failure)).otherwise(F.lit(cap))
    return rows.withColumns({"label_rul": rounded(rul, 4), "label_failure": F.when(fails & (F.col("step") >= F.greatest(F.lit(0), n - 1 - horizon)), 1).otherwise(0)})


def features_only(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """The feature columns alone; refuses missing ones and names that smell of the target."""
    leaked = forbidden_names(names)
    if leaked:
        raise ValueError(f"target columns among the features: {leaked}")
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return rows.select(*names)


def forbidden_names(names: tuple[str, ...] | list[str]) -> list[str]:
    return [n for n in names if any(f in n.lower() for f in FORBIDDEN)]


def split_by_run(rows: DataFrame, shares: tuple[float, float] = (0.7, 0.15), seed: int | None = None) -> DataFrame:
    """Adds ``split`` by whole runs, ordered by the MD5 of their ids; counts are rounded half to even.

    Another ``seed``, put before the ids, gives another order, and so another split of the same sizes.
    """
    runs = rows.select("run_id").distinct()
    key = F.md5("run_id") if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), "run_id"))
    placed = numbered(runs.withColumn("key", key), F.col("key"), F.col("run_id"))
    n = placed.count()
    cut1 = F.bround(F.lit(n) * shares[0]).cast("long")
    cut2 = cut1 + F.bround(F.lit(n) * shares[1]).cast("long")
    place = F.col("number")
    named = placed.select("run_id", F.when(place <= cut1, SPLITS[0]).when(place <= cut2, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
    return rows.join(named, "run_id")


def split_by_time(rows: DataFrame) -> DataFrame:
    """Adds ``split`` by time within each run: the first 70 %, the next 15 %, the rest."""
    n = F.count("*").over(Window.partitionBy("run_id"))
    return rows.withColumn("split", F.when(F.col("step") < F.floor(n * 0.7), SPLITS[0]).when(F.col("step") < F.floor(n * 0.85), SPLITS[1]).otherwise(SPLITS[2]))


def class_weights(rows: DataFrame) -> DataFrame:
    """``w0, w1`` from the training rows: N / 2 N_k; 1 and 1 without positives."""
    n, p = F.count("*"), F.sum("label_failure")
    some = (p > 0) & (p < n)
    return rows.where("split = 'train'").agg(F.coalesce(F.when(some, F.try_divide(n, 2 * (n - p))), F.lit(1.0)).alias("w0"), F.coalesce(F.when(some, F.try_divide(n, 2 * p)), F.lit(1.0)).alias("w1"))


def with_weights(rows: DataFrame) -> DataFrame:
    weights = class_weights(rows)  # one row
    return rows.crossJoin(F.broadcast(weights)).withColumn("sample_weight", rounded(F.when(F.col("label_failure") == 1, F.col("w1")).otherwise(F.col("w0")), 6)).drop("w0", "w1")


def order_violations(rows: DataFrame) -> DataFrame:
    """Runs whose times go back or whose splits overlap in time: ``run_id, backwards, overlapping``."""
    back = F.col("timestamp") < F.lag("timestamp").over(Window.partitionBy("run_id").orderBy("step"))
    end = lambda s: F.max(F.when(F.col("split") == s, F.col("timestamp")))
    start = lambda s: F.min(F.when(F.col("split") == s, F.col("timestamp")))
    overlap = F.coalesce(end("train") > start("validation"), F.lit(False)) | F.coalesce(end("validation") > start("test"), F.lit(False))
    found = rows.withColumn("back", back).groupBy("run_id").agg(F.count_if("back").alias("backwards"), overlap.alias("overlapping"))
    return found.where("backwards > 0 OR overlapping")


def label_correlations(rows: DataFrame, label: str, names: tuple[str, ...]) -> DataFrame:
    """``feature, correlation, flagged``: absolute Pearson correlation with the label, in one pass; 0 without spread."""
    spread = lambda n: (F.stddev_pop(n) > 1e-6) & (F.stddev_pop(label) > 1e-6)
    one = rows.agg(*[F.coalesce(F.when(spread(n), F.abs(F.try_divide(F.covar_pop(n, label), F.stddev_pop(n) * F.stddev_pop(label)))), F.lit(0.0)).alias(n) for n in names])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), rounded(F.col(n), 6).alias("correlation")) for n in names])).alias("r")).select("r.*")
    return long.withColumn("flagged", F.col("correlation") >= 0.999)


def leakage_audit(rows: DataFrame, names: tuple[str, ...], label: str = "label_failure") -> DataFrame:
    """``check_name, status, found``: names, time order and correlation."""
    spark = rows.sparkSession
    numbers = tuple(n for n in names if n not in CATEGORIES)
    bad = len(forbidden_names(names))
    by_name = spark.range(1).select(F.lit("feature_whitelist").alias("check_name"), F.lit(bad).cast("long").alias("found"))
    order = order_violations(rows).agg(F.count("*").alias("found")).select(F.lit("temporal_ordering").alias("check_name"), "found")
    corr = label_correlations(rows, label, numbers).agg(F.count_if("flagged").alias("found")).select(F.lit("label_correlation").alias("check_name"), "found")
    return by_name.union(order).union(corr).select("check_name", F.when(F.col("found") == 0, "PASS").otherwise("FAIL").alias("status"), "found")


def dataset_summary(rows: DataFrame) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in FEATURES])
    return rows.agg(
        F.count("*").alias("total_rows"), F.count_distinct("run_id").alias("runs"), F.count_distinct("asset_id").alias("assets"), F.count_distinct("asset_type").alias("asset_types"),
        rounded(F.avg("label_failure"), 6).alias("failure_prevalence"), nulls.alias("null_values"), F.min("label_rul").alias("min_rul"), F.max("label_rul").alias("max_rul"),
        rounded(F.avg("label_rul"), 4).alias("mean_rul"), rounded(F.percentile("label_rul", 0.5), 4).alias("median_rul"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
    )


def label_integrity(rows: DataFrame) -> DataFrame:
    return rows.agg(F.bool_and(F.col("label_rul").between(0, 120)).alias("rul_in_range"), F.bool_and(F.col("label_failure").isin(0, 1)).alias("labels_binary"))


def split_disjointness(rows: DataFrame) -> DataFrame:
    runs = rows.groupBy("run_id").agg(F.count_distinct("split").alias("splits"))
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("splits") > 1).alias("shared_runs"))


def split_statistics(rows: DataFrame) -> DataFrame:
    groups = rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("label_failure").alias("positives"), rounded(F.avg("label_failure"), 6).alias("prevalence"))
    return groups.withColumn("ratio", rounded(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
