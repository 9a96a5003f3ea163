"""Rolling features of each sample, over one window of its asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.config import DEFAULTS, Thresholds
from assethealth.functions.anomaly import anomalies
from assethealth.functions.columns import power_factor_deviation, rounded
from assethealth.functions.health import composite, electrical_part, persistence_part, pressure_part, reasons, thermal_part, vibration_part


SENSED = ("temperature", "vibration", "pressure", "current")


def _slope(y: str, w: object, n: Column, span: Column) -> Column:
    """Least-squares change a minute; 0 for fewer than two samples or a millisecond."""
    return F.when((n < 2) | (span <= 0.001), 0.0).otherwise(F.coalesce(F.regr_slope(F.col(y), F.col("rel")).over(w), F.lit(0.0)) * 60)


def rolling_features(samples: DataFrame, by: str = "asset_id", t: Thresholds = DEFAULTS, baselines: bool = True) -> DataFrame:
    """``samples`` with means, deviations, slopes, z-scores, ratios and baselines.

    The frame is the asset's samples of the last ``frame_seconds`` up to this
    one (those of equal time included), and of more than ``buffer_samples`` the
    last ones by time and arrival. Both frames end at the sample, so the shorter
    is the one that counts; only assets with a fuller frame pay for the second,
    and none is made where no asset can have one, which samples are counted for
    when this is called. All features share one shuffle by asset. Null sensors count in no mean. With
    ``baselines=False`` the table brings its own ``baseline_current``.
    """
    w = Window.partitionBy(by).orderBy("t_us").rangeBetween(-t.frame_seconds * 1_000_000, 0)
    past = Window.partitionBy(by).orderBy("t_us", "arrival").rowsBetween(Window.unboundedPreceding, 0)
    n, most = _sizes(samples, by, t)
    rows = dealt(samples, n, by).withColumn("rel", F.col("t_us") / 1e6 - F.lit(1704067200.0)).withColumns({"raw_count": F.count("*").over(w), **_frame_stats(w, F.count("*").over(w))})
    stats = {"sample_count": F.least("raw_count", F.lit(t.buffer_samples))}
    if 2 * most > t.buffer_samples:
        full = F.max("raw_count").over(Window.partitionBy(by)) > t.buffer_samples
        # samples of other assets are groups of their own, so that the second frame holds one row there
        rows = rows.withColumn("raw_group", F.when(full, F.lit(-1)).otherwise(F.col("arrival")))
        last = Window.partitionBy(by, "raw_group").orderBy("t_us", "arrival").rowsBetween(1 - t.buffer_samples, 0)
        capped = _frame_stats(last, F.count("*").over(last))
        rows = rows.withColumns({f"last_{k}": v for k, v in capped.items()})
        stats |= {k: F.when(F.col("raw_count") > t.buffer_samples, F.col(f"last_{k}")).otherwise(F.col(k)) for k in capped}
    if baselines:
        stats |= {f"baseline_{name}": F.first(name, ignorenulls=True).over(past) for name in SENSED}
    return derived(rows.withColumns(stats).drop("rel", "raw_count", "raw_group", *[x for x in rows.columns if x.startswith("last_raw_")]))


#: Samples that a task has in the mean, as all of them are sorted at once.
A_TASK = 50_000


def dealt(rows: DataFrame, n: int, by: str) -> DataFrame:
    """``n`` rows dealt by ``by`` over a number of tasks that grows with them; without it adaptive execution makes few and large ones, by the size before statistics are added."""
    return rows.repartition(max(1, -(-n // A_TASK)), by)


def _sizes(samples: DataFrame, by: str, t: Thresholds) -> tuple[int, int]:
    """Samples in all, and the most of an asset between two multiples of ``frame_seconds``: a frame lies in two such spans."""
    spans = samples.groupBy(by, F.floor(F.col("t_us") / (t.frame_seconds * 1_000_000))).agg(F.count("*").alias("n"))
    found = spans.agg(F.sum("n"), F.max("n")).first()
    return found[0] or 0, found[1] or 0


def _frame_stats(w: object, n: Column) -> dict[str, Column]:
    """Means, deviations, largest vibration and slopes over a frame of ``n`` samples."""
    span = F.col("rel") - F.min("rel").over(w)
    stats = {f"raw_mean_{x}": F.avg(x).over(w) for x in SENSED}
    stats |= {f"raw_std_{x}": F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)) for x in SENSED}
    return stats | {"raw_max_vibration": F.max("vibration").over(w), "raw_rise": _slope("temperature", w, n, span), "raw_vib_slope": _slope("vibration", w, n, span)}


def derived(rows: DataFrame) -> DataFrame:
    """Rounded features, z-scores and ratios out of a frame's ``raw_`` statistics, in batches and streams alike."""
    c = F.col
    z = lambda s: F.when(c(f"raw_std_{s}") > 1e-3, (c(s) - c(f"raw_mean_{s}")) / (c(f"raw_std_{s}") + 1e-5)).otherwise(0.0)
    base = F.coalesce(F.nullif(c("baseline_current"), F.lit(0.0)), F.nullif(c("raw_mean_current"), F.lit(0.0)), F.lit(1.0))
    out = {f"{k}_{s}": rounded(c(f"raw_{k}_{s}"), 3) for k in ("mean", "std") for s in SENSED}
    out |= {
        "max_vibration": rounded(c("raw_max_vibration"), 3),
        "thermal_rise_rate": rounded(c("raw_rise"), 4),
        "vibration_slope": rounded(c("raw_vib_slope"), 4),
        **{f"{s}_zscore": rounded(z(s), 3) for s in ("temperature", "vibration", "pressure")},
        "pressure_instability": rounded(F.when(c("raw_mean_pressure") > 0.01, c("raw_std_pressure") / (c("raw_mean_pressure") + 1e-5)).otherwise(0.0), 4),
        "current_ratio": rounded(F.when(base > 0.01, c("current") / base).otherwise(1.0), 3),
        "power_factor_deviation": rounded(power_factor_deviation(c("voltage"), c("current"), c("power")), 4),
    }
    return rows.withColumns(out).drop(*[x for x in rows.columns if x.startswith("raw_")])


def with_health(features: DataFrame, by: str = "asset_id", t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds anomalies, fault and healthy counts, sub-scores, ``health_score`` and reasons.

    The fault count goes up on a sample with anomalies and down to 0 at least
    on others. Reflected walks have a closed form: the plain sum of steps less
    its own running minimum below 0.
    """
    past = Window.partitionBy(by).orderBy("t_us", "arrival").rowsBetween(Window.unboundedPreceding, 0)
    rows = features.withColumn("anomalies", anomalies(t))
    step = F.when(F.size("anomalies") > 0, 1).otherwise(-1)
    rows = rows.withColumns({"walk": F.sum(step).over(past), "row": F.row_number().over(Window.partitionBy(by).orderBy("t_us", "arrival"))})
    rows = rows.withColumns({
        "fault_count": F.col("walk") - F.least(F.lit(0), F.min("walk").over(past)),
        "healthy_samples": F.col("row") - F.coalesce(F.max(F.when(F.size("anomalies") > 0, F.col("row"))).over(past), F.lit(0)),
    })
    parts = {"vibration_part": vibration_part(t), "thermal_part": thermal_part(t), "pressure_part": pressure_part(), "electrical_part": electrical_part(), "persistence_part": persistence_part()}
    return rows.withColumns(parts).withColumns({"health_score": composite(t), "degradation_reasons": reasons(t)}).drop("walk", "row")


def scored(samples: DataFrame, by: str = "asset_id", t: Thresholds = DEFAULTS) -> DataFrame:
    return with_health(rolling_features(samples, by, t), by, t)
