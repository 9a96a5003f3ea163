"""Event-time windows, watermarks and lateness, and stream progress figures, over batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.config import DEFAULTS, Thresholds
from assethealth.functions.columns import rounded, stable_id
from assethealth.operators.prefix import running_sums


def endpoint_slope(y: str) -> Column:
    """Change a minute from the first to the last sample in arrival order; 0 within a millisecond."""
    ends = lambda c: (F.max_by(c, "arrival") - F.min_by(c, "arrival"))
    seconds = ends(F.col("t_us")) / 1e6
    return F.coalesce(F.try_divide(ends(F.col(y)), F.when(seconds > 0.001, seconds)) * 60, F.lit(0.0))


def summaries() -> list[Column]:
    """The aggregates of a window."""
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return [
        F.count("*").alias("sample_count"), rounded(F.avg("temperature"), 2).alias("mean_temperature"), rounded(std("temperature"), 3).alias("std_temperature"),
        rounded(endpoint_slope("temperature"), 4).alias("thermal_rise_rate"), rounded(F.avg("vibration"), 2).alias("mean_vibration"), rounded(F.max("vibration"), 2).alias("max_vibration"),
        rounded(endpoint_slope("vibration"), 4).alias("vibration_slope"), rounded(F.avg("pressure"), 2).alias("mean_pressure"), rounded(std("pressure"), 3).alias("std_pressure"),
        F.sum("is_anomaly").alias("anomalies_in_window"),
    ]


def window_summaries(rows: DataFrame, size: int, slide: int | None = None, least: int = 1, kind: str = "TUMBLING") -> DataFrame:
    """Summaries of ``size``-second windows every ``slide`` seconds that hold ``least`` samples or more.

    ``rows`` need event_time, arrival, t_us, is_anomaly (0 or 1) and the
    sensors. Batch windows that overlap are put together from panes
    (``pane_summaries``); a stream, which has one aggregation, copies rows.
    """
    if slide and size % slide == 0 and size > slide and not rows.isStreaming:
        return pane_summaries(rows, size, slide, least, kind)
    w = F.window("event_time", f"{size} seconds", f"{slide or size} seconds")
    out = rows.groupBy("asset_id", w.alias("w")).agg(*summaries()).where(F.col("sample_count") >= least)
    start, end = F.unix_micros("w.start"), F.unix_micros("w.end")
    return out.select(
        stable_id("win", F.substring("asset_id", 1, 4), (end / 1000000).cast("long"), F.col("asset_id"), F.lit(kind)).alias("window_id"),
        "asset_id", F.lit(kind).alias("window_type"), (start / 1e6).alias("window_start"), (end / 1e6).alias("window_end"), *[c for c in out.columns if c not in ("asset_id", "w")],
    )


def _panes() -> list[Column]:
    """What a pane keeps of its samples: counts, sums and squared deviations that can be added up, and its first and last sample."""
    end = F.struct("arrival", "t_us", "temperature", "vibration")
    sums = [F.count(c).alias(f"n_{c}") for c in ("temperature", "vibration", "pressure")] + [F.sum(c).alias(f"sum_{c}") for c in ("temperature", "vibration", "pressure")]
    spread = [(F.var_pop(c) * F.count(c)).alias(f"off_{c}") for c in ("temperature", "pressure")]
    return [F.count("*").alias("n"), *sums, *spread, F.max("vibration").alias("top"), F.sum("is_anomaly").alias("anomalies"), F.min_by(end, "arrival").alias("first"), F.max_by(end, "arrival").alias("last")]


def pane_summaries(rows: DataFrame, size: int, slide: int, least: int = 1, kind: str = "SLIDING") -> DataFrame:
    """As ``window_summaries``, for windows of ``size`` seconds, a multiple of ``slide``.

    Samples are added up once by asset and pane of ``slide`` seconds, before
    the shuffle where they are; only panes are copied to the windows they are
    part of. Deviations come from the panes' own and from how far their means
    are apart.
    """
    step = slide * 1_000_000
    panes = rows.groupBy("asset_id", F.expr(f"t_us div {step} - if(t_us % {step} < 0, 1, 0)").alias("pane")).agg(*_panes())
    copies = panes.withColumn("w", F.explode(F.sequence(F.col("pane") - (size // slide - 1), F.col("pane"))))

    def std(c: str) -> Column:
        n, mean = F.sum(f"n_{c}"), F.sum(f"sum_{c}") / F.sum(f"n_{c}")
        apart = F.sum(F.coalesce(F.col(f"sum_{c}") * F.col(f"sum_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0)), F.lit(0.0))) - n * mean * mean
        off = F.sum(f"off_{c}")
        # sums of squares differ in their last digits alone where all values are equal
        apart = F.when(apart > 1e-12 * n * mean * mean, apart).otherwise(0.0)
        return F.when(n > 1, F.sqrt(F.greatest(off + apart, F.lit(0.0)) / (n - 1))).otherwise(0.0)

    def slope(c: str) -> Column:
        first, last = F.min_by("first", "first.arrival"), F.max_by("last", "last.arrival")
        seconds = (last["t_us"] - first["t_us"]) / 1e6
        return F.coalesce(F.try_divide(last[c] - first[c], F.when(seconds > 0.001, seconds)) * 60, F.lit(0.0))

    mean = lambda c: F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}"))
    out = copies.groupBy("asset_id", "w").agg(
        F.sum("n").alias("sample_count"), rounded(mean("temperature"), 2).alias("mean_temperature"), rounded(std("temperature"), 3).alias("std_temperature"),
        rounded(slope("temperature"), 4).alias("thermal_rise_rate"), rounded(mean("vibration"), 2).alias("mean_vibration"), rounded(F.max("top"), 2).alias("max_vibration"),
        rounded(slope("vibration"), 4).alias("vibration_slope"), rounded(mean("pressure"), 2).alias("mean_pressure"), rounded(std("pressure"), 3).alias("std_pressure"),
        F.sum("anomalies").alias("anomalies_in_window"),
    ).where(F.col("sample_count") >= least)
    start = F.col("w") * slide
    return out.select(
        stable_id("win", F.substring("asset_id", 1, 4), start + size, F.col("asset_id"), F.lit(kind)).alias("window_id"),
        "asset_id", F.lit(kind).alias("window_type"), (start * 1.0).alias("window_start"), ((start + size) * 1.0).alias("window_end"), *[c for c in out.columns if c not in ("asset_id", "w")],
    )


def merged_windows(rows: DataFrame, size: int = 5, retention: int = 60) -> DataFrame:
    """Tumbling windows as a processor emits them that only looks when samples come.

    A sample in a later window closes everything since the last close, so one
    emission may span several empty windows; samples older than ``retention``
    seconds are gone by then, and the last window stays open. An emission needs
    the samples of its span, a range join on asset and block.
    """
    order = Window.partitionBy("asset_id").orderBy("arrival")
    step = size * 1_000_000
    ticks = rows.withColumn("end", F.expr(f"(t_us div {step}) * {step}"))
    high = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the first sample closes the one window before its own, which is empty of earlier samples
    closes = ticks.withColumn("before", high).where((F.col("end") > F.col("before")) | F.col("before").isNull())
    closes = closes.select("asset_id", F.coalesce("before", F.col("end") - step).alias("lo"), F.col("end").alias("hi"), F.col("t_us").alias("now"), F.col("arrival").alias("closed_by"))
    blocks = F.explode(F.sequence(F.expr(f"greatest(lo, now - {retention}000000) div {step}"), F.expr(f"greatest(hi - 1, now - {retention}000000) div {step}")))
    spans = closes.withColumn("block", blocks)
    samples = ticks.withColumn("block", F.expr(f"t_us div {step}"))
    joined = spans.join(samples, ["asset_id", "block"]).where(f"t_us >= lo AND t_us < hi AND t_us >= now - {retention}000000 AND arrival <= closed_by")
    out = joined.groupBy("asset_id", "lo", "hi").agg(*summaries())
    return out.select("asset_id", (F.col("lo") / 1e6).alias("window_start"), (F.col("hi") / 1e6).alias("window_end"), *[c for c in out.columns if c not in ("asset_id", "lo", "hi")])


def running_max_before(rows: DataFrame, value: str, order: str, block: int = 4096) -> DataFrame:
    """Adds ``high``: the largest ``value`` of all rows before this one in ``order``.

    One window over the whole table would put it into one task. Instead rows
    go by blocks of ``order``, and their maxima by blocks of blocks, so that
    the one window without a key holds a row for ``block`` squared of ``order``.
    """
    rows = rows.withColumns({"_block": F.expr(f"{order} div {block}"), "_group": F.expr(f"{order} div {block * block}")})
    before = lambda name, key, by: F.max(name).over((Window.partitionBy(key) if key else Window.partitionBy()).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("_group", "_block").agg(F.max(value).alias("_most"))
    groups = blocks.groupBy("_group").agg(F.max("_most").alias("_top")).select("_group", before("_top", None, "_group").alias("_higher"))
    blocks = blocks.withColumn("_high", before("_most", "_group", "_block")).join(groups, "_group").select("_block", F.greatest("_high", "_higher").alias("_high"))
    return rows.withColumn("_own", before(value, "_block", order)).join(blocks, "_block").withColumn("high", F.greatest("_own", "_high")).drop("_block", "_group", "_own", "_high")


def lateness(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``watermark`` (after the row) and ``lateness`` (against the watermark before it)."""
    delay, allowed = int(t.watermark_delay * 1e6), int(t.allowed_lateness * 1e6)
    rows = running_max_before(rows, "t_us", "arrival")
    mark = F.col("high") - delay
    kind = F.when(mark.isNull() | (F.col("t_us") >= mark), "ON_TIME").when(F.col("t_us") >= mark - allowed, "LATE_ACCEPTED").otherwise("EXCESSIVELY_LATE")
    return rows.withColumns({"watermark": (F.greatest("high", "t_us") - delay) / 1e6, "lateness": kind}).drop("high")


def nearest_rank(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Element ``int(n * share)`` of the sorted values for each share, and their mean.

    Ranks come from counts of distinct values, summed within blocks of values and over blocks, so no task sorts them all.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, "x", ["n"]).withColumn("upto", F.col("before_n") + F.col("n"))
    total = counts.agg(F.sum("n").alias("total"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    picked = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * F.lit(s)), F.col("x"))).alias(f"p{round(s * 100)}") for s in shares]
    return ranked.crossJoin(F.broadcast(total)).groupBy("total", "mean").agg(*picked).select(F.col("total").alias("n"), rounded(F.col("mean"), 6).alias("mean"), *[f"p{round(s * 100)}" for s in shares])


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row of percentiles ``p50, ...``, between neighbours in proportion; ranks as in ``nearest_rank``. Null without values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, "x", ["n"]).withColumn("upto", F.col("before_n") + F.col("n"))
    total = counts.agg(F.sum("n").alias("total"))
    place = lambda s: (F.col("total") - 1) * F.lit(s)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    between = lambda s: at(F.floor(place(s))) + (at(F.ceil(place(s))) - at(F.floor(place(s)))) * F.max(place(s) - F.floor(place(s)))
    return ranked.crossJoin(F.broadcast(total)).agg(*[between(s).alias(f"p{round(s * 100)}") for s in shares])


def stream_metrics(rows: DataFrame) -> DataFrame:
    """One row on a stream's progress.

    ``rows`` of ``lateness`` need latency_ms, the number of anomalies, and
    whether an event was alerted on or quarantined. Processed events are those
    neither quarantined nor excessively late; they alone have a latency, of
    0.01 ms at least. Throughput is by seconds from the first to the last event.
    """
    done = ~F.col("quarantined") & (F.col("lateness") != "EXCESSIVELY_LATE")
    latency = percentiles(rows.where(done).withColumn("latency_ms", F.greatest("latency_ms", F.lit(0.01))), "latency_ms")
    seconds = F.greatest((F.max("t_us") - F.min("t_us")) / 1e6, F.lit(0.001))
    counts = rows.agg(
        F.count("*").alias("events_ingested"), F.count_if(done).alias("events_processed"), F.count_if(F.col("lateness") == "LATE_ACCEPTED").alias("events_late"),
        F.count_if(F.col("lateness") == "EXCESSIVELY_LATE").alias("events_excessively_late"), F.count_if("quarantined").alias("events_quarantined"), F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies_detected"),
        F.count_if("alerted").alias("alerts_emitted"), F.count_distinct("asset_id").alias("active_assets_count"), rounded(F.max("watermark"), 6).alias("current_watermark"),
        rounded(F.max("t_us") / 1e6 - F.max("watermark"), 6).alias("watermark_lag_sec"), rounded(F.count_if(done) / seconds, 2).alias("throughput_events_per_sec"),
    )
    return counts.crossJoin(latency.select(*[rounded(F.coalesce(p, F.lit(0.0)), 3).alias(f"processing_latency_{p}_ms") for p in latency.columns]))  # a row each
