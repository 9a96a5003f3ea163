"""Structured Streaming queries that share their expressions with the batch ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assethealth.config import DEFAULTS, SEVERITIES, STATES, Thresholds
from assethealth.operators import quality, tables, windows
from assethealth.operators.alerts import State, advance

DAY_MS = 24 * 3600 * 1000


def kafka_events(spark: SparkSession, servers: str, topic: str, most_offsets: int = 100_000, start: str = "earliest") -> DataFrame:
    """Raw JSON messages of a topic with their place, as ``raw, arrival, key, topic, partition, offset``; needs Spark's Kafka package."""
    rows = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "maxOffsetsPerTrigger": most_offsets}).load()
    return rows.select(F.col("value").cast("string").alias("raw"), F.col("offset").alias("arrival"), F.col("key").cast("string").alias("key"), "topic", "partition", "offset")


def file_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Raw JSON messages out of Parquet files of ``raw, arrival`` as they come."""
    return spark.readStream.schema("raw string, arrival long").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keyed(rows: DataFrame, key: str = "asset_id") -> DataFrame:
    """Rows as messages: the key as text, and the whole row as JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def kafka_sink(rows: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "asset_id") -> DataStreamWriter:
    """Rows as JSON, keyed by asset."""
    return keyed(rows, key).writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint})


def judged(raw: DataFrame) -> DataFrame:
    """Each message with its fields, event time and the violations of rules on single events."""
    rows, broken, some = quality.with_rules(quality.parsed(raw))
    codes = quality.listed([F.when(m.isNotNull(), F.lit(k)) for k, m in broken.items()], some, "array<string>")
    rows = rows.withColumns({"violations": codes, "event_time": F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))})
    return rows.drop("v", *[f"rule {k}" for k in broken])


def clean(judged_rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Valid events, each event_id once within the watermark."""
    rows = judged_rows.where(F.size("violations") == 0)
    delay = t.watermark_delay + t.allowed_lateness
    return rows.withWatermark("event_time", f"{delay:g} seconds").dropDuplicatesWithinWatermark(["event_id"])


def window_stream(events: DataFrame, size: int = 5, slide: int | None = None, least: int = 1, kind: str = "TUMBLING") -> DataFrame:
    """Window summaries of watermarked events, as they close; the same aggregates as in batch."""
    rows = events.withColumns({"t_us": F.unix_micros("event_time"), "is_anomaly": F.lit(0)})
    return windows.window_summaries(rows, size, slide, least, kind)


def routed(outputs: dict[str, Callable[[DataFrame], DataFrame]], paths: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes several outputs of one batch, each once: a batch that comes again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, make in outputs.items():
            tables.append_once(make(batch), paths[name], batch_id)
        batch.unpersist()

    return write


STEP = "asset_id string, arrival long, health_state string, previous_health_state string, severity string, is_recovery boolean, outcome int"
KEPT = "health int, alert_time double, alert_severity int"


def state_stream(scored: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """Health states and alert outcomes of a stream of scored samples: the batch fold, with its state kept by asset.

    ``scored`` has asset_id, arrival, t_us, health_score, critical, found and
    worst. Samples of a batch are taken in time order. State is kept in the
    checkpoint, survives restarts, and goes when the watermark is ``ttl_ms``
    past an asset's last sample.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = State(*kept.get) if kept.exists else State()
        rows = pd.concat(list(batches))
        fields = [rows[x].to_numpy() for x in ("t_us", "arrival", "health_score", "critical", "found", "worst")]
        order, out = np.lexsort((fields[1], fields[0])), []  # a frame's own sort and rows cost more than the few samples of an asset
        for t_us, arrival, score, critical, found, worst in zip(*(x[order].tolist() for x in fields), strict=True):
            state, step = advance(state, t_us / 1e6, score, bool(critical), int(found), int(worst))
            out.append((key[0], arrival, STATES[step.health], STATES[step.previous], SEVERITIES[step.severity], step.recovery, step.outcome))
        kept.update(tuple(state))
        kept.setTimeoutTimestamp(max(int(fields[0].max() // 1000) + ttl_ms, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEP.split(", ")])

    timed = scored.withColumn("event_time", F.timestamp_micros("t_us")).withWatermark("event_time", "35 seconds")
    return timed.groupBy("asset_id").applyInPandasWithState(run, STEP, KEPT, "append", GroupStateTimeout.EventTimeTimeout)
