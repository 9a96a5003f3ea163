"""One stream from raw messages to routed outputs: processed samples, alerts, windows, quarantined and late messages.

Two stateful operators keyed by asset stand in one query, and between them the
column expressions of the batch queries. ``Intake`` judges messages in order of
arrival (repeats among valid ones, sequence, lateness) and keeps the frame that
rolling statistics are worked out from. ``Diagnosis`` keeps fault count, health
state and last alert, and closes windows. Every output row has a ``kind``, and
one ``foreachBatch`` function routes each kind to its own table, once a batch.

State is typed variables in RocksDB, changed in place, each with a time to live
since it was last written, so an idle asset's state goes by itself; the
``statestore`` source reads what a checkpoint holds (``state_of``). Messages
are taken one by one in order of arrival, so results do not depend on how the
source cuts micro-batches; its bound on a micro-batch bounds a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pandas as pd
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import MapState

from assethealth.config import DEFAULTS, SEVERITIES, STATES, Thresholds
from assethealth.functions.anomaly import anomalies
from assethealth.functions.columns import rounded, rounded_exactly, stable_id
from assethealth.functions.health import electrical_part, pressure_part, reasons, streaming_priority, thermal_part, vibration_part
from assethealth.operators.alerts import State, advance, fold_inputs
from assethealth.operators.features import SENSED, derived
from assethealth.streaming.jobs import judged, routed
from assethealth.streaming.progress import ProgressListener, observed

DAY_MS = 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a number that a message does not have.
NONE = -(1 << 62)
#: Messages without an asset have no state; they are dealt over so many keys.
NAMELESS = 64
#: Seconds of a window.
WINDOW = 5
#: Entries of a map state that are sent before their answers are read.
AHEAD = 64

SENSORS = ("temperature", "vibration", "pressure", "current", "voltage", "power")
MESSAGE = "asset_id string, event_id string, arrival long, t_us long, timestamp double, sequence long, moment string, broken string, raw string, " + ", ".join(f"{x} double" for x in SENSORS)
STATS = ["sample_count long", *[f"raw_{k}_{x} double" for x in SENSED for k in ("mean", "std")], "raw_max_vibration double", "raw_rise double", "raw_vib_slope double", *[f"baseline_{x} double" for x in SENSED]]
JUDGED = ["kind string", "asset_id string", "event_id string", "arrival long", "t_us long", "timestamp double", "violations string", "raw string", "lateness string", "out_of_order boolean", *[f"{x} double" for x in SENSORS], *STATS]
WINDOWED = [
    "window_start long", "window_end long", "samples long", "mean_temperature double", "std_temperature double", "thermal_rise double", "mean_vibration double", "max_vibration double",
    "vibration_slope double", "mean_pressure double", "std_pressure double", "anomalies long",
]
DECIDED = [
    "kind string", "asset_id string", "event_id string", "arrival long", "t_us long", "violations string", "raw string", "lateness string", "out_of_order boolean", "health_score double", "fault_count int", "health_state string",
    "previous_health_state string", "severity string", "is_recovery boolean", "outcome int", "found int", "anomaly_types array<string>", "reason_codes array<string>", *WINDOWED,
]


def _names(fields: list[str]) -> list[str]:
    return [f.split()[0] for f in fields]


def _packed(fields: list[str], numbers: list[str]) -> list[str]:
    """``fields`` with ``numbers`` in one array: operators give it, as each column of a frame costs an asset more than a number in a list."""
    return [*[f for f in fields if f not in numbers], "numbers array<double>"]


def _unpacked(rows: DataFrame, fields: list[str], numbers: list[str]) -> DataFrame:
    own = {f.split()[0]: F.col("numbers")[i].cast(f.split()[1]) for i, f in enumerate(numbers)}
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in _names(fields)])


MEASURED, CLOSED = [*[f"{x} double" for x in SENSORS], *STATS], WINDOWED
JUDGED_ROW, DECIDED_ROW = _packed(JUDGED, MEASURED), _packed(DECIDED, CLOSED)


def _frame(rows: list[dict], fields: list[str]) -> pd.DataFrame:
    """Rows as a frame of plain objects, so that whole numbers beside missing ones stay whole."""
    return pd.DataFrame({c: np.fromiter((r.get(c) for r in rows), object, len(rows)) for c in _names(fields)})


@lru_cache
def _row(names: tuple[str, ...]) -> type:
    return namedtuple("Row", names)


def _records(frames: Iterable[pd.DataFrame]) -> list:
    """Rows of frames in order of arrival, as named tuples of plain values."""
    rows = [_row(tuple(f.columns))(*x) for f in frames for x in zip(*(f[c].tolist() for c in f.columns), strict=True)]
    return sorted(rows, key=lambda m: (m.arrival, m.event_id))


def _numbers(rows: Iterable) -> list[list[float | None]]:
    """Rows of numbers as lists; what is not a number is missing."""
    return [[None if v is None or v != v else float(v) for v in row] for row in rows]


def _put_all(state: MapState, entries: list[tuple[tuple, tuple]]) -> None:
    """Put plain keys and values into a map state, as ``updateValue`` does one by one, which waits for an answer every time.

    Here ``AHEAD`` of them are sent before their answers are read. A state
    whose client is not Spark's own takes them one by one.
    """
    client = getattr(state, "_mapStateClient", None)
    api = getattr(client, "_stateful_processor_api_client", None)
    if not all(hasattr(api, x) for x in ("sockfile", "pickleSer", "_receive_proto_message")):
        for key, value in entries:
            state.updateValue(key, value)
        return
    from pyspark.sql.streaming.proto import StateMessage_pb2 as m

    dumps = api.pickleSer.dumps
    for at in range(0, len(entries), AHEAD):
        part = entries[at : at + AHEAD]
        for key, value in part:
            call = m.MapStateCall(stateName=state._stateName, updateValue=m.UpdateValue(userKey=dumps(key), value=dumps(value)))
            message = m.StateRequest(stateVariableRequest=m.StateVariableRequest(mapStateCall=call)).SerializeToString()
            api.sockfile.write(pack("!ii", 0, len(message)) + message)
        api.sockfile.flush()
        for status, error, *_ in [api._receive_proto_message() for _ in part]:
            if status:
                raise PySparkRuntimeError(f"a map state was not updated: {error}")


def _known(x: float) -> float | None:
    return None if x is None or np.isnan(x) else float(x)


def _mean_std(x: np.ndarray) -> tuple[float | None, float]:
    x = x[~np.isnan(x)]
    return (float(x.mean()) if len(x) else None), (float(x.std(ddof=1)) if len(x) > 1 else 0.0)


def _stats(frame: np.ndarray) -> list[float | None]:
    """Mean and deviation of each column, all at once where every value is known."""
    if np.isnan(frame).any():
        return [s for x in frame.T for s in _mean_std(x)]
    spread = frame.std(axis=0, ddof=1) if len(frame) > 1 else np.zeros(frame.shape[1])
    return np.column_stack((frame.mean(axis=0), spread)).ravel().tolist()


def _slope(seconds: np.ndarray, y: np.ndarray) -> float:
    """Least-squares change a minute; 0 for fewer than two samples or a millisecond."""
    if len(y) < 2 or seconds[-1] - seconds[0] <= 0.001:
        return 0.0
    known = ~np.isnan(y)
    x, y = seconds[known], y[known]
    x = x - x.mean() if len(x) else x
    return float(x @ (y - y.mean()) / (x @ x) * 60) if len(x) and x @ x > 0 else 0.0


def _groups(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, Callable, Callable]:
    """Sizes and starts of groups of rows that lie one after another, sums over each, and a group's values for each of its rows."""
    n = np.array(sizes)
    starts = np.cumsum(n) - n
    return n, starts, lambda x: np.add.reduceat(x, starts, axis=0), lambda x: np.repeat(x, n, axis=0)


def _spread(x: np.ndarray, n: np.ndarray, sums: Callable, each: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of groups, and how far each row is from its group's mean."""
    mean = sums(x) / n[:, None]
    apart = x - each(mean)
    return mean, np.sqrt(sums(apart * apart) / np.maximum(n - 1, 1)[:, None]), apart


def _statistics(times: list[list[int]], frames: list[list[tuple]]) -> list[list[float | None]]:
    """For each frame, oldest sample first: count, mean and deviation of each sensor, greatest vibration, slopes of temperature and vibration.

    All frames are worked out at once where every value is known.
    """
    x, t = np.array(list(chain.from_iterable(frames)), float), np.array(list(chain.from_iterable(times)))
    n, starts, sums, each = _groups([len(f) for f in frames])
    seconds = (t - each(t[starts + n - 1])) / 1e6
    if np.isnan(x).any():
        out = []
        for k, low in zip(n.tolist(), starts.tolist(), strict=True):
            frame, s = x[low : low + k], seconds[low : low + k]
            vibration = frame[~np.isnan(frame[:, 1]), 1]
            out.append([k, *_stats(frame), vibration.max() if len(vibration) else None, _slope(s, frame[:, 0]), _slope(s, frame[:, 1])])
        return out
    mean, spread, apart = _spread(x, n, sums, each)
    s = seconds - each(sums(seconds) / n)
    square = sums(s * s)
    sloped = (seconds[starts] < -0.001) & (square > 0)
    slopes = np.where(sloped[:, None], sums(s[:, None] * apart[:, :2]) / np.where(sloped, square, 1)[:, None] * 60, 0.0)
    return np.column_stack((n, np.stack((mean, spread), axis=2).reshape(len(n), -1), np.maximum.reduceat(x[:, 1], starts), slopes)).tolist()


def _change(seconds: float, first: float, last: float) -> float:
    """Change a minute between two samples, 0 within a millisecond or where one has no value."""
    return (last - first) / seconds * 60 if seconds > 0.001 and not np.isnan(first) and not np.isnan(last) else 0.0


def _summaries(panes: Iterable[list[tuple]]) -> list[list[float | None]]:
    """What windows report of their samples (``t_us, arrival, temperature, vibration, pressure, anomaly``, in order of arrival), from ``samples`` on.

    All windows are worked out at once where every value is known.
    """
    rows = np.array([[np.nan if v is None else v for v in r[2:5]] for r in chain.from_iterable(panes)], float)
    n, starts, sums, each = _groups([len(p) for p in panes])
    ends, anomalies = starts + n - 1, [sum(r[5] for r in p) for p in panes]
    seconds = np.array([p[-1][0] - p[0][0] for p in panes]) / 1e6
    if np.isnan(rows).any():
        out = []
        for low, high, s, a in zip(starts.tolist(), ends.tolist(), seconds.tolist(), anomalies, strict=True):
            x = rows[low : high + 1]
            (mt, st), (mv, _), (mp, sp) = (_mean_std(x[:, i]) for i in range(3))
            known = x[~np.isnan(x[:, 1]), 1]
            out.append([len(x), mt, st, _change(s, x[0, 0], x[-1, 0]), mv, known.max() if len(known) else None, _change(s, x[0, 1], x[-1, 1]), mp, sp, a])
        return out
    mean, spread, _ = _spread(rows, n, sums, each)
    apart = seconds > 0.001
    change = np.where(apart[:, None], (rows[ends] - rows[starts]) / np.where(apart, seconds, 1)[:, None] * 60, 0.0)
    return np.column_stack((n, mean[:, 0], spread[:, 0], change[:, 0], mean[:, 1], np.maximum.reduceat(rows[:, 1], starts), change[:, 1], mean[:, 2], spread[:, 2], anomalies)).tolist()


class Intake(StatefulProcessor):
    """Judges an asset's messages in order of arrival and gives each good sample the statistics of its frame.

    A message repeats another if a valid one before it had its event_id, or
    its time to the millisecond. Ids are told apart within an asset. A valid
    message counts as seen also if it is excessively late. Lateness is judged
    against the asset's own watermark before the message.
    """

    def __init__(self, t: Thresholds = DEFAULTS, ttl_ms: int = DAY_MS) -> None:
        self.t, self.ttl_ms = t, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "event_id string", "arrival long", self.ttl_ms)
        self.moments = handle.getMapState("moments", "moment string", "arrival long", self.ttl_ms)
        self.progress = handle.getValueState("progress", "newest long, sequence long", self.ttl_ms)
        self.first = handle.getValueState("first", ", ".join(f"{x} double" for x in SENSED), self.ttl_ms)
        self.frame = handle.getListState("frame", "t_us long, " + ", ".join(f"{x} double" for x in SENSED), self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        t, batch = self.t, _records(rows)
        out = []
        if str(key[0]).startswith("?"):
            for m in batch:
                out.append({"kind": "quarantine", "asset_id": m.asset_id, "event_id": m.event_id, "arrival": m.arrival, "violations": m.broken, "raw": m.raw, "out_of_order": False})
            yield _frame(out, JUDGED_ROW)
            return
        known = self.progress.exists()  # written after all else, so without it there is no other state, and seen ids and times are those of this call
        newest, sequence = self.progress.get() if known else (NONE, -1)
        ids, moments = {}, {}
        first = list(self.first.get()) if known and self.first.exists() else [None] * len(SENSED)
        kept = sorted(self.frame.get(), key=lambda x: x[0]) if known and self.frame.exists() else []
        times, values = [x[0] for x in kept], [x[1:] for x in kept]
        delay, allowed = int(t.watermark_delay * 1e6), int(t.allowed_lateness * 1e6)
        samples, spans, frames, firsts = [], [], [], []
        for m in batch:
            row = {"asset_id": m.asset_id, "event_id": m.event_id, "arrival": m.arrival, "t_us": m.t_us, "timestamp": m.timestamp, "out_of_order": m.sequence != NONE and m.sequence <= sequence}
            looked_at = (("DQ-009", ids, self.ids, m.event_id), ("DQ-010", moments, self.moments, m.moment))
            twice = [rule for rule, now, before, own in looked_at if own and (own in now or (known and before.containsKey((own,))))]
            broken = ",".join(filter(None, [m.broken, *twice]))
            if broken:
                out.append({"kind": "quarantine", **row, "violations": broken, "raw": m.raw})
                continue
            for _, now, _, own in looked_at:
                if own:
                    now[own] = int(m.arrival)
            sequence = max(sequence, int(m.sequence))
            row["lateness"] = "ON_TIME" if newest == NONE or m.t_us >= newest - delay else "LATE_ACCEPTED" if m.t_us >= newest - delay - allowed else "EXCESSIVELY_LATE"
            newest = max(newest, int(m.t_us))
            if row["lateness"] == "EXCESSIVELY_LATE":
                out.append({"kind": "late", **row})
                continue
            own = tuple(float(getattr(m, x)) for x in SENSED)
            at = bisect_right(times, m.t_us)
            times.insert(at, int(m.t_us))
            values.insert(at, own)
            first = [_known(x) if f is None else f for x, f in zip(own, first, strict=True)]
            low = max(bisect_left(times, m.t_us - t.frame_seconds * 1_000_000), at + 1 - t.buffer_samples)
            out.append({"kind": "sample", **row})
            samples.append((out[-1], [getattr(m, x) for x in SENSORS]))
            spans.append(times[low : at + 1])
            frames.append(values[low : at + 1])
            firsts.append(first)
        if samples:
            found = _statistics(spans, frames)
            numbers = _numbers([*sensed, *stats, *base] for (_, sensed), stats, base in zip(samples, found, firsts, strict=True))
            for (row, _), own in zip(samples, numbers, strict=True):
                row["numbers"] = own
        for state, now in ((self.ids, ids), (self.moments, moments)):
            _put_all(state, [((own,), (arrival,)) for own, arrival in now.items()])
        self.progress.update((newest, sequence))
        if times:
            self.first.update(tuple(first))
            low = bisect_left(times, newest - delay - allowed - t.frame_seconds * 1_000_000)  # what an accepted sample's frame can reach
            self.frame.put([(a, *map(_known, v)) for a, v in zip(times[low:], values[low:], strict=True)])
        yield _frame(out, JUDGED_ROW)

    def close(self) -> None:
        pass


class Diagnosis(StatefulProcessor):
    """Health states, alerts and windows of an asset's samples in order of arrival; other messages pass.

    A window closes when no sample that would be accepted can fall into it, so
    each is reported once, with its late samples.
    """

    def __init__(self, t: Thresholds = DEFAULTS, ttl_ms: int = DAY_MS) -> None:
        self.t, self.ttl_ms = t, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.health = handle.getValueState("health", "faults int, health int, alert_time double, alert_severity int", self.ttl_ms)
        self.newest = handle.getValueState("newest", "t_us long", self.ttl_ms)
        self.open = handle.getListState("open", "t_us long, arrival long, temperature double, vibration double, pressure double, anomaly int", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        batch = _records(rows)
        passing = ["kind", "asset_id", "event_id", "arrival", "t_us", "violations", "raw", "lateness", "out_of_order"]
        out = [{x: getattr(m, x) for x in passing} for m in batch if m.kind != "sample"]
        samples = [m for m in batch if m.kind == "sample"]
        if samples:
            faults, *last = self.health.get() if self.health.exists() else (0, *State())
            state, share = State(*last), self.t.weights[-1]
            for r in samples:
                faults = faults + 1 if r.found else max(0, faults - 1)
                whole = 1 - (r.penalty + share * min(1.0, faults / 8) + min(0.4, r.found * 0.15))
                score = float(np.floor(max(0.0, min(1.0, whole)) * 1000 + 0.500001) / 1000)
                state, step = advance(state, r.t_us / 1e6, score, bool(r.critical), int(r.found), int(r.worst))
                out.append({
                    "kind": "processed", "asset_id": r.asset_id, "event_id": r.event_id, "arrival": r.arrival, "t_us": r.t_us, "lateness": r.lateness, "out_of_order": r.out_of_order, "health_score": score, "fault_count": faults,
                    "health_state": STATES[step.health], "previous_health_state": STATES[step.previous], "severity": SEVERITIES[step.severity], "is_recovery": step.recovery, "outcome": step.outcome, "found": r.found,
                    "anomaly_types": r.anomaly_types, "reason_codes": r.reason_codes,
                })
            self.health.update((int(faults), *state))
            out += self._closed(key[0], samples)
        yield _frame(out, DECIDED_ROW)

    def _closed(self, asset_id: str, samples: list) -> list[dict]:
        own = list(self.open.get()) if self.open.exists() else []
        own += [(int(r.t_us), int(r.arrival), r.temperature, r.vibration, r.pressure, int(r.found > 0)) for r in samples]
        newest = max(max(int(r.t_us) for r in samples), self.newest.get()[0] if self.newest.exists() else NONE)
        self.newest.update((newest,))
        size, out = WINDOW * 1_000_000, []
        done = (newest - int((self.t.watermark_delay + self.t.allowed_lateness) * 1e6)) // size * size
        panes: dict[int, list[tuple]] = {}
        for x in own:
            if x[0] < done:
                panes.setdefault(x[0] // size * size, []).append(x)
        if panes:
            starts, whole = zip(*sorted((k, sorted(x, key=lambda r: r[1])) for k, x in panes.items()), strict=True)
            for start, rows, values in zip(starts, whole, _numbers(_summaries(whole)), strict=True):
                out.append({"kind": "window", "asset_id": asset_id, "arrival": rows[-1][1], "t_us": start + size, "numbers": [float(start), float(start + size), *values]})
        self.open.put([(a, b, _known(c), _known(d), _known(e), f) for a, b, c, d, e, f in own if a >= done])
        return out

    def close(self) -> None:
        pass


def messages(raw: DataFrame) -> DataFrame:
    """``MESSAGE`` columns and ``key`` of raw messages (``raw, arrival``): fields, and the rules on single messages that are broken."""
    rows = judged(raw)
    known = F.when(F.col("k_event_id") == "STRING", F.col("event_id"))
    moment = F.when((F.col("timestamp") != 0) & (F.col("asset_id") != ""), rounded_exactly(F.col("timestamp"), 3).cast("string"))
    key = F.coalesce(F.nullif("asset_id", F.lit("")), F.concat(F.lit("?"), F.pmod(F.xxhash64("arrival"), F.lit(NAMELESS)).cast("string")))
    own = {
        "event_id": F.coalesce(known, F.lit("")), "t_us": F.coalesce(F.round(F.col("timestamp") * 1e6).cast("long"), F.lit(NONE)), "sequence": F.coalesce("sequence_number", F.lit(NONE)),
        "moment": F.coalesce(moment, F.lit("")), "broken": F.array_join("violations", ","),
    }
    return rows.withColumns(own).withColumn("key", key).select("key", *[x.split()[0] for x in MESSAGE.split(", ")])


def intake(raw: DataFrame, t: Thresholds = DEFAULTS, ttl_ms: int = DAY_MS) -> DataFrame:
    """A stream of judged messages: samples with statistics, quarantined and excessively late ones."""
    return _unpacked(messages(raw).groupBy("key").transformWithStateInPandas(Intake(t, ttl_ms), ", ".join(JUDGED_ROW), "Append", "ProcessingTime"), JUDGED, MEASURED)


def asset_stream(raw: DataFrame, t: Thresholds = DEFAULTS, ttl_ms: int = DAY_MS) -> DataFrame:
    """All outputs of a stream of raw messages as rows of a ``kind``: processed, quarantine, late, window; alerts are processed rows of outcome 2."""
    a, b, c, d, _ = t.weights
    rows = derived(intake(raw, t, ttl_ms)).withColumn("anomalies", anomalies(t)).withColumns(fold_inputs())
    rows = rows.select(
        F.coalesce("asset_id", F.concat(F.lit("?"), F.pmod(F.xxhash64("arrival"), F.lit(NAMELESS)).cast("string"))).alias("key"), "kind", "asset_id", "event_id", "arrival", "t_us", "violations", "raw", "lateness", "out_of_order",
        "temperature", "vibration", "pressure", "critical", "found", "worst", F.transform("anomalies", lambda x: x["anomaly_type"]).alias("anomaly_types"),
        F.concat(F.transform("anomalies", lambda x: x["reason_code"]), reasons(t)).alias("reason_codes"),
        (a * vibration_part(t) + b * thermal_part(t) + c * pressure_part() + d * electrical_part()).alias("penalty"),
    )
    return _unpacked(rows.groupBy("key").transformWithStateInPandas(Diagnosis(t, ttl_ms), ", ".join(DECIDED_ROW), "Append", "ProcessingTime"), DECIDED, CLOSED)


def _processed(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'processed'").select(
        "event_id", "asset_id", F.timestamp_micros("t_us").alias("event_time"), "health_score", "health_state", F.col("found").alias("anomalies_count"), (F.col("outcome") == 2).alias("alert_emitted"), "lateness", "out_of_order",
    )


def _alerts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'processed' AND outcome = 2").select(
        stable_id("alert", F.substring("asset_id", 1, 4), F.expr("t_us div 1000000"), F.col("event_id")).alias("alert_id"), "event_id", "asset_id", F.timestamp_micros("t_us").alias("event_time"), "severity", "previous_health_state",
        F.col("health_state").alias("current_health_state"), "health_score", (F.col("health_state") != F.col("previous_health_state")).alias("is_state_transition"), "is_recovery", "anomaly_types", "reason_codes",
        streaming_priority(F.col("health_state")).alias("maintenance_priority"),
    )


def _windows(rows: DataFrame) -> DataFrame:
    c, two, three = F.col, lambda x: rounded(F.col(x), 2).alias(x), lambda x: rounded(F.col(x), 3).alias(x)
    return rows.where("kind = 'window'").select(
        stable_id("win", F.substring("asset_id", 1, 4), F.expr("window_end div 1000000"), c("asset_id"), F.lit("TUMBLING")).alias("window_id"), "asset_id", (c("window_start") / 1e6).alias("window_start"),
        (c("window_end") / 1e6).alias("window_end"), c("samples").alias("sample_count"), two("mean_temperature"), three("std_temperature"), rounded(c("thermal_rise"), 4).alias("thermal_rise_rate"), two("mean_vibration"),
        two("max_vibration"), rounded(c("vibration_slope"), 4).alias("vibration_slope"), two("mean_pressure"), three("std_pressure"), c("anomalies").alias("anomalies_in_window"),
    )


def _refused(kind: str) -> Callable[[DataFrame], DataFrame]:
    unknown: Callable[[str], Column] = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("UNKNOWN")).alias(x)
    return lambda rows: rows.where(F.col("kind") == kind).select(unknown("event_id"), unknown("asset_id"), "arrival", "violations", "raw", "lateness", "out_of_order")


OUTPUTS: dict[str, Callable[[DataFrame], DataFrame]] = {"processed": _processed, "alerts": _alerts, "windows": _windows, "quarantine": _refused("quarantine"), "late": _refused("late")}


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Start a stream that keeps its state in RocksDB; with ``drain`` it takes what is there and ends.

    A drain runs no batches without data: operators on processing time ask for
    another one for ever. A query that goes on runs them, as expiry needs.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if drain else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer).start()  # the query takes the session's settings with it
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(raw: DataFrame, paths: dict[str, str], checkpoint: str, t: Thresholds = DEFAULTS, ttl_ms: int = DAY_MS) -> list[tuple]:
    """Run ``asset_stream`` over what its source has, from where ``checkpoint`` left off, each output to its path of ``paths``.

    Gives the rows that its micro-batches report (``progress.REPORT``).
    """
    spark, listener = raw.sparkSession, ProgressListener()
    spark.streams.addListener(listener)
    try:
        query = started(observed(asset_stream(raw, t, ttl_ms)), routed({k: OUTPUTS[k] for k in paths}, paths), checkpoint, drain=True)
        query.awaitTermination()
        listener.ended.wait(30)  # reports come on another thread, in order
    finally:
        spark.streams.removeListener(listener)
    return listener.rows


#: Operators of ``asset_stream`` as the checkpoint numbers them.
OPERATORS = {"diagnosis": 0, "intake": 1}


def state_of(spark: SparkSession, checkpoint: str, operator: str, variable: str) -> DataFrame:
    """What a checkpoint of ``asset_stream`` holds of a state variable, a row a key (and element), with its time of expiry."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("operatorId", OPERATORS[operator]).option("stateVarName", variable)
    return rows.option("flattenCollectionTypes", "true").load()
