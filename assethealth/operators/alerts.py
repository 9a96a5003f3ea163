"""Health states with hysteresis and deduplicated alerts.

Both depend on what went before, sample by sample, so they are one fold in
time order. ``advance`` is that fold over plain values, as the streaming query
takes samples. The batch query gives the same: health states by composing the
rows' steps, alerts by going through the rows that may report something.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from assethealth.config import DEFAULTS, SEVERITIES, STATES
from assethealth.functions.columns import stable_id, supporting_features, trigger_values
from assethealth.functions.health import streaming_priority
from assethealth.operators.features import dealt
from assethealth.sources.scratch import kept, scratch

# Next state (0 healthy to 3 critical) by score band and state; bands are
# [.40,.50) [.50,.65) [.65,.72) [.72,.85) [.85,.90) [.90,1]
BANDS = (0.50, 0.65, 0.72, 0.85, 0.90)
NEXT = ((2, 2, 2, 3), (2, 2, 2, 2), (1, 1, 2, 2), (1, 1, 1, 2), (0, 1, 1, 2), (0, 0, 1, 2))


class State(NamedTuple):
    health: int = 0
    alert_time: float = 0.0
    alert_severity: int = -1


class Step(NamedTuple):
    health: int
    previous: int
    recovery: bool
    severity: int
    #: 0 nothing to report, 1 suppressed, 2 emitted
    outcome: int


def advance(s: State, time: float, score: float, critical: bool, found: int, worst: int) -> tuple[State, Step]:
    """One sample on: ``critical`` if a level 1 rule says so, ``found`` anomalies, the gravest of severity ``worst``."""
    band = sum(score >= b for b in BANDS)
    health = 3 if critical or score < 0.40 else NEXT[band][s.health]
    recovery = health < s.health
    severity = max(health, worst)
    if health == 0 and not found and not recovery:
        return s._replace(health=health), Step(health, s.health, recovery, severity, 0)
    due = time - s.alert_time >= DEFAULTS.cooldown_seconds and (found > 0 or health > 0)
    emit = health != s.health or (s.alert_severity >= 0 and severity > s.alert_severity) or due
    step = Step(health, s.health, recovery, severity, 2 if emit else 1)
    return (State(health, time, severity) if emit else s._replace(health=health)), step


#: Rows of an asset that one task goes through; a longer history is cut.
CHUNK = 1_000_000
FOLDED = {"health_rank": "int", "previous_rank": "int", "is_recovery": "boolean", "severity_rank": "int", "outcome": "int", "after": "int", "before": "int"}
#: The step that leaves all four states as they are.
SAME = sum(s << 2 * s for s in range(4))


def fold_inputs() -> dict[str, Column]:
    """What the fold reads of a row's anomalies."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)])
    return {
        "critical": F.exists("anomalies", lambda a: (a["level"] == 1) & (a["severity"] == "CRITICAL")),
        "found": F.size("anomalies"),
        "worst": F.coalesce(F.array_max(F.transform("anomalies", lambda a: rank[a["severity"]])), F.lit(0)),
    }


def step_code() -> Column:
    """A row as a function on the four health states: the next state of each, two bits a state."""
    whole = lambda after: F.lit(sum(h << 2 * s for s, h in enumerate(after)))
    code = F.when(F.col("critical") | (F.col("health_score") < 0.40), whole((3, 3, 3, 3)))
    for bound, after in zip(BANDS, NEXT, strict=False):
        code = code.when(F.col("health_score") < bound, whole(after))
    return code.otherwise(whole(NEXT[-1]))


def composed(steps: np.ndarray, starts: np.ndarray, carried: int = SAME) -> np.ndarray:
    """Each row's step after those before it in its run: functions on four states, in ``log n`` whole-array steps.

    ``starts`` has where runs begin, 0 among them; ``carried`` is what comes
    before the first run's rows.
    """
    f = ((steps[:, None] >> 2 * np.arange(4)) & 3).astype(np.int8)
    place = np.arange(len(f)) - np.repeat(starts, np.diff(np.append(starts, len(f))))
    reach = 1
    while reach <= place.max(initial=0):
        rows = np.flatnonzero(place >= reach)
        f[rows] = np.take_along_axis(f[rows], f[rows - reach], 1)
        reach *= 2
    end = starts[1] if len(starts) > 1 else len(f)
    f[:end] = f[:end, (carried >> 2 * np.arange(4)) & 3]
    return (f.astype(np.int32) << 2 * np.arange(4, dtype=np.int32)).sum(1, dtype=np.int32)


def _runs(batch: pa.RecordBatch, keys: tuple[str, ...], last: tuple | None) -> tuple[np.ndarray, bool, tuple]:
    """Where runs of equal keys begin in a batch, whether the first goes on from ``last``, and the last run's keys."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    ends = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
    return np.flatnonzero(change), ends[0] == last, ends[1]


def alert_outcomes(times: np.ndarray, severities: np.ndarray, active: np.ndarray, moved: np.ndarray, state: State) -> tuple[list[int], State]:
    """Outcomes (1 suppressed, 2 emitted) of the rows of one run that may report something, and the state after them."""
    out = []
    for time, severity, on, change in zip(times.tolist(), severities.tolist(), active.tolist(), moved.tolist(), strict=True):
        emit = change or (state.alert_severity >= 0 and severity > state.alert_severity) or (on and time - state.alert_time >= DEFAULTS.cooldown_seconds)
        out.append(2 if emit else 1)
        state = state._replace(alert_time=time, alert_severity=severity) if emit else state
    return out, state


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def folded(rows: DataFrame, by: str = "asset_id", chunk: int = CHUNK, together: bool = False) -> DataFrame:
    """``rows`` with the fold's columns.

    Rows are dealt by asset and sorted within tasks, and pass through in Arrow
    batches; rows that ``with_health`` gives have each asset in one task and
    in order (``together``), and stay where they are. Health states come from the rows' steps, composed batch by batch
    as functions on four states; only rows that may report something are gone
    through one by one. An asset with more than ``chunk`` rows is cut into
    chunks that are dealt apart (``_of_long_assets``).
    """
    rows = rows.withColumns(fold_inputs()).withColumn("step", step_code())
    longest, n = (x or 0 for x in rows.groupBy(by).count().agg(F.max("count"), F.sum("count")).first())
    if longest <= chunk:
        whole = rows if together else dealt(rows, n, by)
        return _passed(whole.sortWithinPartitions(by, "t_us", "arrival").withColumn("chunk", F.lit(0)), by).drop("step", "chunk", "after", "before")
    place = F.row_number().over(Window.partitionBy(by).orderBy("t_us", "arrival")) - 1
    numbered = rows.withColumn("row", place).withColumn("chunk", F.expr(f"row div {chunk}").cast("int"))
    numbered = numbered.repartition(by, "chunk").sortWithinPartitions(by, "chunk", "t_us", "arrival")
    table = kept(_passed(numbered, by), scratch(rows.sparkSession, "chunks"))
    long = table.where(F.col("row") == chunk).select(by)
    own = _of_long_assets(table.join(long, by, "left_semi"), by, chunk)
    return table.join(long, by, "left_anti").unionByName(own).drop("row", "step", "chunk", "after", "before")


def _passed(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (with ``step, chunk``; each chunk in one task, in order) through the fold, chunk by chunk: whole for first chunks, ``after`` and ``before`` for all."""
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in FOLDED.items()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, state = None, SAME, State()
        for b in batches:
            if not b.num_rows:
                continue
            starts, goes_on, last = _runs(b, (by, "chunk"), last)
            carried, state = (carried, state) if goes_on else (SAME, State())
            after = composed(_numbers(b, "step"), starts, carried)
            before = np.concatenate([[carried], after[:-1]]).astype(np.int32)
            before[starts[1:]] = SAME
            carried = int(after[-1])
            health, previous, found = after & 3, before & 3, _numbers(b, "found")
            severity, recovery = np.maximum(health, _numbers(b, "worst")), health < previous
            outcome = np.zeros(b.num_rows, np.int32)
            may = np.flatnonzero((health > 0) | (found > 0) | recovery)
            active, moved, times = (found > 0) | (health > 0), health != previous, _numbers(b, "t_us") / 1e6
            for k, part in enumerate(np.split(may, np.searchsorted(may, starts[1:]))):
                state = state if k == 0 else State()
                outcome[part], state = alert_outcomes(times[part], severity[part], active[part], moved[part], state)
            new = (health, previous, recovery, severity, outcome, after, before)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, arrow.field(k).type) for k, x in zip(FOLDED, new, strict=True))], names=arrow.names)

    return rows.mapInArrow(run, schema)


def _chunk_starts(table: DataFrame, by: str, chunk: int) -> DataFrame:
    """``by, chunk, start``: the health state before each chunk but the first, from the steps of all before it, one row a chunk."""
    ends = table.where(F.col("row") % chunk == chunk - 1).select(by, "chunk", "after")
    schema = T.StructType([*ends.schema, T.StructField("start", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, SAME
        for b in batches:
            if b.num_rows:
                starts, goes_on, last = _runs(b, (by,), last)
                whole = composed(_numbers(b, "after"), starts, carried if goes_on else SAME)
                carried = int(whole[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole & 3, pa.int32())], names=schema.names)

    sorted_ends = ends.repartition(by).sortWithinPartitions(by, "chunk")
    return sorted_ends.mapInArrow(run, schema).select(by, (F.col("chunk") + 1).alias("chunk"), "start")


def _of_long_assets(table: DataFrame, by: str, chunk: int) -> DataFrame:
    """Rows of assets of several chunks, with health states from each chunk's start and alerts by stretches between changes of state.

    A row at which the state changes always emits, whatever came before, so
    what lies from one such row to the next can be gone through apart from the
    rest. A chunk's first stretch goes on from the last change before it.
    """
    rows = table.join(kept(_chunk_starts(table, by, chunk), scratch(table.sparkSession, "starts")), [by, "chunk"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    health = {"health_rank": F.expr("shiftright(after, 2 * start) & 3"), "previous_rank": F.expr("shiftright(before, 2 * start) & 3")}
    rows = rows.withColumns(health).withColumns({"is_recovery": F.expr("health_rank < previous_rank"), "severity_rank": F.greatest("health_rank", "worst")}).drop("start", "outcome")
    rows = kept(rows, scratch(table.sparkSession, "long"))
    change = F.when(F.col("health_rank") != F.col("previous_rank"), F.col("row"))
    chunks = rows.groupBy(by, "chunk").agg(F.max(change).alias("changed"))
    earlier = F.max("changed").over(Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    may = rows.where("health_rank > 0 OR found > 0 OR is_recovery").select(by, "chunk", "row", "t_us", "severity_rank", ((F.col("found") > 0) | (F.col("health_rank") > 0)).alias("active"), change.isNotNull().alias("moved"), change.alias("changed"))
    own = F.max("changed").over(Window.partitionBy(by, "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    may = may.withColumn("own", own).join(chunks.select(by, "chunk", earlier.alias("earlier")), [by, "chunk"])
    may = may.select(by, "row", "t_us", "severity_rank", "active", "moved", F.coalesce("own", "earlier", F.lit(-1)).alias("stretch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, State()
        for b in batches:
            if not b.num_rows:
                continue
            starts, goes_on, last = _runs(b, (by, "stretch"), last)
            outcome = np.zeros(b.num_rows, np.int32)
            columns = _numbers(b, "t_us") / 1e6, _numbers(b, "severity_rank"), _numbers(b, "active"), _numbers(b, "moved")
            for k, (low, high) in enumerate(zip(starts, [*starts[1:], b.num_rows], strict=True)):
                state = state if k == 0 and goes_on else State()
                outcome[low:high], state = alert_outcomes(*(x[low:high] for x in columns), state)
            yield pa.RecordBatch.from_arrays([b.column(by), b.column("row"), pa.array(outcome, pa.int32())], names=[by, "row", "outcome"])

    kind = T.StructType([f for f in may.schema if f.name in (by, "row")] + [T.StructField("outcome", T.IntegerType())])
    outcomes = may.repartition(by, "stretch").sortWithinPartitions(by, "stretch", "row").mapInArrow(run, kind)
    return rows.join(outcomes, [by, "row"], "left").withColumn("outcome", F.coalesce("outcome", F.lit(0))).select(*table.columns)


def with_states(rows: DataFrame, by: str = "asset_id", chunk: int = CHUNK, together: bool = False) -> DataFrame:
    """``rows`` with health state, previous state, transition and recovery flags, severity and alert outcome; ``together`` as in ``folded``."""
    name = lambda rank, names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(rank) + 1)
    return folded(rows, by, chunk, together).withColumns({
        "health_state": name("health_rank", STATES), "previous_health_state": name("previous_rank", STATES), "severity": name("severity_rank", SEVERITIES),
        "is_state_transition": F.col("health_rank") != F.col("previous_rank"),
    }).drop("health_rank", "previous_rank", "severity_rank", "critical", "found", "worst")


def alert_events(states: DataFrame) -> DataFrame:
    """The alerts that are emitted, assembled."""
    rows = states.where("outcome = 2")
    codes = F.concat(F.transform("anomalies", lambda a: a["reason_code"]), F.col("degradation_reasons"))
    return rows.select(
        stable_id("alert", F.substring("asset_id", 1, 4), F.floor("timestamp"), F.col("arrival")).alias("alert_id"),
        "asset_id", "asset_type", F.timestamp_micros("t_us").alias("event_time"), "timestamp", "severity", "previous_health_state",
        F.col("health_state").alias("current_health_state"), "health_score", "is_state_transition", "is_recovery",
        F.transform("anomalies", lambda a: a["anomaly_type"]).alias("anomaly_types"), codes.alias("reason_codes"), trigger_values().alias("triggering_values"),
        supporting_features().alias("supporting_features"), streaming_priority(F.col("health_state")).alias("maintenance_priority"), F.lit("2.0.0").alias("schema_version"), "arrival",
    )


def alert_counters(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count("*").alias("evaluated"), F.count_if(F.col("outcome") == 2).alias("emitted"), F.count_if(F.col("outcome") == 1).alias("suppressed"),
        F.count_if("is_state_transition").alias("transitions"), F.count_if(F.col("is_recovery")).alias("recoveries"),
    )
