"""Data quality of raw JSON telemetry: thirteen rules, contracts, quarantine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.config import ASSET_TYPES, MODES
from assethealth.functions.columns import rounded_exactly
from assethealth.operators.graph import components
from assethealth.schemas import NUMERIC, REQUIRED
from assethealth.sources.scratch import kept, scratch

EARLIEST, LATEST = 1577836800.0, 2051222400.0
DELAYED_SECONDS = 30


def parsed(raw: DataFrame) -> DataFrame:
    """``raw(raw, arrival)`` with the fields of each event.

    ``v`` is the parsed JSON; ``keys`` its keys, null unless it is an object;
    ``k_<field>`` the type of a field (null where absent), and the field itself
    as a number where it is one. All fields come out of the object at once.
    """
    kinds, texts = (*NUMERIC, "event_id", "sequence_number"), ("event_id", "asset_id", "asset_type", "operating_mode", "schema_version")
    fields = [*NUMERIC, *texts, "sequence_number"]
    rows = raw.withColumn("v", F.try_parse_json("raw"))
    rows = rows.withColumn("keys", F.map_keys(F.try_variant_get("v", "$", "map<string, variant>")))
    rows = rows.withColumn("own", F.try_variant_get("v", "$", f"struct<{', '.join(f'{f}: variant' for f in fields)}>"))
    get = lambda f, kind: F.try_variant_get(F.col("own")[f], "$", kind)
    rows = rows.withColumns({f"k_{f}": F.schema_of_variant(F.col("own")[f]) for f in kinds})
    numeric = lambda f: F.col(f"k_{f}").isin("BIGINT", "DOUBLE", "FLOAT") | F.col(f"k_{f}").startswith("DECIMAL")
    values = {f: F.when(numeric(f), get(f, "double")) for f in NUMERIC} | {f: get(f, "string") for f in texts}
    values |= {"sequence_number": F.when(F.col("k_sequence_number") == "BIGINT", get("sequence_number", "bigint"))}
    return rows.withColumns(values).drop("own")


def listed(entries: list[Column], some: Column, kind: str) -> Column:
    """The entries that are not null, as an array of ``kind``; where ``some`` is false there are none, and none is looked at."""
    none = F.array().cast(kind)
    return F.when(some, F.concat(*[F.when(x.isNotNull(), F.array(x)).otherwise(none) for x in entries])).otherwise(none)


def _is_number(field: str) -> Column:
    return F.col(field).isNotNull()


def row_rules() -> dict[str, Column]:
    """Message of each rule that looks at one event alone, null where it holds; malformed events get none of these."""
    c = F.col
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), "keys"))
    present = lambda f: c(f"k_{f}").isNotNull()
    whole = reduce(and_, [present(f) if f in (*NUMERIC, "event_id", "sequence_number") else c(f).isNotNull() for f in REQUIRED])  # then no key needs a look
    bad_type = [F.when(present(f) & ~_is_number(f), F.concat(F.lit(f"{f} must be numeric, got "), F.lower(c(f"k_{f}")))) for f in NUMERIC]
    bad_type += [F.when(present("event_id") & ~F.coalesce(c("k_event_id") == "STRING", F.lit(False)), F.lit("event_id must be a string"))]
    bad_type += [F.when(present("sequence_number") & ~F.coalesce(c("k_sequence_number").isin("BIGINT", "BOOLEAN"), F.lit(False)), F.lit("sequence_number must be an integer"))]
    ts = c("timestamp")
    outside = lambda f, low, high: F.when((c(f) < low) | (c(f) > high), F.lit(f"{f} out of range [{low}, {high}]"))
    negative = lambda f: F.when(c(f) < 0, F.lit(f"{f} is negative"))
    return {
        "DQ-001": F.when(~whole & (F.size(missing) > 0), F.concat(F.lit("missing required fields: "), F.array_join(missing, ", "))),
        "DQ-002": F.coalesce(*bad_type),
        "DQ-003": F.when(ts.isNull(), F.lit("timestamp is not a number")).when(ts <= 0, F.lit("timestamp is not positive")).when(~ts.between(EARLIEST, LATEST), F.lit("timestamp out of range")),
        "DQ-004": F.when(~F.coalesce(c("operating_mode").isin(*MODES), F.lit(False)), F.concat(F.lit("unknown operating mode: "), F.coalesce("operating_mode", F.lit("none")))),
        "DQ-005": F.coalesce(*[F.when(F.isnan(f) | (F.abs(f) == float("inf")), F.lit(f"{f} is not finite")) for f in NUMERIC[1:]], outside("temperature", -50, 1500), outside("pressure", 0, 2000), outside("load", 0, 200)),
        "DQ-006": outside("rpm", 0, 50000),
        "DQ-007": negative("vibration"),
        "DQ-008": F.coalesce(negative("voltage"), negative("current"), negative("power")),
    }


#: Rounds in which the first events by id and by time are taken, before chains of repeats are followed one by one.
ROUNDS = 2


def first_come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The valid ones of events sorted by component and arrival: those whose id and time no valid one of their component has had."""
    now, ids, slots = None, set(), set()
    for b in batches:
        keep = []
        for label, own, slot in zip(*(b.column(c).to_pylist() for c in ("label", "id", "slot")), strict=True):
            if label != now:
                now, ids, slots = label, set(), set()
            valid = own not in ids and slot not in slots
            if valid:
                ids.add(own)
                slots.add(slot)
            keep.append(valid)
        yield b.filter(pa.array(keep, pa.bool_()))


def repeats(rows: DataFrame) -> DataFrame:
    """``arrival, again_id, again_time`` of the events that repeat an earlier valid one's id, or its asset and millisecond.

    ``rows`` of ``parsed`` need ``sound``: no rule on single events is broken.
    Of sound events, the first one of both its id and its asset and millisecond
    is valid, and the others of either are not; with all of these gone, the
    same holds of the rest. ``ROUNDS`` such rounds settle nearly all events,
    however common an id, since minima are taken before the shuffle. What is
    left are chains of events that share an id with one neighbour and a time
    with the other. They are gathered by component, and each component is gone
    through in order of arrival once, so the number of jobs does not depend on
    the length of chains. ``arrival`` tells events apart. Events in no group of
    two take no part at all.
    """
    folder = scratch(rows.sparkSession, "repeats")
    known = F.when(F.col("k_event_id") == "STRING", F.nullif("event_id", F.lit("")))
    moment = F.when((F.col("timestamp") != 0) & (F.col("asset_id") != ""), F.concat_ws("@", "asset_id", rounded_exactly(F.col("timestamp"), 3).cast("string")))
    events = kept(rows.where("keys IS NOT NULL").select("arrival", "sound", known.alias("id"), moment.alias("slot")), f"{folder}/events")
    common = lambda k: events.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n"), F.bool_or("sound").alias("some")).where("n > 1 AND some").select(k)
    shared = events.join(common("id"), "id", "left_semi").unionByName(events.join(common("slot"), "slot", "left_semi"))
    shared = kept(shared.dropDuplicates(["arrival"]), f"{folder}/shared")
    own = lambda k: F.coalesce(F.concat(F.lit("="), k), F.concat(F.lit("!"), F.col("arrival").cast("string"))).alias(k)
    left = shared.where("sound").select("arrival", own("id"), own("slot"))
    firsts = lambda rows, k: rows.groupBy(k).agg(F.min("arrival").alias("arrival"))
    valid = []
    for turn in range(ROUNDS):
        valid.append(kept(firsts(left, "id").join(firsts(left, "slot"), "arrival"), f"{folder}/valid-{turn}"))
        left = left.join(valid[-1].select("id"), "id", "left_anti").join(valid[-1].select("slot"), "slot", "left_anti").select("arrival", "id", "slot")
        left = kept(left, f"{folder}/left-{turn}")
    if not left.isEmpty():
        to_first = [left.join(firsts(left, k).select(k, F.col("arrival").alias("a")), k).where("a <> arrival").select("a", F.col("arrival").alias("b")) for k in ("id", "slot")]
        labels = components(to_first[0].union(to_first[1])).withColumnRenamed("node", "arrival")
        rest = left.join(labels, "arrival", "left").withColumn("label", F.coalesce("label", "arrival"))
        rest = rest.repartition("label").sortWithinPartitions("label", "arrival")
        valid.append(kept(rest.mapInArrow(first_come, rest.schema), f"{folder}/valid-rest"))
    seen = reduce(DataFrame.unionByName, [v.select("arrival", "id", "slot") for v in valid])
    at = lambda k: seen.where(F.col(k).startswith("=")).select(F.expr(f"substring({k}, 2)").alias(k), F.col("arrival").alias(f"{k}_at"))
    found = shared.join(at("id"), "id", "left").join(at("slot"), "slot", "left")
    again = lambda k: F.coalesce(F.col(f"{k}_at") < F.col("arrival"), F.lit(False))
    return found.select("arrival", again("id").alias("again_id"), again("slot").alias("again_time")).where("again_id OR again_time")


def with_rules(rows: DataFrame) -> tuple[DataFrame, dict[str, Column], Column]:
    """``parsed`` rows with a column for each rule on single events, those columns (null where it holds) by rule, and whether any is broken."""
    fits = F.col("keys").isNotNull()
    rules = {"DQ-011": F.when(~fits, F.lit("not a JSON object"))} | {k: F.when(fits, m) for k, m in row_rules().items()}
    rows = rows.withColumns({f"rule {k}": m for k, m in rules.items()})
    broken = {k: F.col(f"`rule {k}`") for k in rules}
    return rows, broken, F.coalesce(*broken.values()).isNotNull()


def judged_alone(raw: DataFrame) -> DataFrame:
    """``parsed`` events with ``found`` (what rules on single events say) and ``sound``, without the parsed JSON itself."""
    rows, broken, some = with_rules(parsed(raw))
    found = [F.when(m.isNotNull(), F.struct(F.lit(k).alias("rule"), m.alias("message"))) for k, m in broken.items()]
    rows = rows.withColumns({"found": listed(found, some, "array<struct<rule: string, message: string>>"), "sound": ~some})
    return rows.drop("v", *[f"rule {k}" for k in broken])


def validated(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Every raw event with ``violations`` (rule codes), ``messages``, ``is_valid``, ``is_delayed`` and ``is_out_of_order``.

    All rules are looked at; only a malformed event has its one violation. An
    event is a duplicate if an earlier valid one has its event_id, or its asset
    and time to the millisecond, in order of ``arrival``, which no two events
    share; an event that is itself rejected does not count as seen. ``now`` is
    the time that delays are measured against, in epoch seconds. Events are
    parsed once, into a table, when this is called, and repeats are worked out
    from it (``repeats``).
    """
    judged = kept(judged_alone(raw), scratch(raw.sparkSession, "judged"))
    fits = F.col("fits")
    rows = judged.withColumn("fits", F.col("keys").isNotNull()).drop("keys", *[k for k in judged.columns if k.startswith("k_")])  # what rules have read does not travel on
    rows = rows.join(repeats(judged), "arrival", "left")
    twice = F.filter(F.array(
        F.when(F.col("again_id"), F.struct(F.lit("DQ-009").alias("rule"), F.concat(F.lit("duplicate event_id: "), "event_id").alias("message"))),
        F.when(F.col("again_time"), F.struct(F.lit("DQ-010").alias("rule"), F.lit("duplicate asset and timestamp").alias("message"))),
    ), lambda x: x.isNotNull())
    rows = rows.withColumn("found", F.concat("found", twice)).withColumn("is_valid", F.size("found") == 0)
    one_asset = Window.partitionBy("asset_id", F.when(fits, F.lit(0)).otherwise(F.col("arrival")))
    earlier = F.max(F.when(F.col("is_valid"), F.col("sequence_number"))).over(one_asset.orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    clock = now if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
    return rows.withColumns({
        "violations": F.transform("found", lambda x: x["rule"]), "messages": F.transform("found", lambda x: x["message"]),
        "is_delayed": F.coalesce(fits & (clock - F.col("timestamp") > DELAYED_SECONDS), F.lit(False)),
        "is_out_of_order": F.coalesce(fits & (F.col("sequence_number") <= F.coalesce(earlier, F.lit(-1))), F.lit(False)),
    }).drop("found", "sound", "fits", "again_id", "again_time")


def quarantined(checked: DataFrame, run_id: str = "run") -> DataFrame:
    """Quarantine records of invalid events."""
    return checked.where("NOT is_valid").select(
        F.concat(F.lit("q-"), F.col("arrival").cast("string")).alias("quarantine_id"), F.lit(run_id).alias("run_id"), F.coalesce("event_id", F.lit("UNKNOWN")).alias("event_id"),
        F.coalesce("asset_id", F.lit("UNKNOWN")).alias("asset_id"), F.to_json("violations").alias("violated_rules"), F.to_json("messages").alias("reasons"), F.col("raw").alias("raw_payload"), "arrival",
    )


def quality_log(checked: DataFrame, run_id: str = "run") -> DataFrame:
    """One row for each violated rule of each event."""
    rows = checked.where("NOT is_valid").withColumn("details", F.concat_ws("; ", "messages"))
    return rows.select(F.lit(run_id).alias("run_id"), F.coalesce("event_id", F.lit("UNKNOWN")).alias("event_id"), F.coalesce("asset_id", F.lit("UNKNOWN")).alias("asset_id"), F.explode("violations").alias("rule_code"), F.lit("ERROR").alias("severity"), "details")


def violation_counts(checked: DataFrame) -> DataFrame:
    """Events for each violated rule, and valid events under ``VALID``."""
    codes = F.when(F.col("is_valid"), F.array(F.lit("VALID"))).otherwise(F.col("violations"))
    return checked.select(F.explode(codes).alias("rule_code")).groupBy("rule_code").agg(F.count("*").alias("n"))


#: Contract of telemetry: inclusive bounds by field.
BOUNDS = {
    "temperature": (-50, 1500), "vibration": (0, 500), "pressure": (0, 1000), "rpm": (0, 50000), "current": (0, 5000), "voltage": (0, 50000), "power": (0, 100000), "load": (0, 100),
}
ASSET_ID = "^(MOTOR|PUMP|COMPRESSOR|CONVEYOR|TURBINE)-[0-9]{3}$"
ALLOWED = (*REQUIRED, "event_time", "ingestion_time", "metadata", "schema_version")
MAINTENANCE_TYPES = ("PREVENTIVE", "CORRECTIVE", "INSPECTION", "EMERGENCY_REPAIR", "CALIBRATION")


def contract_breaches(rows: DataFrame) -> DataFrame:
    """``rows`` of ``parsed`` with ``breaches``: the telemetry contract's parts that do not hold, sorted."""
    c = F.col
    found = [F.when(~F.coalesce(c(f).between(lo, hi), F.lit(False)), F.lit(f)) for f, (lo, hi) in BOUNDS.items()]
    found += [
        F.when(~F.coalesce(c("asset_id").rlike(ASSET_ID), F.lit(False)), F.lit("asset_id")),
        F.when(~F.coalesce(c("asset_type").isin(*ASSET_TYPES), F.lit(False)), F.lit("asset_type")),
        F.when(~F.coalesce(c("operating_mode").isin(*MODES), F.lit(False)), F.lit("operating_mode")),
        F.when(~F.coalesce(c("sequence_number") >= 0, F.lit(False)), F.lit("sequence_number")),
        F.when(F.size(F.array_except("keys", F.array(*[F.lit(k) for k in ALLOWED]))) > 0, F.lit("additional")),
    ]
    rows = rows.withColumns({f"breach {k}": m for k, m in enumerate(found)})
    broken = [c(f"breach {k}") for k in range(len(found))]
    return rows.withColumn("breaches", F.array_sort(listed(broken, F.coalesce(*broken).isNotNull(), "array<string>"))).drop(*[f"breach {k}" for k in range(len(found))])


def maintenance_breaches(rows: DataFrame) -> DataFrame:
    """``breaches`` of maintenance records: required fields, type, cost and downtime."""
    c = F.col
    found = [F.when(c(f).isNull(), F.lit(f)) for f in ("maintenance_id", "asset_id", "performed_at", "technician_id", "description")]
    found += [
        F.when(~F.coalesce(c("maintenance_type").isin(*MAINTENANCE_TYPES), F.lit(False)), F.lit("maintenance_type")),
        F.when(c("cost_usd") < 0, F.lit("cost_usd")),
        F.when(c("downtime_hours") < 0, F.lit("downtime_hours")),
    ]
    return rows.withColumn("breaches", F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())))


def unregistered(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """Assets that send telemetry and are in no registry."""
    return samples.select("asset_id").distinct().join(registry.select("asset_id"), "asset_id", "left_anti")
