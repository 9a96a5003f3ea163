"""Telemetry as raw JSON text, some of it defective, for quality queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("timestamp", "temperature", "vibration", "pressure", "rpm", "current", "voltage", "power", "load")


#: Repeats come this much later than their samples, or later than all samples where those are more.
LATER = 1_000_000


def with_defects(samples: DataFrame) -> DataFrame:
    """``raw, arrival``: each sample as JSON; the remainder of arrival by 97 picks a defect, 101 and 103 repeats: of an id, of a time under a new id, and of that id at another time.

    No two events share an ``arrival``: repeats follow all samples, one kind after another.
    """
    last = samples.agg(F.max("arrival")).first()[0]
    step = max(LATER, 0 if last is None else last + 1)
    c, m = F.col, F.col("m")
    rows = samples.withColumn("seq", F.row_number().over(Window.partitionBy("asset_id").orderBy("arrival")) - 1)
    again, other = c("arrival") % 101 == 0, c("arrival") % 103 == 0
    copies = F.array_compact(F.array(F.lit(0), F.when(again, 1), F.when(other, 2), F.when(other, 3)))
    rows = rows.select("*", (c("arrival") % 97).alias("m"), F.explode(copies).alias("copy"))  # all from one window
    value = {f: c(f).cast("string") for f in FIELDS} | {"timestamp": (c("timestamp") + F.when(c("copy") == 3, 0.5).otherwise(0.0)).cast("string")}
    bad = {
        "voltage": {1: '"bad"', 7: "-1.0"}, "timestamp": {2: "-5"}, "temperature": {4: "2500.5", 11: "null"}, "rpm": {5: "60000"}, "vibration": {6: "-2.4"},
    }
    for f, cases in bad.items():
        for r, text in cases.items():
            value[f] = F.when(m == r, F.lit(text)).otherwise(value[f])
    mode = F.when(m == 3, "TURBO").otherwise(c("operating_mode"))
    sequence = F.when(m == 10, F.lit("0")).otherwise(c("seq").cast("string"))
    event_id = F.when(c("copy") > 1, F.concat("event_id", F.lit("b"))).otherwise(c("event_id"))
    pairs = [F.concat(F.lit(f'"{f}":'), v) for f, v in value.items()]
    pairs[4] = F.when(m == 0, F.lit(None)).otherwise(pairs[4])  # rpm goes missing
    names = [F.concat(F.lit(f'"{k}":"'), v, F.lit('"')) for k, v in (("event_id", event_id), ("asset_id", c("asset_id")), ("asset_type", c("asset_type")), ("operating_mode", mode), ("event_time", F.lit("2024-01-01T00:00:00Z")), ("schema_version", F.lit("1.0.0")))]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *names, *pairs, F.concat(F.lit('"sequence_number":'), sequence)), F.lit("}"))
    texts = rows.select(whole.alias("whole"), "m", (c("arrival") + c("copy") * F.lit(step)).alias("arrival"))
    return texts.select(F.when(m == 8, F.substring("whole", 1, 40)).when(m == 12, "[1,2]").otherwise(c("whole")).alias("raw"), "arrival")


#: What stream messages hold of a sample, beside event_id and sequence_number.
CARRIED = ("asset_id", "asset_type", "operating_mode", *FIELDS)


def stream_messages(samples: DataFrame) -> DataFrame:
    """``raw, arrival, t_us``: samples in time order by asset, and bad messages right after some of them.

    ``arrival`` is ten times a sample's number within its asset, and more for
    what follows it: 1 a broken copy, 2 the same message again, 3 its time
    under a new id, 4 a message of a minute before. Some samples come with
    sequence number 0.
    """
    c = F.col
    rows = samples.withColumn("place", F.row_number().over(Window.partitionBy("asset_id").orderBy("t_us", "arrival")))
    number = F.when(c("arrival") % 107 == 0, 0).otherwise(c("place"))

    def message(after: int, every: int | None, event_id: Column, seconds: float = 0.0) -> DataFrame:
        some = rows if every is None else rows.where(c("arrival") % every == 0)
        values = [(c(f) + seconds).alias(f) if f == "timestamp" and seconds else c(f) for f in CARRIED]
        text = F.to_json(F.struct(event_id.alias("event_id"), *values, number.alias("sequence_number"), F.lit("1.0.0").alias("schema_version")))
        return some.select((F.substring(text, 1, 40) if after == 1 else text).alias("raw"), (c("place") * 10 + after).cast("long").alias("arrival"), "t_us")

    own, suffixed = c("event_id"), lambda x: F.concat("event_id", F.lit(x))
    return message(0, None, own).union(message(1, 97, own)).union(message(2, 101, own)).union(message(3, 103, suffixed("b"))).union(message(4, 89, suffixed("l"), -60.0))
