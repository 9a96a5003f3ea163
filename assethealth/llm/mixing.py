"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.llm.shared import text_or_empty, written

#: No source is taken more often than this.
MOST_REPEATS = 3
#: Weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Where a source's weight schedule ends, times where it begins, repeating likewise.
#: The weight moves in a straight line over the training run.
RAMPS = (0.5, 1.0, 3.0)
#: Documents that one step of the running sum holds, about.
BUCKET_ROWS = 2000
#: Columns that the mix adds to documents.
OWN = ("size", "source_size", "target", "taken", "position", "takes")


def word_count(column: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space."""
    inner = F.btrim(text_or_empty(column), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, most: float = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target, ramp`` from ``sizes(source, source_size)``.

    The whole size is shared by weight; a target stops at ``most`` times its
    source's size and the excess is shared by weight among the rest, until none
    is above. With sources sorted by cap over weight, those that stop are the
    first ones, so running sums give the level at once. One row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("place") % len(values) + 1).cast("int"))
    rows = sizes.withColumn("place", place).withColumns({"weight": pick(weights), "ramp": pick(ramps), "cap": F.col("source_size") * float(most)})
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights_left": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("level", F.col("left") / F.col("weights_left")).withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    # the level that holds is that of the first source that does not stop
    rows = rows.withColumn("shared", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"])
    target = F.when(F.col("stops") | F.col("shared").isNull(), F.col("cap")).otherwise(F.least(F.col("shared") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"), "ramp")


def training_position(share: Column, ramp: Column) -> Column:
    """When, from 0 to 1, a source has met ``share`` of its demand.

    Its weight goes from 1 to ``ramp`` in a straight line. Integrated, the
    demand met by time t is (t + (ramp - 1) t^2 / 2) / ((1 + ramp) / 2), and
    this is the inverse of that.
    """
    slope = ramp - 1
    need = share * (1 + ramp) / 2
    return F.when(F.abs(slope) < 1e-9, share).otherwise((F.sqrt(1 + 2 * slope * need) - 1) / F.when(F.abs(slope) < 1e-9, F.lit(1.0)).otherwise(slope))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, most: int = MOST_REPEATS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, position, takes`` for each row.

    Within a source, documents stand in the order of the MD5 of their doc_id;
    their words, laid end to end, are gone through again and again until the
    target is met, so each source takes its target to the word and a document
    is taken ``most`` times at most. ``takes`` has one entry a take: its number,
    its ``words`` and ``position``, where its middle falls in training: the
    inverse of its source's cumulative demand. ``position`` beside it is that
    of the first take (null if nothing is taken). Rows are range-sorted by it.

    The running sum of a source is made in two steps, over hash buckets and
    within each, so one source may hold any share of the rows; buckets grow in
    number with the rows, never in size, also where many rows share a doc_id
    or lack one (``bucketed``). A null text has size 0 and is never taken; a
    null source is a source; rows with equal or null doc_ids are ordered by
    size, then by their texts' hash, and equal rows change places without
    effect. An empty table gives none; extra columns are ignored. Reruns agree.
    """
    place = F.xxhash64(F.monotonically_increasing_id()).alias("r")
    rows = written(sized(docs.select("doc_id", "source", "text")).drop("row").select("*", place), "sizes")
    mixed = placed(rows, weights, ramps, most, bucket_rows)
    return in_training_order(mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "takes"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h`` (MD5 of doc_id), ``t`` (of the text), and the whole ``row``, whatever its columns are called."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    t = F.lpad(F.lower(F.hex(F.xxhash64(text_or_empty()))), 16, "0")
    return docs.select("doc_id", "source", word_count().alias("size"), h.alias("h"), t.alias("t"), F.struct("*").alias("row"))


def bucketed(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` of ``sized`` with ``bucket``, a text in whose order buckets follow one another as their rows do.

    A bucket is a power of 16 by the first digits of ``h``. Where many rows
    share one ``h``, as those without a doc_id do, buckets around it have the
    whole of ``h``, and its own rows are dealt further by size and text. Rows
    equal in all of these stay together, unless they have ``r``, where they
    stand in a written table.
    """
    digits = max(1, ceil(log2(max(rows.count() / bucket_rows, 1)) / 4))
    rows = rows.withColumn("bucket", F.substr("h", F.lit(1), F.lit(digits)))
    crowded = lambda by, name: written(rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > 4 * bucket_rows).select(by, F.lit(True).alias(name)), name)
    rows = rows.join(crowded("bucket", "near_hot"), "bucket", "left").join(crowded("h", "hot"), "h", "left")
    finer = [F.col("h"), F.lpad(F.col("size").cast("string"), 19, "0"), F.substring("t", 1, 4), *([F.substring(F.hex("r"), 1, 2)] if "r" in rows.columns else [])]
    bucket = F.when(F.col("hot"), F.concat_ws("|", *finer)).when(F.col("near_hot"), F.col("h")).otherwise(F.col("bucket"))
    return rows.withColumn("bucket", bucket).drop("hot", "near_hot")


def placed(rows: DataFrame, weights: tuple[float, ...], ramps: tuple[float, ...], most: int, bucket_rows: int) -> DataFrame:
    """``rows`` of ``sized`` with ``source_size, target, taken, position, takes``."""
    rows = bucketed(rows, bucket_rows)
    buckets = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "source-buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ramps, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    starts = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "bucket", "start", "source_size", "target", "ramp")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    found = found.alias("p").join(written(starts, "starts").alias("s"), F.expr("p.source <=> s.source AND p.bucket = s.bucket"))
    found = found.select("p.*", "source_size", "target", "ramp", (F.col("start") + F.col("inner")).alias("at"))
    wanted = F.round("target").cast("long")
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), wanted - F.col("at") - F.lit(i) * F.col("source_size"))) for i in range(most)]
    middle = lambda i: (F.col("at") + F.lit(i) * F.col("source_size") + takes[i] / 2) / F.nullif(F.col("target"), F.lit(0.0))
    each = [F.struct(F.lit(i + 1).alias("take"), takes[i].cast("long").alias("words"), training_position(middle(i), F.col("ramp")).alias("position")) for i in range(most)]
    found = found.withColumns({"taken": sum(takes[1:], takes[0]).cast("long"), "takes": F.filter(F.array(*each), lambda x: x["words"] > 0)})
    return found.withColumn("position", F.when(F.col("taken") > 0, training_position(middle(0), F.col("ramp"))))


def curriculum(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that the mix takes, range-sorted by the training position of their first take.

    All columns of ``docs`` (those the mix adds give way to its own), with
    ``size``, ``source_size``, ``target``, ``taken``, ``position`` and ``takes``.
    Nulls, ties and repeated rows are as in ``mix``; an empty table gives none.
    """
    return in_training_order(taken_rows(docs, {k: F.col(k) for k in OWN}, **options))


def schedule(docs: DataFrame, **options: object) -> DataFrame:
    """One row a take, range-sorted by training position: repeats come over the rest of training.

    As ``curriculum``, but ``taken`` is the words of this take, ``position``
    its own, and ``take`` its number from 1. Nulls, ties and repeated rows are
    as in ``mix``; an empty table gives none.
    """
    one = F.explode("takes")
    own = {k: F.col(k) for k in OWN[:3]} | {"taken": F.col("one.words"), "position": F.col("one.position"), "take": F.col("one.take")}
    return in_training_order(taken_rows(docs, own, one, **options))


def in_training_order(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def taken_rows(docs: DataFrame, own: dict[str, Column], one: Column | None = None, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, most: int = MOST_REPEATS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, each whole, with the columns ``own``; no join brings them together."""
    rows = placed(sized(docs), weights, ramps, most, bucket_rows).where("taken > 0")
    rows = rows.withColumn("one", one) if one is not None else rows
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in own]
    return rows.select(*kept, *[v.alias(k) for k, v in own.items()])
