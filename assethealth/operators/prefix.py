"""Numbers and running sums over a whole table in order, with no task that holds all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.sources.scratch import kept, scratch

#: Blocks that a table is cut into by its values.
BLOCKS = 64


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``number``: a row's place in the whole table, from 1, in an order that tells rows apart.

    Rows are dealt by ranges of the whole order, so ties in its first columns
    are spread, and written where they stand. A row's number is its place in
    its task's output plus the rows of the tasks before, a row a task.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumns({"_place": F.monotonically_increasing_id(), "_task": F.spark_partition_id()})
    table = kept(ordered, scratch(rows.sparkSession, "numbered"))
    tasks = table.groupBy("_task").agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tasks.select("_task", (before + 1 - F.col("first")).alias("_offset"))
    return table.join(F.broadcast(offsets), "_task").withColumn("number", F.col("_place") + F.col("_offset")).drop("_place", "_task", "_offset")


def value_block(rows: DataFrame, value: str, blocks: int = BLOCKS) -> Column:
    """Number of the block of a value: how many of the table's approximate quantiles, ``blocks`` numbers at most, it reaches."""
    shares = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(rows.agg(F.percentile_approx(F.col(value).cast("double"), shares, 10_000)).first()[0] or []))
    return sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def running_sums(rows: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before_<sum>`` for each of ``sums``: its total over rows of lesser ``value`` (of the same ``by``), for distinct values.

    Rows are summed within blocks of neighbouring values, and the blocks, a
    row each, among themselves.
    """
    rows = rows.withColumn("_block", value_block(rows, value))
    inner = Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda s, w: F.coalesce(F.sum(s).over(w), F.lit(0))
    totals = rows.groupBy(*by, "_block").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    totals = totals.select(*by, "_block", *[zero(f"_{s}", outer).alias(f"_{s}") for s in sums])
    joined = rows.withColumns({f"before_{s}": zero(s, inner) for s in sums}).join(totals, [*by, "_block"])
    return joined.withColumns({f"before_{s}": F.col(f"before_{s}") + F.col(f"_{s}") for s in sums}).drop("_block", *[f"_{s}" for s in sums])
