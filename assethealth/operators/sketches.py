"""Distinct counts that can be added up: a sketch a batch, stored, and merged over any batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of a sketch's registers; the standard error is 1.04 over their root, 0.8 %.
REGISTERS = 14


def sketched(rows: DataFrame, value: str, by: tuple[str, ...], registers: int = REGISTERS) -> DataFrame:
    """``by, rows, sketch``: rows and a HyperLogLog sketch of the distinct values of each group; nulls are not counted as a value."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(value, F.lit(registers)).alias("sketch"))


def merged(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, rows, distinct``: sketches of any batches merged, a sketch's bytes a group and batch, not the values."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
