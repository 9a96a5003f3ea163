"""Where a pattern matches in a text, by DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_sums(numbers: Column) -> Column:
    """The sums of an array of integers up to each place, by doubling: every round adds what stands twice as far back as the last one's."""
    rounds = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)).cast("double"))).cast("int")

    def step(acc: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: x + F.when(i >= back, F.get(acc, i - back)).otherwise(F.lit(0)))

    return F.aggregate(F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>")), numbers, step)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of ``start``, ``end`` (code points, end exclusive) and ``value``.

    The text is cut at the matches; lengths of the pieces and of the matches
    between them, added up, give the offsets, at a cost in proportion to their
    number and its logarithm.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # bound to lambda variables, so that each is made once
    both = F.array(F.struct(found.alias("found"), gaps.alias("gaps")))
    steps = F.transform(both, lambda b: F.struct(b["found"].alias("found"), F.zip_with(b["found"], F.slice(b["gaps"], 1, F.size(b["found"])), lambda v, g: F.length(g) + F.length(v)).alias("steps")))
    ends = F.transform(steps, lambda b: F.struct(b["found"].alias("found"), running_sums(b["steps"]).alias("ends")))
    return F.transform(ends, lambda b: F.zip_with(b["found"], b["ends"], lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"))))[0]
