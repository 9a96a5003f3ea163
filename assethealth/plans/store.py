"""Serving tables, built once for a session and an input, and read by the analytical queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assethealth.operators import tables
from assethealth.sources.scratch import scratch
from assethealth.sources.telemetry import events, read_table

_BUILT: dict[tuple, str] = {}


def stored(name: str, make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The table that ``make`` gives, written when first asked for and read afterwards.

    It is written again for another session or where the event table has
    other files, which are told by their names.
    """

    def query(s: SparkSession, d: str) -> DataFrame:
        key = (s.sparkContext.applicationId, name, *sorted(events(s, d).inputFiles()))
        if key not in _BUILT:
            path = scratch(s, name)
            rows = make(s, d)
            tables.replace(rows, path)
            _BUILT[key] = path
        return read_table(s, _BUILT[key])

    return query
