"""Progress of a stream as its own micro-batches report it."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The observation's name, and what it counts of the rows of ``asset_stream`` as they come out.
NAME = "assets"
COUNTED = ("processed", "quarantined", "late", "late_accepted", "anomalies", "alerts", "windows", "out_of_order")
REPORT = "batch long, input_rows long, " + ", ".join(f"{c} long" for c in COUNTED) + ", newest_us long, batch_ms long"


def observed(outputs: DataFrame) -> DataFrame:
    """``outputs`` of ``asset_stream``, counted by Spark as they pass, in each micro-batch."""
    c, kind = F.col, lambda k: F.col("kind") == k
    return outputs.observe(
        NAME, F.count_if(kind("processed")).alias("processed"), F.count_if(kind("quarantine")).alias("quarantined"), F.count_if(kind("late")).alias("late"),
        F.count_if(kind("processed") & (c("lateness") == "LATE_ACCEPTED")).alias("late_accepted"), F.coalesce(F.sum(F.when(kind("processed"), c("found"))), F.lit(0)).alias("anomalies"),
        F.count_if(kind("processed") & (c("outcome") == 2)).alias("alerts"), F.count_if(kind("window")).alias("windows"), F.count_if(kind("processed") & c("out_of_order")).alias("out_of_order"),
        F.coalesce(F.max(F.when(kind("processed"), c("t_us"))), F.lit(0)).alias("newest_us"),
    )


class ProgressListener(StreamingQueryListener):
    """Keeps a row a micro-batch with data (``REPORT``) of the queries that run while it is added to a session."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event: object) -> None:
        self.ended.clear()

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        seen = p.observedMetrics.get(NAME)
        if seen is not None and p.numInputRows:
            self.rows.append((p.batchId, p.numInputRows, *(int(seen[c]) for c in COUNTED), int(seen["newest_us"]), int(p.batchDuration)))

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.ended.set()

    def report(self, spark: SparkSession) -> DataFrame:
        """A row a micro-batch."""
        return spark.createDataFrame(self.rows, REPORT)
