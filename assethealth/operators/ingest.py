"""An ingestion run that counts what it writes while it writes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assethealth.operators import commits


@dataclass
class Run:
    """What a run has counted on its rows as they passed."""

    run_id: str
    generated: int
    valid: int
    quarantined: int
    delayed: int
    out_of_order: int
    commit: int | None

    @property
    def status(self) -> str:
        return "COMPLETED" if self.generated else "EMPTY"

    def ledger(self, spark: SparkSession) -> DataFrame:
        """The run's row of the ledger."""
        row = (self.run_id, self.generated, self.valid, self.quarantined, self.status)
        return spark.createDataFrame([row], "run_id string, events_generated long, events_valid long, events_quarantined long, status string")


def ingested(checked: DataFrame, path: str, batch_id: int, run_id: str = "run") -> Run:
    """Write judged events as one commit and count them on the way, in one pass.

    Good and bad ones lie apart by ``is_valid`` (``lake`` and ``quarantine``
    read one kind), so both come out of the same write.
    """
    seen = Observation()
    count = lambda c: F.count_if(c)
    watched = checked.observe(
        seen, F.count("*").alias("generated"), count(F.col("is_valid")).alias("valid"), count(~F.col("is_valid")).alias("quarantined"),
        count(F.col("is_delayed")).alias("delayed"), count(F.col("is_out_of_order")).alias("out_of_order"),
    )
    commit = commits.append(watched, path, batch_id)
    got = seen.get if commit is not None else dict.fromkeys(("generated", "valid", "quarantined", "delayed", "out_of_order"), 0)
    return Run(run_id, *(int(got[k]) for k in ("generated", "valid", "quarantined", "delayed", "out_of_order")), commit)


def lake(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The valid events that commits have appended."""
    return commits.appended(spark, path, as_of).where("is_valid")


def quarantine(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    return commits.appended(spark, path, as_of).where("NOT is_valid")


def run_report(spark: SparkSession, runs: list[Run], path: str) -> DataFrame:
    """``metric, name, value`` of an ingestion: what its runs have counted, the table's rows and commits, and rows by asset.

    One row a figure, so that a fleet of any size stays in rows.
    """
    total = {k: sum(getattr(r, k) for r in runs) for k in ("generated", "valid", "quarantined", "delayed", "out_of_order")}
    counted = spark.createDataFrame([(f"events_{k}", "", v) for k, v in total.items()], "metric string, name string, value long")
    rows = lake(spark, path)
    in_table = rows.agg(F.count("*").alias("value")).select(F.lit("table_rows").alias("metric"), F.lit("").alias("name"), "value")
    snapshots = commits.commits(spark, path).agg(F.count("*").alias("value")).select(F.lit("snapshots").alias("metric"), F.lit("").alias("name"), "value")
    by_asset = rows.groupBy(F.col("asset_id").alias("name")).agg(F.count("*").alias("value")).select(F.lit("asset_rows").alias("metric"), "name", "value")
    return counted.union(in_table).union(snapshots).union(by_asset)
