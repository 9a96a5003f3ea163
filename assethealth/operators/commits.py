"""Stored tables with a log of commits: appends once a batch, upserts by buckets of keys, reads as of a commit.

A commit is a row of the table's ``_commits`` folder, appended when the
commit's data are complete: its number, batch, time, rows and parts. Nothing
is read that no commit names, so a run that breaks off leaves the table as it
was, and a batch that comes again finds its commit and changes nothing. One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "commit int, batch_id long, committed_at timestamp, rows long, parts array<int>"
#: Parts that the keys of an upserted table are dealt into, by their hash.
BUCKETS = 64


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The table's commits (``LOG``); none where there is no table yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _next(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The number of a batch's commit, or none if it has one."""
    last, done = commits(spark, path).agg(F.coalesce(F.max("commit"), F.lit(0)), F.coalesce(F.bool_or(F.col("batch_id") == batch_id), F.lit(False))).first()
    return None if done else last + 1


def _written(rows: DataFrame, path: str, partition: str | None = None) -> int:
    """Write ``rows`` and say how many there were, counted on the way."""
    seen = Observation()
    writer = rows.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return seen.get["rows"]


def _log(spark: SparkSession, path: str, commit: int, batch_id: int, rows: int, parts: list[int]) -> None:
    entry = spark.createDataFrame([(commit, batch_id, rows, parts)], "commit int, batch_id long, rows long, parts array<int>")
    entry.withColumn("committed_at", F.current_timestamp()).select("commit", "batch_id", "committed_at", "rows", "parts").coalesce(1).write.mode("append").parquet(f"{path}/_commits")


def append(rows: DataFrame, path: str, batch_id: int) -> int | None:
    """Append a batch as a commit; its number, or none if the batch is there already."""
    spark = rows.sparkSession
    commit = _next(spark, path, batch_id)
    if commit is not None:
        _log(spark, path, commit, batch_id, _written(rows, f"{path}/data/commit={commit}"), [0])
    return commit


def appended(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame | None:
    """The rows that commits up to ``as_of`` (all, if not given) have appended; none before the first."""
    numbers = [r["commit"] for r in commits(spark, path).where(F.lit(as_of is None) | (F.col("commit") <= (as_of or 0))).select("commit").toLocalIterator()]
    return spark.read.parquet(*[f"{path}/data/commit={n}" for n in numbers]) if numbers else None


def _parts(spark: SparkSession, path: str, as_of: int | None = None) -> dict[int, int]:
    """The commit that each bucket stands in, as of a commit; ``BUCKETS`` numbers at most."""
    log = commits(spark, path)
    log = log if as_of is None else log.where(F.col("commit") <= as_of)
    return {r["part"]: r["commit"] for r in log.select("commit", F.explode("parts").alias("part")).groupBy("part").agg(F.max("commit").alias("commit")).collect()}


def upsert(batch: DataFrame, path: str, batch_id: int, key: str, merged: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> int | None:
    """Merge a batch into the table at ``path`` as a commit; its number, or none if the batch is there already.

    ``merged(stored, batch)`` gives the rows to store, one a key. Keys are
    dealt into buckets by their hash; only those that the batch touches are
    read and written again, the rest stay where earlier commits put them.
    """
    spark = batch.sparkSession
    commit = _next(spark, path, batch_id)
    if commit is None:
        return None
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = sorted(r["b"] for r in batch.select(bucket.alias("b")).distinct().collect())
    stand = {b: c for b, c in _parts(spark, path).items() if b in touched}
    stored = _read(spark, path, stand) if stand else batch.limit(0)
    rows = merged(stored, batch).withColumn("bucket", bucket).repartition("bucket")
    _log(spark, path, commit, batch_id, _written(rows, f"{path}/data/commit={commit}", "bucket"), touched)
    return commit


def _read(spark: SparkSession, path: str, stand: dict[int, int]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/data/commit={c}/bucket={b}" for b, c in sorted(stand.items())])


def upserted(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame | None:
    """The table as of a commit (the last, if not given); none before the first."""
    stand = _parts(spark, path, as_of)
    return _read(spark, path, stand) if stand else None
