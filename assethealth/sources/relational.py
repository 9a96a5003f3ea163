"""Tables of record in a relational database, as a catalog beside the session's.

``with_catalog`` names the database in the session; its tables then stand in
SQL next to lake tables, and Spark sends conditions, columns and aggregates
down to it. ``read_parts`` reads a large table in ranges of a key, one
connection each. The database is the one of the setting
``assethealth.relational.url``; only where that is unset and all runs in one
process an embedded one in memory is taken, as tests do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

URL, DRIVER = "assethealth.relational.url", "assethealth.relational.driver"
EMBEDDED = {"url": "jdbc:derby:memory:assethealth;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
#: Types of columns for which Spark's own choice cannot be compared or is too wide.
TEXT = "VARCHAR({n})"


def connection(spark: SparkSession) -> dict[str, str]:
    """``url`` and ``driver`` of the database."""
    url = spark.conf.get(URL, None)
    if url:
        driver = spark.conf.get(DRIVER, None)
        return {"url": url} | ({"driver": driver} if driver else {})
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {URL} to a database that all executors reach")
    return EMBEDDED


def with_catalog(spark: SparkSession, name: str = "record", push: bool = True) -> str:
    """Make the database known to the session as the catalog ``name``; conditions are always sent down, aggregates with ``push``.

    Limits stay with Spark: the embedded database took one and gave all rows.
    """
    settings = {f"spark.sql.catalog.{name}": CATALOG} | {f"spark.sql.catalog.{name}.{k}": v for k, v in connection(spark).items()}
    settings |= {f"spark.sql.catalog.{name}.pushDownAggregate": str(push).lower(), f"spark.sql.catalog.{name}.pushDownLimit": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    return name


def store(rows: DataFrame, schema: str, table: str, text: int = 200, tasks: int = 4) -> None:
    """Write ``rows`` as ``schema.table``, replacing its rows; texts have up to ``text`` characters."""
    spark = rows.sparkSession
    name = with_catalog(spark)
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name}.{schema}")
    kinds = ", ".join(f"{f.name} {TEXT.format(n=text)}" for f in rows.schema if isinstance(f.dataType, T.StringType))
    writer = rows.coalesce(tasks).write.format("jdbc").options(**connection(spark), dbtable=f"{schema}.{table}", truncate="true").mode("overwrite")
    (writer.option("createTableColumnTypes", kinds) if kinds else writer).save()


def read_parts(spark: SparkSession, table: str, key: str, parts: int = 8) -> DataFrame:
    """A table read in ``parts`` ranges of a whole-number key between its least and largest value, which the database is asked for."""
    options = connection(spark)
    ends = spark.table(f"{with_catalog(spark)}.{table}").agg(F.min(key).cast("long"), F.max(key).cast("long")).first()
    reader = spark.read.format("jdbc").options(**options, dbtable=table)
    if ends[0] is not None and ends[1] > ends[0]:
        reader = reader.options(partitionColumn=key, lowerBound=ends[0], upperBound=ends[1] + 1, numPartitions=parts)
    return reader.load()
