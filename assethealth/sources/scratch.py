"""A new path in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def _local(app: str) -> str:
    """A temporary folder of an application that runs on this machine alone; it goes when Python ends."""
    if app not in _LOCAL:
        path = tempfile.mkdtemp(prefix="assethealth-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[app] = f"file://{path}"
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """Below ``spark.checkpoint.dir``; where that is unset and all runs on one machine, below a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local(spark.sparkContext.applicationId)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written at ``path`` and read back, so that what comes next does not work them out again."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
