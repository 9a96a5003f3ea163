"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


_OWN: dict[str, str] = {}
RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text, and rows, that a Python task works on at a time, about.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a single machine) a temporary folder is
    taken, once a session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="assethealth-")
    return _OWN[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end; else those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(RELEASED, None)
    spark.conf.set(RELEASED, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASED) if before is None else spark.conf.set(RELEASED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back; its shuffle files go at once.

    Executors may be lost later without the work before this point being done
    again. The new scan also has a known size, so adaptive execution can pick
    and split joins on it.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, numbers: dict[str, Column] | None = None) -> DataFrame:
    """``docs(doc_id, text)``, or ``numbers`` of each text instead of it, with the columns of ``labels`` and ``h``: ``bound`` rows at most, those with the least hash ``h`` of doc_id.

    Rows equal in id, text and labels count once. ``bound`` labels with the
    least hashes are drawn from the label table, then ``bound`` of the hashes
    of their texts, as one id may have many; only the texts so chosen travel,
    or their ``numbers``, expressions over ``text``, alone.
    """
    names = [c for c in labels.columns if c != "doc_id"]
    some = labels.distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", *names).limit(bound)
    text = text_or_empty()
    hashes = docs.select("doc_id", F.xxhash64(text).alias("text_hash")).join(F.broadcast(some), "doc_id").distinct()
    chosen = written(hashes.orderBy("h", "doc_id", "text_hash", *names).limit(bound), "chosen")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).join(F.broadcast(chosen), ["doc_id", "text_hash"])
    keys = ["doc_id", "text_hash", "h", *names]
    if numbers is not None:
        rows = rows.select(*keys, *[c.alias(k) for k, c in numbers.items()])
    return rows.groupBy(*keys).agg(*[F.any_value(k).alias(k) for k in (numbers or ["text"])]).drop("text_hash")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``PIECE_BYTES`` of text and ``PIECE_ROWS``, so that what is made of them stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(np.maximum(sizes, PIECE_BYTES // PIECE_ROWS)) // PIECE_BYTES
    ends = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
    for low, high in zip(ends, ends[1:], strict=False):
        yield batch.slice(low, high - low)


def map_texts(rows: DataFrame, make: Callable[[], Callable[[list[str]], dict]], fields: dict[str, str]) -> DataFrame:
    """``rows`` without ``text``, and the columns that ``make()(texts)`` gives for each batch.

    ``make`` runs once a task. ``fields`` has the new columns' Spark types.
    Batches come in ``pieces`` and stay in Arrow, so the other columns, nulls included, pass as they are.
    """
    text = rows.withColumn("text", text_or_empty())
    others = [f for f in rows.schema if f.name != "text"]
    schema = StructType([*others, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in (piece for batch in batches for piece in pieces(batch)):
            new = f(b.column("text").to_pylist())
            kept = [b.column(n) for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(new[k], arrow.field(k).type, from_pandas=True) for k in fields)], names=[x.name for x in schema])

    return text.mapInArrow(run, schema)


def keep_rows(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows for whose text ``make()(texts)`` says true, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in (piece for batch in batches for piece in pieces(batch)):
            yield b.filter(pa.array(f([t or "" for t in b.column("text").to_pylist()]), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
