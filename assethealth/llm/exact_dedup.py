"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import text_or_empty, written

#: Characters of a text that the second step hashes.
PREFIX = 256


def _length() -> Column:
    return F.octet_length(text_or_empty())


def _prefix_hash() -> Column:
    return F.xxhash64(F.substring(text_or_empty(), 1, PREFIX))


def candidate_groups(docs: DataFrame) -> DataFrame:
    """``length, prefix`` of the groups that two or more texts share.

    The prefix is hashed only for lengths that occur twice, and both steps
    count with map-side partial sums, so a group of copies of any size meets
    as one row a task.
    """
    lengths = written(docs.groupBy(_length().alias("length")).agg(F.count("*").alias("n")).where("n > 1").select("length"), "lengths")
    heads = docs.select(_length().alias("length"), F.substring(text_or_empty(), 1, PREFIX).alias("head"))
    twice = heads.join(lengths, "length", "left_semi").select("length", F.xxhash64("head").alias("prefix"))
    return twice.groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("length", "prefix")


def exact_dedup(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` for each row, dropped ones too.

    ``also`` names further columns to return, as expressions over ``docs``.

    Texts are equal when identical; null counts as empty. Only rows whose
    length and prefix hash occur twice have their full text read again for
    its SHA-256. The row with the largest doc_id stays; identical rows that
    repeat that doc_id are all marked kept (``deduplicated`` keeps one). A null
    doc_id loses to any other; in a group of null doc_ids keep_id is null and
    all are kept. Other columns are ignored; an empty table gives none.
    """
    groups = written(candidate_groups(docs), "groups")
    more = also or {}
    rows = docs.select("doc_id", _length().alias("length"), _prefix_hash().alias("prefix"), text_or_empty().alias("body"), *[c.alias(k) for k, c in more.items()])
    survivors = rows.join(groups, ["length", "prefix"], "left_semi")
    hashed = written(survivors.select("doc_id", "length", F.sha2("body", 256).alias("sha256"), *more), "hashed")
    same = written(hashed.groupBy("length", "sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "same")
    doubled = hashed.join(same, ["length", "sha256"]).select("doc_id", "keep_id", "group_size", *more)
    single = rows.select("doc_id", "length", "prefix", *more).join(groups, ["length", "prefix"], "left_anti")
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *more)
    return doubled.union(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one a text.

    Rows that lose are removed by doc_id and text length and hash together, so
    repeated doc_ids with different texts do not touch one another. Of rows
    with one doc_id and text one stays. The caller's columns travel in a
    struct, so none of their names can clash.
    """
    groups = written(candidate_groups(docs), "groups")
    rows = docs.select("doc_id", text_or_empty().alias("body"), _length().alias("length"), _prefix_hash().alias("prefix"), F.struct("*").alias("row"))
    doubled = rows.join(groups, ["length", "prefix"], "left_semi").select("doc_id", "length", F.sha2("body", 256).alias("sha256"), "row")
    best = written(doubled.groupBy("length", "sha256").agg(F.max("doc_id").alias("keep_id")), "best")
    stay = doubled.join(best, ["length", "sha256"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = stay.dropDuplicates(["length", "sha256", "doc_id"])
    single = rows.join(groups, ["length", "prefix"], "left_anti")
    return stay.select("row.*").unionByName(single.select("row.*"))
