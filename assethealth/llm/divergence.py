"""Divergence of sources: how differently the sources of a language use its words, by count-level bitmaps.

A source's counts of the kept terms are stored as bitsets of term ids, one for
each (group, count) and block of up to 64 ids. For two sources, the AND of two
bitsets holds the terms that occur so often in one and so often in the other;
its popcount is that cell of the pair's joint table, and the measure depends
on the cell alone. Cells with a zero count are never stored: they follow by
complement from each level's size and from V.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assethealth.llm.shared import pieces, text_or_empty, written

#: Lower-cases A-Z and makes every other ASCII character but a-z a space; bytes of longer characters stay.
LETTERS = bytes(i if i > 127 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
#: Documents of a language that a kept term occurs in at least.
LEAST_DOCS = 10
#: Terms of a source that are listed at most.
TERMS = 10
SCALE = 1_000_000_000
#: Distinct terms a task holds before it passes their counts on.
HELD_TERMS = 200_000


def _div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, rounded down for those that are not negative."""
    return F.call_function("div", a, b)


def rate(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``; the product is a decimal, so that no corpus is too large for it."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    return 1 + _div(whole(count + 2, 20) * whole(F.lit(SCALE), 10), whole(F.greatest(total + 2 * terms, F.lit(1)), 20))


def measure(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; rates are at most SCALE + 1, so a long holds the square."""
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, occurrences, docs``: counts of each group's terms, null columns as empty text.

    A task adds up its own rows first and passes on one row a group and term.
    """
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                words, counts = list(terms), list(terms.values())
                for at in range(0, len(words), 50_000):
                    some, n = words[at : at + 50_000], counts[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(some)), "source": pa.array([source] * len(some)), "term": pa.array(some, pa.binary()).cast(pa.string()),
                        "occurrences": pa.array([x[0] for x in n], pa.int64()), "docs": pa.array([x[1] for x in n], pa.int64()),
                    })
            held.clear()

        for b in (piece for batch in batches for piece in pieces(batch)):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                terms = held.setdefault((lang, source), {})
                for word, k in Counter(text.translate(LETTERS).split()).items():
                    if word in terms:
                        terms[word][0] += k
                        terms[word][1] += 1
                    else:
                        terms[word] = [k, 1]
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from passed_on()
        yield from passed_on()

    parts = rows.mapInArrow(run, "lang string, source string, term string, occurrences long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs"))


def numbered(kept: DataFrame) -> DataFrame:
    """``kept(lang, term, total)`` with ``block, bit``: each term's place among bitsets.

    Terms of about one frequency share a block, since few levels meet there.
    A block holds 64 rare terms, 8 less rare ones, or one frequent term, whose
    count is a level of its own in nearly every source. Terms are dealt by
    ranges and numbered where they are, so a vocabulary of any size is spread.
    """
    grade = F.floor(F.log2("total")).cast("int").alias("grade")
    ordered = kept.select("lang", "term", "total", grade).repartitionByRange("lang", "grade", "term").sortWithinPartitions("lang", "grade", "term")
    rows = written(ordered.withColumn("place", F.monotonically_increasing_id()), "numbered")
    width = F.when(F.col("grade") < 6, 64).otherwise(F.when(F.col("grade") < 10, 8).otherwise(1))
    block = F.shiftleft(F.col("grade").cast("long"), 56).bitwiseOR(_div(F.col("place"), width))
    return rows.select("lang", "term", "total", block.alias("block"), (F.col("place") % width).cast("int").alias("bit"))


def bitmaps(cells: DataFrame) -> DataFrame:
    """``lang, source, occurrences, block, bits`` from ``cells`` with ``block, bit``: a bitset for each (group, count) and block."""
    one = F.expr("shiftleft(1L, bit)")
    return cells.groupBy("lang", "source", "occurrences", "block").agg(F.bit_or(one).alias("bits"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far apart sources of a language are, and by which terms.

    Part ``pair`` has each other source of the language, part ``term`` the
    ``most_terms`` terms that the source uses most above the language's rate.
    Null text, lang and source count as empty; groups without terms have
    pairs like any other (0 where the language keeps no term); a language of
    one source has no pairs; equal values are ranked by UTF-8 bytes of the
    item; repeated rows count repeatedly; doc_id and other columns are
    ignored; an empty table gives none.
    """
    counts = written(term_counts(docs), "term-counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("occurrences").alias("total"), F.sum("docs").alias("docs"))
    kept = written(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "total"), "kept-terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    cells = written(counts.drop("docs").join(numbered(kept), ["lang", "term"]), "cells")

    zero = F.coalesce("group_total", F.lit(0)), F.coalesce("terms", F.lit(0))
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("occurrences").alias("group_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.select("lang", "source", zero[0].alias("group_total"), zero[1].alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), rate(F.lit(0), *zero).alias("rate_of_none"))
    groups = written(groups, "groups")

    pairs = pair_values(bitmaps(cells), groups)
    terms = cells.join(groups, ["lang", "source"])
    terms = terms.select("lang", "source", "term", rate(F.col("occurrences"), F.col("group_total"), F.col("terms")).alias("p"), rate(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"))
    terms = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), measure(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= most_terms))


def pair_values(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` for each two sources of a language, both ways.

    With f for a joint cell's measure, a and b for the counts in the two
    sources and z for a count of zero, the sum over all V terms is V f(z, z)
    + sum over levels a of |a| (f(a, z) - f(z, z)), likewise for b, + sum
    over joint cells of |a AND b| (f(a, b) - f(a, z) - f(z, b) + f(z, z)).
    """
    of_group = groups.select("lang", "source", "group_total", "terms", "rate_of_none")
    rated = levels.join(of_group, ["lang", "source"]).withColumn("p", rate(F.col("occurrences"), F.col("group_total"), F.col("terms")))
    rated = written(rated.select("lang", "source", "block", "bits", "p", F.col("rate_of_none").alias("z")), "levels")
    a, b = (rated.select("lang", "block", *[F.col(c).alias(f"{c}_{side}") for c in ("source", "bits", "p", "z")]) for side in "ab")
    joint = a.join(b, ["lang", "block"]).where("source_a < source_b").withColumn("n", F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).where("n > 0")
    f = lambda x, y: measure(F.col(x), F.col(y))
    joint = joint.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("n") * (f("p_a", "p_b") - f("p_a", "z_b") - f("z_a", "p_b") + f("z_a", "z_b"))).alias("v"))

    other = groups.select("lang", F.col("source").alias("source_b"), F.col("rate_of_none").alias("z_b"))
    sizes = rated.groupBy("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a"), F.col("z").alias("z_a")).agg(F.sum(F.bit_count("bits")).alias("n"))
    single = sizes.join(other, "lang").where("source_a <> source_b")
    single = single.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("n") * (f("p_a", "z_b") - f("z_a", "z_b"))).alias("v"))

    own = groups.select("lang", "terms", F.col("source").alias("source_a"), F.col("rate_of_none").alias("z_a"))
    none = own.join(other, "lang").where("source_a < source_b").select("lang", "source_a", "source_b", (F.col("terms") * f("z_a", "z_b")).alias("v"))

    ends = F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b")
    every = joint.unionByName(none).unionByName(single.select("lang", *ends, "v"))
    total = every.groupBy("lang", "source_a", "source_b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return total.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
