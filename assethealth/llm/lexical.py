"""Ranked lexical search: whole-corpus BM25 in whole numbers over norm buckets.

A document is a vector of impacts, an item a vector of term weights, a score
their product. As in LEMP, documents are ordered by the length of their
vectors and cut into buckets. By Cauchy and Schwarz no document of a bucket
scores above the item's length times the bucket's greatest: buckets that
cannot reach the item's 50th best score so far are passed over. Inside a
bucket an item's heaviest coordinates are summed first; a document goes when
they and the rest, bounded by the lengths of what is left of both vectors,
cannot reach that score. What survives is scored again in whole numbers.

Both vectors are scaled by the root of the term's weight, which leaves the
product as it is and keeps frequent words, whose weight is small, from making
every document long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assethealth.llm.shared import map_texts, written

#: Lower-cases A-Z and makes every other ASCII character but a-z and 0-9 a space; bytes of longer characters stay.
TERMS = bytes(i if i > 127 or 97 <= i <= 122 or 48 <= i <= 57 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
#: Documents that an item's ranking holds.
MOST = 50
#: Documents of a bucket.
BUCKET = 2048
#: Documents with the longest vectors, about, that are searched first for scores to start from.
SEEDS = 16_384
#: Coordinates of an item that are summed between two looks at what can still reach the score.
STEP = 4
#: Terms of items, with repeats between items, in one lot; more are searched lot by lot.
LOT_TERMS = 200_000
#: Stands for a null doc_id, which comes before all others.
NO_ID = np.iinfo(np.int64).min
#: Share that a bound is raised by, for rounding.
SLACK = 1 + 1e-9


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


@dataclass
class Lot:
    """Items searched together: their terms' numbers, and each item's terms."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    item_ids: list[object] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id: object, terms: list[bytes]) -> None:
        self.item_ids.append(item_id)
        self.items.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms], np.int64))


def lots(benchmark: DataFrame, most_terms: int = LOT_TERMS) -> Iterator[Lot]:
    """The items that have terms, in lots of ``most_terms`` distinct terms an item at most, whatever the benchmark's size."""
    lot, size = Lot(), 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        terms = list(dict.fromkeys(terms_of(r["text"])))
        if lot.items and size + len(terms) > most_terms:
            yield lot
            lot, size = Lot(), 0
        if terms:
            lot.add(r["item_id"], terms)
            size += len(terms)
    if lot.items:
        yield lot


def counted(docs: DataFrame, lot: Lot) -> DataFrame:
    """``doc_id, n, ids, tfs``: a document's number of terms, and those of the lot with their occurrences, ids ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(lot.vocabulary)

    def make() -> Callable[[list[str]], dict]:
        number = shared.value.get

        def count(texts: list[str]) -> dict:
            out = {"n": [], "ids": [], "tfs": []}
            for text in texts:
                terms = terms_of(text)
                found = np.fromiter(map(number, terms, repeat(-1)), np.int64, len(terms))
                ids, tfs = np.unique(found[found >= 0], return_counts=True)
                for k, v in zip(out, (len(terms), ids, tfs), strict=True):
                    out[k].append(v)
            return out

        return count

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, {"n": "long", "ids": "array<int>", "tfs": "array<long>"})


@dataclass
class Weights:
    """What a search needs of the whole corpus: documents and terms in all, and the weight of each of the lot's terms."""

    docs: int
    terms: int
    of: np.ndarray

    def impacts(self, n: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Whole-number impacts of terms that occur ``tfs`` times in documents of ``n`` terms."""
        m = 50 + (50 * n * self.docs) // max(self.terms, 1)
        return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


def weights(vectors: DataFrame, lot: Lot) -> Weights:
    """Counts over all documents; a row a term of the lot reaches the driver."""
    docs, terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(lot.vocabulary), np.int64)
    for i, n in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():
        df[i] = n
    return Weights(docs, terms, np.array([floor(1000 * log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64))


def by_length(vectors: DataFrame, lot: Lot, known: Weights) -> DataFrame:
    """``doc_id, ids, impacts, length`` of the documents with terms of the lot, range-sorted by length, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tfs = b.column("ids"), b.column("tfs")
            begins = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            flat, sizes = ids.flatten().to_numpy(), np.diff(begins)
            impacts = known.impacts(np.repeat(b.column("n").to_numpy(), sizes), tfs.flatten().to_numpy())
            squares = np.concatenate([[0.0], np.cumsum(known.of[flat] * impacts.astype(float) ** 2)])
            length = np.sqrt(np.maximum(squares[begins[1:]] - squares[begins[:-1]], 0)) * SLACK
            held = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(impacts, pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": ids, "impacts": held, "length": pa.array(length)})

    rows = vectors.where(F.size("ids") > 0).mapInArrow(run, "doc_id long, ids array<int>, impacts array<long>, length double")
    placed = rows.withColumn("place", F.monotonically_increasing_id())  # any number of documents may have one length
    return placed.repartitionByRange(F.desc("length"), "place").sortWithinPartitions(F.desc("length")).drop("place")


class Best:
    """An item's best documents so far, equal scores by least id, and the score that a document must reach."""

    def __init__(self, most: int, least: int) -> None:
        self.most, self.least = most, least
        self.scores, self.ids = np.array([], np.int64), np.array([], np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        enough = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[enough]]), np.concatenate([self.ids, ids[enough]])
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.most:
            self.least = max(self.least, int(self.scores[-1]))


class Bucket:
    """Documents of near length: their rows, and lists by term."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, begins: np.ndarray, ids: np.ndarray, impacts: np.ndarray, roots: np.ndarray) -> None:
        self.doc_ids, self.lengths, self.begins, self.ids, self.impacts = doc_ids, lengths, begins, ids, impacts
        order = np.argsort(ids, kind="stable")
        self.of = np.repeat(np.arange(len(doc_ids)), np.diff(begins))[order]
        self.coordinates = (roots[ids] * impacts)[order]
        self.lists = np.searchsorted(ids[order], np.arange(len(roots) + 1))

    def able(self, terms: np.ndarray, roots: np.ndarray, least: int) -> np.ndarray:
        """Documents that can reach ``least``, after the item's coordinates were summed as far as it took to tell.

        ``terms`` go from the heaviest to the lightest.
        """
        total, left = np.zeros(len(self.doc_ids)), self.lengths**2
        own = roots[terms]
        rest = np.sqrt(np.append(np.cumsum((own**2)[::-1])[::-1], 0.0))
        alive = np.array([], np.int64)
        for at in range(0, len(terms), STEP):
            for t, q in zip(terms[at : at + STEP], own[at : at + STEP], strict=True):
                low, high = self.lists[t], self.lists[t + 1]
                docs, x = self.of[low:high], self.coordinates[low:high]
                total[docs] += q * x
                left[docs] -= x * x
            bound = total + rest[min(at + STEP, len(terms))] * np.sqrt(np.maximum(left, 0))
            alive = np.flatnonzero((bound * SLACK >= least) & (bound > 0))
            if not len(alive):
                break
        return alive

    def exact(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of ``docs`` in whole numbers; ``weight`` has the item's weights at its terms, else 0."""
        sizes = self.begins[docs + 1] - self.begins[docs]
        places = np.repeat(self.begins[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(weight[self.ids[places]] * self.impacts[places], np.cumsum(sizes) - sizes)


def searched(vectors: DataFrame, lot: Lot, known: Weights, most: int, start: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: for each task and item its ``most`` best documents that score ``start`` or more."""
    shared = vectors.sparkSession.sparkContext.broadcast((lot.items, known.of, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight_of, least = shared.value
        roots = np.sqrt(weight_of.astype(float))
        items = [x[np.argsort(-weight_of[x], kind="stable")] for x in items]
        lengths = np.array([np.sqrt(float(weight_of[x].sum())) for x in items])
        best = [Best(most, max(1, int(s))) for s in least]
        weight = np.zeros_like(weight_of)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                b = batch.slice(at, BUCKET)
                ids, impacts = b.column("ids"), b.column("impacts")
                begins = ids.offsets.to_numpy() - ids.offsets[0].as_py()
                doc_ids = b.column("doc_id").fill_null(int(NO_ID)).to_numpy()
                bucket = Bucket(doc_ids, b.column("length").to_numpy(), begins, ids.flatten().to_numpy(), impacts.flatten().to_numpy(), roots)
                reach = lengths * bucket.lengths.max() * SLACK
                for i in np.flatnonzero(reach >= np.array([x.least for x in best])):
                    able = bucket.able(items[i], roots, best[i].least)
                    if len(able):
                        weight[items[i]] = weight_of[items[i]]
                        best[i].add(bucket.exact(able, weight), bucket.doc_ids[able])
                        weight[items[i]] = 0
        found = [(i, x) for i, x in enumerate(best) if len(x.ids)]
        if found:
            doc_id = np.concatenate([x.ids for _, x in found])
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(np.repeat([i for i, _ in found], [len(x.ids) for _, x in found]), pa.int32()),
                "doc_id": pa.array(doc_id, pa.int64(), mask=doc_id == NO_ID), "score": pa.array(np.concatenate([x.scores for _, x in found]), pa.int64()),
            })

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def top_documents(docs: DataFrame, benchmark: DataFrame, most: int = MOST, seeds: int = SEEDS, lot_terms: int = LOT_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``most`` best documents with a score above 0.

    Every row of ``docs`` is judged, whole. The documents with the longest
    vectors are searched first; their ``most``-th best score is what an item
    starts from in the search of all others, a lower bound of the final one.
    Tasks give ``most`` rows an item at most, and ranks come from those.

    A null or empty text has no terms; a null doc_id is a document of its own
    and stands before others of its score; repeated rows are ranked each, by
    doc_id, in any order among themselves. Items without terms have no rows,
    repeated and null item_ids are ranked a row of ``benchmark`` each; no
    documents or no items give none; other columns are ignored. doc_ids are
    whole numbers above the least of 64 bits. An index holds ``lot_terms``
    terms; a larger benchmark is searched lot by lot, with the same result,
    since weights and counts are the corpus's.
    """
    spark = docs.sparkSession
    schema = f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for lot in lots(benchmark, lot_terms):
        out = out.unionByName(_of_lot(docs, lot, most, seeds, schema))
    return out


def _of_lot(docs: DataFrame, lot: Lot, most: int, seeds: int, schema: str) -> DataFrame:
    spark = docs.sparkSession
    vectors = written(counted(docs, lot), "term-counts")
    known = weights(vectors, lot)
    ordered = written(by_length(vectors, lot, known), "by-length")
    rows = ordered.count()
    start, cut = np.zeros(len(lot.items), np.int64), float("inf")
    first = None
    if rows > seeds:
        cut = ordered.agg(F.percentile_approx("length", 1 - seeds / rows, 10_000)).first()[0]
        first = written(searched(ordered.where(F.col("length") >= cut), lot, known, most, start), "seeds")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        for r in first.withColumn("rank", place).where(F.col("rank") == most).select("item", "score").toLocalIterator():
            start[r["item"]] = r["score"]
    found = searched(ordered.where(F.col("length") < cut), lot, known, most, start)
    found = written(found.unionByName(first) if first is not None else found, "found")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    ids = spark.createDataFrame(list(enumerate(lot.item_ids)), f"item int, {schema.split(',')[0]}")
    ranked = found.withColumn("rank", place).where(F.col("rank") <= most).join(F.broadcast(ids), "item")
    return ranked.select("item_id", "rank", "doc_id", "score")
