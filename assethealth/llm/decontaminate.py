"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND."""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import keep_rows, map_texts, pieces, written

SPACED = bytes(32 if chr(i) in string.punctuation else i for i in range(256))
K1, B = 1.2, 0.75
BLOCK = 4
#: Words of an index entry at most; longer items are indexed in pieces.
PIECE = 96
#: Words of a passage: two of the longest entries, whatever a benchmark's own ones are.
WINDOW = 2 * PIECE
#: Words of test items in one index at most; more are searched in several passes.
INDEX_WORDS = 2_000_000
#: Share of an entry's own score that a passage must reach to be retrieved.
RETRIEVED = 0.65
SHINGLE, OVERLAP = 5, 0.8
#: Changed words that a part of five or more may have in any case, if the whole item keeps ``OVERLAP`` of its words.
CHANGED = 2


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, in UTF-8, between ASCII white space and punctuation."""
    return (text or "").lower().encode().translate(SPACED).split()


def shingle_set(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def shingle_share(part: list[bytes], words: list[bytes]) -> float:
    """Share of a part's five-word shingles in ``words``; a shorter part is one run of its own length."""
    size = min(SHINGLE, len(part))
    own = shingle_set(part, size)
    return len(own & shingle_set(words, size)) / max(1, len(own))


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """A test item's words but those of its last sentence, and those; short ends go to their neighbours, and one sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if words_of(p)]
    while len(parts) > 1 and len(words_of(parts[-1])) < SHINGLE:
        parts[-2:] = [" ".join(parts[-2:])]
    while len(parts) > 1 and len(words_of(parts[0])) < SHINGLE:
        parts[:2] = [" ".join(parts[:2])]
    if len(parts) < 2:
        return words_of(text), words_of(text)
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def edits(part: list[bytes], words: list[bytes]) -> int:
    """Words to change, insert or leave out to find ``part`` somewhere in ``words``, at least (Myers' bit vectors)."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(part):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(part)) - 1, 1 << len(part) - 1
    up, down, now, least = full, 0, len(part), len(part)
    for w in words:
        same = at.get(w, 0)
        flat = (((same & up) + up) ^ up) | same
        more, less = down | full & ~(flat | up), up & flat
        now += 1 if more & top else -1 if less & top else 0
        least = min(least, now)
        more, less, same = more << 1 & full, less << 1 & full, same | down
        up, down = less | full & ~(same | more), more & same
    return least


def held(question: list[bytes], answer: list[bytes], there: list[bytes]) -> float:
    """The lesser share of question and answer in ``there``, 0 if that does not make it a copy.

    Either ``OVERLAP`` of the shingles of both are there, with anything
    between them, or their words are, in order: ``OVERLAP`` of the item's
    and, of each part, the same or all but ``CHANGED``.
    """
    parts = (question, answer)
    share = min(shingle_share(x, there) for x in parts)
    if share >= OVERLAP:
        return share
    count = Counter(there)
    allowed = [max(CHANGED if len(x) >= SHINGLE else 0, int(len(x) * (1 - OVERLAP) + 1e-9)) for x in parts]
    if any(sum((Counter(x) - count).values()) > a for x, a in zip(parts, allowed, strict=True)):
        return 0.0
    off = [edits(x, there) for x in parts]
    if any(o > a for o, a in zip(off, allowed, strict=True)) or sum(off) > (1 - OVERLAP) * sum(map(len, parts)) + 1e-9:
        return 0.0
    return min(1 - o / len(x) for o, x in zip(off, parts, strict=True))


@dataclass
class Lists:
    """Lists of numbers, one after another in one array."""

    begins: np.ndarray
    values: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.begins[i] : self.begins[i + 1]]


@dataclass
class Index:
    """Postings by term: entry numbers, impacts, and the largest impact of each block and of all.

    A block is a run of ``BLOCK`` entries; entries stand by length, so that the
    entries of a block have impacts of one size.

    Impacts are BM25 terms divided by the entry's score for itself, so an
    entry scores 1 for its own text and one threshold serves all. Where a few
    rare words have most of an entry's score, its impacts are raised, so that
    it scores ``RETRIEVED`` without any 1 - ``OVERLAP`` of its words.

    Items go by their place in ``ids`` and ``texts``, so that items without an
    id, or with one id, are told apart.
    """

    terms: dict[bytes, int]
    entries: Lists
    impacts: Lists
    begins: np.ndarray  # where a term's blocks begin in the two below
    blocks: np.ndarray
    bounds: np.ndarray
    most: np.ndarray
    item_of: np.ndarray
    ids: list[object]
    texts: list[str]
    cut: dict[int, tuple[list[bytes], list[bytes]]] = field(default_factory=dict)

    def parts(self, item: int) -> tuple[list[bytes], list[bytes]]:
        """Question and answer of an item, cut when first asked for."""
        if item not in self.cut:
            if len(self.cut) >= 10_000:  # made again when needed; emptied to bound memory
                self.cut.clear()
            self.cut[item] = question_and_answer(self.texts[item])
        return self.cut[item]


def cut_up(text: str | None) -> list[list[bytes]]:
    """Index entries of an item: its words in runs of ``PIECE`` at most."""
    w = words_of(text)
    return [w[at : at + PIECE] for at in range(0, len(w), PIECE)]


@dataclass
class Statistics:
    """What impacts need of a whole benchmark: its entries, their words in all, and how many hold each term."""

    entries: int
    words: int
    df: dict[bytes, int]


def counted(items: list[tuple[object, str | None]]) -> Statistics:
    """The statistics of items that are all of a benchmark."""
    cut = [w for _, t in items for w in cut_up(t)]
    return Statistics(len(cut), sum(map(len, cut)), Counter(t for w in cut for t in set(w)))


def term_table(benchmark: DataFrame) -> DataFrame:
    """``term, entries, words`` of a benchmark of any size: a row a term, and one without a term that holds all entries and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch)):
            found = counted([(None, t) for t in b.column("text").to_pylist()])
            terms, n = list(found.df), list(found.df.values())
            yield pa.RecordBatch.from_pydict({
                "term": pa.array([None, *terms], pa.binary()), "entries": pa.array([found.entries, *n], pa.int64()), "words": pa.array([found.words, *[0] * len(n)], pa.int64()),
            })

    rows = benchmark.select("text").mapInArrow(run, "term binary, entries long, words long")
    return rows.groupBy("term").agg(F.sum("entries").alias("entries"), F.sum("words").alias("words"))


def of_lot(table: DataFrame, items: list[tuple[object, str | None]]) -> Statistics:
    """The whole benchmark's statistics, with frequencies of one lot's terms alone; the table passes the driver a part at a time."""
    own, out = {t for _, x in items for t in words_of(x)}, Statistics(0, 0, {})
    for r in table.toLocalIterator():
        if r["term"] is None:
            out.entries, out.words = r["entries"], r["words"]
        elif bytes(r["term"]) in own:
            out.df[bytes(r["term"])] = r["entries"]
    return out


def build_index(items: list[tuple[object, str | None]], known: Statistics | None = None) -> Index | None:
    """An index of ``items``; ``known`` are the statistics of the benchmark they are part of, if they are not all of it."""
    parts = [(i, w) for i, (_, t) in enumerate(items) for w in cut_up(t)]
    if not parts:
        return None
    parts.sort(key=lambda p: len(p[1]))
    known = known or counted(items)
    df, mean, entries = known.df, known.words / known.entries, known.entries
    terms = {t: i for i, t in enumerate(sorted({t for _, w in parts for t in w}))}
    term_of, impact_of, sizes = [], [], []
    for _, w in parts:
        raw = {t: log(1 + (entries - df[t] + 0.5) / (df[t] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * len(w) / mean)) for t, k in Counter(w).items()}
        own = sum(raw.values())
        least = sum(sorted(raw.values())[: len(raw) - int(len(w) * (1 - OVERLAP) + 1e-9)])
        own = min(own, least / RETRIEVED) if least > 0 else own
        term_of.append(np.fromiter((terms[t] for t in raw), np.int64, len(raw)))
        impact_of.append(np.fromiter(raw.values(), float, len(raw)) / own)
        sizes.append(len(raw))
    term, impact, entry = np.concatenate(term_of), np.concatenate(impact_of), np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    order = np.lexsort((entry, term))
    term, impact, entry = term[order], impact[order], entry[order]
    places = np.searchsorted(term, np.arange(len(terms) + 2))  # the last is for unknown words
    first = np.flatnonzero(np.concatenate([[True], (np.diff(term) > 0) | (np.diff(entry // BLOCK) > 0)]))
    most = np.append(np.maximum.reduceat(impact, places[:-2]), 0.0)
    return Index(
        terms, Lists(places, entry), Lists(places, impact), np.searchsorted(term[first], np.arange(len(terms) + 2)), entry[first] // BLOCK, np.maximum.reduceat(impact, first), most,
        np.array([i for i, _ in parts]), [i for i, _ in items], [t or "" for _, t in items],
    )


def passage_blocks(index: Index, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """``passage, blocks, terms`` of each passage for which some block can hold an entry that scores ``threshold``.

    A passage is a range of ``ids``. The largest impacts of each block, summed
    over a passage's distinct terms, are an upper bound for all its entries.
    """
    terms, number = len(index.terms), len(index.item_of) // BLOCK + 1
    for at in range(0, len(starts), 64):
        s, e = starts[at : at + 64], ends[at : at + 64]
        places = np.repeat(s - np.cumsum(e - s) + (e - s), e - s) + np.arange((e - s).sum())
        pairs = np.unique(np.repeat(np.arange(len(s)), e - s) * (terms + 1) + ids[places])
        pairs = pairs[pairs % (terms + 1) < terms]
        passage, term = np.divmod(pairs, terms + 1)
        first, many = index.begins[term], index.begins[term + 1] - index.begins[term]
        places = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        bounds = np.bincount(np.repeat(passage, many) * number + index.blocks[places], index.bounds[places])
        hits, blocks = np.divmod(np.flatnonzero(bounds >= threshold - 1e-9), number)
        for p in np.unique(hits).tolist():
            yield at + p, blocks[hits == p].tolist(), term[np.searchsorted(passage, p) : np.searchsorted(passage, p, "right")]


def search(index: Index, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All entries that score ``threshold`` or more for the query's terms, by block-max WAND."""
    passages = passage_blocks(index, query, np.array([0]), np.array([len(query)]), threshold) if len(query) else []
    return [hit for _, blocks, terms in passages for hit in wand(index, terms.tolist(), threshold - 1e-9, blocks)]


def wand(index: Index, query: list[int], threshold: float, able: list[int]) -> list[tuple[int, float]]:
    """Entries that score ``threshold`` or more, by block-max WAND over the terms' whole lists.

    Cursors stand in the order of their entries. The pivot is the first at
    which the terms' largest impacts reach the threshold; no entry before it
    can score enough. If the pivot's block is not one of ``able``, whose block
    maxima reach the threshold, all cursors up to it jump to the next that is;
    else they meet at the pivot, which is scored.
    """
    none = len(index.item_of)
    lists = {t: index.entries[t] for t in query}
    cursors = [[int(lists[t][0]), 0, t, float(index.most[t])] for t in query if len(lists[t])]
    found, goes = [], set(able)
    while cursors:
        cursors.sort()
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[3]
            if total >= threshold:
                pivot = i
                break
        if pivot < 0:
            break
        target = cursors[pivot][0]
        if target // BLOCK not in goes:
            k = bisect_left(able, target // BLOCK)
            target = able[k] * BLOCK if k < len(able) else none
        elif cursors[0][0] == target:
            score = sum(float(index.impacts[t][at]) for e, at, t, _ in cursors if e == target)
            if score >= threshold:
                found.append((target, score))
            target += 1
        for c in cursors:
            if c[0] < target:
                c[1] += int(np.searchsorted(lists[c[2]][c[1] :], target))
                c[0] = int(lists[c[2]][c[1]]) if c[1] < len(lists[c[2]]) else none
        cursors = [c for c in cursors if c[0] < none]
    return found


def contained(index: Index, text: str) -> dict[int, float]:
    """Test items (places in the index) that the text holds, each with the lesser share of its question and answer that is there (``held``).

    Passages of ``WINDOW`` words, each half over the last, cover every place an
    entry could stand, and an item whose question and answer lie apart, if
    together they span half a window. A passage is searched only if the sum of its
    terms' largest impacts can reach the threshold at all.
    """
    words = words_of(text)
    ids = np.fromiter(map(index.terms.get, words, repeat(len(index.terms))), np.int64, len(words))
    half, out = WINDOW // 2, {}
    sums = np.concatenate([[0.0], np.cumsum(index.most[ids])])
    starts = np.arange(0, max(1, len(words) - half + 1), half) if len(words) else np.array([], int)
    ends = np.minimum(starts + WINDOW, len(words))
    able = sums[ends] - sums[starts] >= RETRIEVED
    starts, ends = starts[able], ends[able]
    for p, blocks, terms in passage_blocks(index, ids, starts, ends, RETRIEVED):
        for n, _ in wand(index, terms.tolist(), RETRIEVED - 1e-9, blocks):
            item = int(index.item_of[n])
            if item in out:
                continue
            question, answer = index.parts(item)
            reach = max(WINDOW, 2 * (len(question) + len(answer)))
            share = held(question, answer, words[max(0, starts[p] - reach) : ends[p] + reach])
            if share:
                out[item] = share
    return out


def index_lots(benchmark: DataFrame, index_words: int = INDEX_WORDS) -> Iterator[Index]:
    """Indexes of the items, ``index_words`` words at most in each, whatever the benchmark's size.

    Impacts rest on the statistics of the whole benchmark and passages have
    one length, so what is found does not depend on how it is cut.
    """
    table = written(term_table(benchmark), "benchmark-terms")
    lot: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        words = len(words_of(r["text"]))
        if lot and size + words > index_words:
            yield build_index(lot, of_lot(table, lot))
            lot, size = [], 0
        if words:
            lot.append((r["item_id"], r["text"]))
            size += words
    if lot:
        yield build_index(lot, of_lot(table, lot))


def find_contamination(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """``doc_id, items, overlap`` for each row: test items in the text, each item_id once, and the largest overlap (0 if none).

    Every passage of every whole text is a query. An item counts if the text
    around the passage holds both its question and its answer, or nearly so
    (``held``). The index is sent to executors only in lots of
    ``index_words`` words; a larger benchmark is searched lot by lot, each in a
    pass over the documents, and the findings are put together in the row.

    item_ids are of any type. An item without an id is found like any other
    and listed as null; of two items with one id each is looked for. Null and
    empty texts hold nothing; items without words (null, empty, punctuation
    alone) are never found, and such lines of an item are passed over; an
    empty benchmark finds nothing; repeated rows are searched repeatedly;
    columns of other names are ignored.
    """
    kind = f"array<struct<item:{benchmark.schema['item_id'].dataType.simpleString()},share:double>>"
    rows = docs.select("doc_id", "text", F.array().cast(kind).alias("found"))
    for index in index_lots(benchmark, index_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared) -> Callable[[list[str]], dict]:  # noqa: ANN001
            index = shared.value
            return lambda texts: {"new": [[{"item": index.ids[i], "share": s} for i, s in sorted(contained(index, t).items())] for t in texts]}

        rows = map_texts(rows.withColumn("body", F.col("text")), make, {"new": kind})
        rows = rows.select("doc_id", F.col("body").alias("text"), F.concat("found", "new").alias("found"))
    items = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item"])))
    return rows.select("doc_id", items.alias("items"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("overlap"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item; rows are judged in place, without a join.

    Null, empty and repeated rows are as in ``find_contamination``: the first
    two stay, the last are judged each. An empty table gives none.
    """
    for index in index_lots(benchmark, index_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared) -> Callable[[list[str]], list[bool]]:  # noqa: ANN001
            return lambda texts: [not contained(shared.value, t) for t in texts]

        docs = keep_rows(docs, make)
    return docs
