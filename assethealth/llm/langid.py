"""Language identification by nearest centroid over character n-gram TF-IDF vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import map_texts, written

DIMENSIONS = 4096
#: Centroids of a language.
CLUSTERS = 3
#: Texts of a language that its centroids are clustered from at most, those with the least hash of doc_id.
SAMPLE = 600
#: Share of a language's sample that lies beyond its rejection distance.
REJECTED = 0.002
OTHER = re.compile(r"[\W\d_]+")


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte pairs and triples of the lower-cased text, other characters than letters as one space."""
    b = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode(), np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(b), 1 << 20):  # a long text in pieces that overlap by two
        c = b[max(0, at - 2) : at + (1 << 20)]
        pairs = c[:-1] * np.uint32(257) + c[1:]
        triples = pairs[:-1] * np.uint32(1031) + c[2:] + np.uint32(77777)
        for codes in (pairs, triples):
            out += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def unit_vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.array([np.log1p(ngram_counts(t)) for t in texts], np.float32).reshape(-1, DIMENSIONS) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each dimension, over all of ``docs``, and their number. DIMENSIONS + 1 rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            for t in b["text"]:
                seen[:-1] += ngram_counts(t) > 0
            seen[-1] += len(b)
        yield pd.DataFrame({"at": np.arange(DIMENSIONS + 1), "n": seen})

    rows = docs.select("text").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1)
    for r in rows:
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts are spread out by taking the text farthest from those taken."""
    centres = x[[int(np.argmax(x @ x.mean(0)))]]
    while len(centres) < min(k, len(x)):
        far = int(np.argmin((x @ centres.T).max(1)))
        centres = np.vstack([centres, x[far]])
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, 1)
        sums = np.array([x[near == j].sum(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    vectors: np.ndarray
    reach: np.ndarray  # least cosine of each centroid's language


def sampled(rows: DataFrame, sample: int, most_languages: int | None) -> DataFrame:
    """``lang, h, text`` of about ``sample`` to twice as many texts of each language, or all it has.

    A text is taken if its hash, as a share of all hashes, is below a share
    that the language's number of distinct rows sets, so the sample's size
    does not grow with the table. That number is estimated by a sketch (error
    of 2 %, well below the half that the share has to spare). Rows that repeat
    count once, and meet in a partial aggregate.
    """
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts"), F.count("*").alias("rows"))
    if most_languages is not None:
        counts = counts.orderBy(F.desc("rows"), "lang").limit(most_languages)
    share = (F.col("h").cast("double") / 2.0**64) + 0.5
    some = hashed.withColumn("share", share).join(written(counts.drop("rows"), "languages"), "lang")
    return some.where(F.col("share") <= 1.5 * sample / F.col("texts")).groupBy("lang", "h").agg(F.any_value("text").alias("text"))


def fit_centroids(docs: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, most_languages: int | None = None) -> Centroids:
    """Fit on ``docs(doc_id, text, lang)``; rows with a null lang or without a letter teach nothing.

    Document frequencies come from all rows. Centroids are clustered language
    by language from ``sample`` texts at most each, so a task holds few
    texts, however large the table and whatever its doc_ids (null ones are
    told apart by their texts). Every language is learnt; a model takes 48 KB
    a language, on the driver and on executors. A caller who wants a smaller
    one gives ``most_languages``: those with the most rows. With no rows there
    are no centroids, and every text is ``und``; repeated rows count once in
    the sample and each in the frequencies.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    cut = written(sampled(rows, sample, most_languages), "sample")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h").head(sample)
        x = unit_vectors(list(pdf["text"]), idf)
        centres = spherical_kmeans(x, clusters)
        reach = float(np.quantile((x @ centres.T).max(1), REJECTED))
        centres = centres[np.argsort(centres[:, 0], kind="stable")]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "place": range(len(centres)), "vector": [c.tobytes() for c in centres], "reach": reach})

    made = written(cut.groupBy("lang").applyInPandas(run, "lang string, place int, vector binary, reach double"), "centroids")
    got = list(made.orderBy("lang", "place").toLocalIterator())
    vectors = np.array([np.frombuffer(r["vector"], np.float32) for r in got], np.float32).reshape(-1, DIMENSIONS)
    return Centroids(idf, [r["lang"] for r in got], vectors, np.array([r["reach"] for r in got]))


def predict_language(docs: DataFrame, model: Centroids) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of each whole text.

    ``lang_pred`` is the language of the nearest centroid by cosine, ``score``
    that cosine; ``und`` with score 0 if the text is null or has no letter.
    ``rejected`` marks texts farther from it than nearly all of the language's
    own sample: a caller who would rather have no answer takes them as ``und``.
    Rows that repeat are judged repeatedly; an empty table gives none; a
    doc_id may be null or repeated; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 48 KB a language

    def make() -> Callable[[list[str]], dict]:
        m = shared.value

        def columns(all_texts: list[str]) -> dict:
            out: dict = {"lang_pred": [], "score": [], "rejected": []}
            for at in range(0, len(all_texts), 256):
                texts = all_texts[at : at + 256]
                x = unit_vectors(texts, m.idf) @ m.vectors.T if len(m.langs) else np.zeros((len(texts), 1))
                for t, row in zip(texts, x, strict=True):
                    best = int(np.argmax(row))
                    known = len(m.langs) > 0 and any(map(str.isalpha, t))
                    score = float(min(max(row[best], 0.0), 1.0)) if known else 0.0
                    out["lang_pred"].append(m.langs[best] if known else "und")
                    out["score"].append(score)
                    out["rejected"].append(not known or score < m.reach[best])
            return out

        return columns

    return map_texts(docs.select("doc_id", "text"), make, {"lang_pred": "string", "score": "double", "rejected": "boolean"})
