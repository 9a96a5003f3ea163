"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over word and
word-beginning features. Each later model also gets the earlier categories'
probabilities; it is trained on out-of-fold ones, so that it sees them as
uncertain as they will be on new texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import keep_rows, labelled_sample, map_texts, written

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features, next to whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Labelled rows that models are fitted on at most, those with the least hash of doc_id.
MAX_LABELLED = 12_000
#: Features kept for each category, those that set its labels apart best.
FEATURES = 400
FOLDS = 3
#: Texts that a feature must be in at least.
LEAST_TEXTS = 4


def word_features(word: str) -> list[str]:
    """The word, closed, and its beginnings, open."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def _counted(text: str) -> tuple[Counter, int]:
    words = WORD.findall(text.lower())
    return Counter(words), len(words)


class Vectors:
    """Values of chosen features in texts: square roots of their share of the words."""

    def __init__(self, features: Sequence[str]):
        self.at = {f: i for i, f in enumerate(features)}
        self.of: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        counts, n = _counted(text)
        out = np.zeros(len(self.at))
        if len(self.of) > 300_000:  # words already looked up; emptied to bound memory
            self.of.clear()
        for w, c in counts.items():
            ids = self.of.get(w)
            if ids is None:
                ids = self.of[w] = tuple(self.at[f] for f in word_features(w) if f in self.at)
            for i in ids:
                out[i] += c
        return np.sqrt(out / max(n, 1))


@dataclass
class Chain:
    """A fitted chain: linear weights by category, in order."""

    categories: list[str]
    features: list[str]
    weights: list[np.ndarray] = field(default_factory=list)  # features, then earlier categories' probabilities
    intercepts: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row a text; later models see the earlier columns."""
        out = np.zeros((len(x), len(self.categories)))
        for j, (w, b) in enumerate(zip(self.weights, self.intercepts, strict=True)):
            out[:, j] = 1 / (1 + np.exp(-np.clip(np.hstack([x, out[:, :j]]) @ w + b, -40, 40)))
        return out


def _feature_counts(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``feature, n`` and the texts of each category with it."""
    names = ["feature", "n", *categories]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        flush = lambda: pd.DataFrame([[f, *v] for f, v in seen.items()], columns=names)
        for b in batches:
            labels = b[list(categories)].to_numpy(np.int64)
            for text, y in zip(b["text"], labels, strict=True):
                add = np.concatenate([[1], y])
                for f in {f for w in _counted(text)[0] for f in word_features(w)}:
                    if f in seen:
                        seen[f] += add
                    else:
                        seen[f] = add.copy()
                if len(seen) > 300_000:
                    yield flush()
                    seen.clear()
        yield flush()

    counts = rows.select("text", *categories).mapInPandas(run, "feature string, " + ", ".join(f"{c} long" for c in names[1:]))
    return counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names[1:]]).where(F.col("n") >= LEAST_TEXTS)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_labelled: int = MAX_LABELLED, features: int = FEATURES) -> Chain:
    """Fit on ``docs(doc_id, text)`` by ``labels(doc_id, <category 0/1>...)``; rows without all labels are left out.

    With no rows, or one value of a category, that category's model is a
    constant. Texts may be null (no words). Categories may have any names.
    Only feature tables of fixed size and model weights reach the driver.
    """
    inner = [f"label_{i}" for i in range(len(categories))]
    marked = labels.select("doc_id", *[F.col(c).cast("int").alias(i) for c, i in zip(categories, inner, strict=True)]).dropna(subset=inner)
    rows = written(labelled_sample(docs, marked, max_labelled), "labelled")
    counts = written(_feature_counts(rows, inner), "features")
    totals = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in inner]).first()
    chosen: dict[str, None] = {}
    for c in inner:
        pos, n = totals[c], totals["n"]
        expected = F.col("n") * (pos / max(n, 1))
        spread = F.sqrt(expected * (1 - pos / max(n, 1)) * (1 - F.col("n") / (n + 1)) + 0.5)
        best = counts.orderBy(F.desc(F.abs(F.col(c) - expected) / spread), "feature").limit(features)
        chosen |= dict.fromkeys(r.feature for r in best.select("feature").collect())
    chain = Chain(list(categories), list(chosen))
    if not totals["n"]:
        return Chain(list(categories), [], [np.zeros(j) for j in range(len(categories))], [-20.0] * len(categories), [0.5] * len(categories))

    def make() -> Callable[[list[str]], dict]:
        vectors = Vectors(list(chosen))

        def columns(texts: list[str]) -> dict:
            found = [vectors(t) for t in texts]
            return {"at": [np.flatnonzero(v).astype(np.int32) for v in found], "value": [v[v > 0].astype(np.float32) for v in found]}

        return columns

    # only values that are not 0 reach the driver: max_labelled x features at most
    table = map_texts(rows, make, {"at": "array<int>", "value": "array<float>"}).orderBy("h", "doc_id").toPandas()
    x, folds = np.zeros((len(table), len(chosen)), np.float32), (table["h"].to_numpy() >> 7) % FOLDS
    for i, (at, value) in enumerate(zip(table["at"], table["value"], strict=True)):
        x[i, at] = value
    for c in inner:
        y = table[c].to_numpy(np.float32)
        held = np.zeros(len(y), np.float32)
        for k in range(FOLDS):
            w, b = fit_logistic(x[folds != k], y[folds != k])
            held[folds == k] = 1 / (1 + np.exp(-np.clip(x[folds == k] @ w + b, -40, 40)))
        w, b = fit_logistic(x, y)
        chain.weights.append(w)
        chain.intercepts.append(b)
        chain.thresholds.append(best_threshold(held, y))
        x = np.hstack([x, held[:, None].astype(np.float32)])  # out-of-fold, for the models to come
    return chain


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on columns scaled to unit deviation, by L-BFGS; one label alone gives a constant."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 20.0 if len(y) and y[0] else -20.0
    scale = (1 / np.maximum(x.std(0), 1e-4)).astype(np.float32)
    z = x * scale

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        m = z @ p[:-1].astype(np.float32) + p[-1]
        e = 1 / (1 + np.exp(-np.clip(m, -40, 40))) - y
        value = float(np.logaddexp(0, m).mean() - (y * m).mean() + ridge / 2 * (p[:-1] @ p[:-1]))
        return value, np.append(z.T @ e.astype(np.float32) / len(y) + ridge * p[:-1], e.mean()).astype(np.float64)

    p = np.zeros(x.shape[1] + 1)
    value, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, stack = g.copy(), []
        for s, t in reversed(past):
            a = (s @ d) / (s @ t)
            d -= a * t
            stack.append(a)
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, t), a in zip(past, reversed(stack), strict=True):
            d += s * (a - (t @ d) / (s @ t))
        step = 1.0
        while step > 1e-6:
            new, h = loss(p - step * d)
            if new <= value - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, t = -step * d, h - g
        done = value - new < 1e-7
        p, value, g = p + s, new, h
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t)]
        if done:
            break
    return (p[:-1] * scale).astype(np.float64), float(p[-1])


def best_threshold(p: np.ndarray, y: np.ndarray, steps: int = 50) -> float:
    """The probability, in ``steps`` steps, at which F1 is highest, between 0.1 and 0.9."""
    f1 = [(2 * y[p >= k / steps].sum() / max((p >= k / steps).sum() + y.sum(), 1), k / steps) for k in range(steps // 10, steps - steps // 10 + 1)]
    return max(f1)[1]


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` for each category and ``is_<category>`` booleans.

    Whole texts are scored; a null or wordless text has no feature and gets
    the intercepts' probabilities. Rows that repeat are scored repeatedly.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # categories x features numbers

    def make() -> Callable[[list[str]], dict]:
        model = shared.value
        vectors = Vectors(model.features)

        def columns(texts: list[str]) -> dict:
            p = model.probabilities(np.array([vectors(t) for t in texts]).reshape(len(texts), -1))
            pairs = enumerate(zip(model.categories, model.thresholds, strict=True))
            return {k: v for j, (c, at) in pairs for k, v in ((f"p_{c}", p[:, j]), (f"is_{c}", p[:, j] >= at))}

        return columns

    return map_texts(docs.select("doc_id", "text"), make, {k: v for c in chain.categories for k, v in ((f"p_{c}", "double"), (f"is_{c}", "boolean"))})


def without(docs: DataFrame, chain: Chain, category: str) -> DataFrame:
    """The rows of ``docs``, all columns, that are not of ``category``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    j = chain.categories.index(category)

    def make() -> Callable[[list[str]], list[bool]]:
        model = shared.value
        vectors = Vectors(model.features)
        return lambda texts: (model.probabilities(np.array([vectors(t) for t in texts]).reshape(len(texts), -1))[:, j] < model.thresholds[j]).tolist()

    return keep_rows(docs, make)
