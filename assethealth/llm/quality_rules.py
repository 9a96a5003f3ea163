"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on the statistics of labelled texts; every path from a root
becomes a conjunctive rule. A lasso logistic fit keeps few of the rules and
weighs them, and those are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import labelled_sample, text_or_empty, written

#: Labelled rows that rules are fitted on at most, those with the least hash of doc_id.
MAX_LABELLED = 50_000
TREES, DEPTH, LASSO = 20, 3, 0.002


SYMBOLS = "#$%&*|"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, each a number and defined for the empty text.

    Characters are counted by how much shorter a text is without them: plain
    replacement and one scan over runs cost far less than counting matches.
    """
    words, lines = F.split(text, r"[\x20\x09-\x0D]+"), F.split(text, "\n")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text)
    without = lambda ch: chars - F.length(F.replace(text, F.lit(ch), F.lit("")))
    symbols = without(SYMBOLS[0])
    for ch in SYMBOLS[1:]:
        symbols = symbols + without(ch)
    some = F.greatest(chars, F.lit(1))
    return {
        "n_chars": F.log1p(chars.cast("double")),
        "n_words": F.log1p(n.cast("double")),
        "word_length": (chars - n + 1) / n,
        "capitals": F.length(F.regexp_replace(text, "[^A-ZÀ-ÖØ-Þ]+", "")) / some,
        "symbols": symbols / some,
        "exclaiming": without("!") / some,
        "distinct_words": distinct / F.sqrt(n),
        "distinct_share": distinct / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_a_line": F.log1p(n / F.size(lines)),
    }


STATISTICS = [
    "n_chars", "n_words", "word_length", "capitals", "symbols", "exclaiming", "distinct_words", "distinct_share", "distinct_lines", "words_a_line",
]


@dataclass
class RuleModel:
    """Rules as lists of (statistic, is above, threshold), their weights, and the intercept."""

    rules: list[tuple[tuple[str, bool, float], ...]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        terms = [F.when(rule_column(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        total = F.lit(self.intercept)
        for t in terms:
            total = total + t
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def rule_column(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, above, at in rule:
        out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
    return out


def _paths(node: object, names: list[str], path: tuple = ()) -> list[tuple]:
    """Every path of one step or more from a tree's root; ``node`` is a node of a fitted Spark tree."""
    found = [path] if path else []
    if node.getClass().getSimpleName() != "InternalNode":
        return found
    name, at = names[node.split().featureIndex()], float(node.split().threshold())
    return found + _paths(node.leftChild(), names, (*path, (name, False, at))) + _paths(node.rightChild(), names, (*path, (name, True, at)))


def _tidied(path: tuple) -> tuple:
    """A path's conditions, the tightest of each kind, in fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, at in path:
        key = (name, above)
        best[key] = (max if above else min)(best.get(key, at), at)
    return tuple(sorted((n, a, round(t, 6)) for (n, a), t in best.items()))


def fit_rules(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int = MAX_LABELLED) -> RuleModel:
    """Fit on ``docs(doc_id, text)`` by ``labels(doc_id, <label> 0/1)``; null labels and unlabelled rows teach nothing.

    With no rows or one label only, the model is a constant. Trees and lasso
    are MLlib's; the driver holds trees and weights alone.
    """
    marked = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("label"))
    rows = labelled_sample(docs, marked, max_labelled, {k: c.cast("double") for k, c in statistics(F.col("text")).items()})
    table = written(rows.select("label", *STATISTICS), "statistics")
    n, positive = table.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < positive < n:
        return RuleModel([], [], 20.0 if n and positive else (-20.0 if n else 0.0))
    data = VectorAssembler(inputCols=STATISTICS, outputCol="v").transform(table.repartition(8)).select("label", "v", *STATISTICS).persist()
    forest = RandomForestClassifier(featuresCol="v", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=max(2, int(n // 1000)), subsamplingRate=0.7).fit(data)
    paths = {_tidied(p): None for t in forest.trees for p in _paths(t._call_java("rootNode"), STATISTICS)}
    rules = list(paths)
    hits = F.array(*[F.when(rule_column(r), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules])
    fired = data.select("label", array_to_vector(hits).alias("v")).persist()
    lasso = LogisticRegression(featuresCol="v", elasticNetParam=1.0, regParam=LASSO, maxIter=100, standardization=True).fit(fired)
    fired.unpersist()
    data.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``doc_id, score`` of each whole text, by column expressions alone.

    A null text is scored as the empty one; rows that repeat are scored
    repeatedly; other columns are ignored.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    numbers = rows.select("doc_id", *[c.cast("double").alias(k) for k, c in statistics(F.col("text")).items()])
    return numbers.select("doc_id", model.score().alias("score"))
