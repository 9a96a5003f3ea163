"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it can reach.

    Each round lowers a node's label to the least label next to it, takes the
    least of those over each tree (all nodes with one label), and follows the
    trees' own links twice. Trees at least halve each round, so the rounds grow
    with the logarithm of the longest chain. Labels are written to the shared
    folder every round; nothing but one count a round reaches the driver.

    Rows with a null end are left out; repeated rows and loops do no harm; an
    empty table gives an empty result. Returns ``node, label``.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = written(edges.union(edges.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = written(labels.select("node", F.least("node", "least").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.coalesce(F.least("label", "near"), "label").alias("low"))
        trees = written(lowered.groupBy("label").agg(F.min("low").alias("low")), "trees")
        if trees.where("label <> low").isEmpty():
            return labels
        for _ in range(2):
            step = trees.select(F.col("label").alias("low"), F.col("low").alias("lower"))
            trees = trees.join(step, "low", "left").select("label", F.coalesce("lower", "low").alias("low"))
        trees = written(trees, "trees")
        labels = written(labels.join(trees, "label", "left").select("node", F.coalesce("low", "label").alias("label")), "labels")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
