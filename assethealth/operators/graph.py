"""Connected components of a table of edges, in few rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assethealth.sources.scratch import kept, scratch


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the least node that these edges join it to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            p, q = root(x), root(y)
            parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "label": pa.array(map(root, nodes), pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges(a, b)``: the least node of its component.

    Tasks join what their own edges join, so a chain of neighbours is one node
    a task after one round. What different tasks say of one node are the edges
    of the next round; those are among the roots alone. The round that leaves
    no edge is the last. Memory is that of a task's edges.
    """
    folder, turn = scratch(edges.sparkSession, "components"), 0
    labels = None
    while True:
        spread = edges.repartitionByRange("a", "b")
        found = kept(spread.mapInArrow(_roots, "node long, label long"), f"{folder}/roots-{turn}")
        least = kept(found.groupBy("node").agg(F.min("label").alias("label")), f"{folder}/least-{turn}")
        if labels is None:
            labels = least
        else:
            now = least.select(F.col("node").alias("label"), F.col("label").alias("lower"))
            labels = labels.join(now, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
        open_ = found.join(least.withColumnRenamed("label", "a"), "node").where("label <> a").select("a", F.col("label").alias("b")).distinct()
        edges = kept(open_, f"{folder}/edges-{turn}")
        if edges.isEmpty():
            return labels
        turn += 1
