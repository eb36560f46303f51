"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import materialize

#: Edges that one task joins by union-find (some 50 MB); more edges take rounds over the cluster, with the same result.
ONE_TASK_EDGES = 300_000


def _union_find(edges: DataFrame) -> DataFrame:
    """``node, root`` by one task; the caller has checked the number of edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        kinds = batch.schema.types if parent else (pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kinds[0]), pa.array([find(x) for x in list(parent)], kinds[0])], names=["node", "root"])

    kind = edges.schema["a"].dataType.simpleString()
    return materialize(edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}"))


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b``, written already): the root is the component's smallest node.

    Least-neighbour labels with pointer jumping: a chain of n edges takes about log n rounds. Sums are per node and combined before the
    shuffle, so a node with very many edges is no hot group.
    """
    if edges.count() <= one_task_edges:
        return _union_find(edges.select("a", "b"))
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other").distinct())
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = materialize(lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        labels = new.select("node", "root")
        if not new.where("old <> root").limit(1).count():
            return labels
