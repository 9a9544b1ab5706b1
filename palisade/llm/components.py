"""Connected components of a link table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import scratch, staged

#: Links that one task may hold: some tens of MB.
ONE_TASK = 300_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``, label the least node of its component.

    Up to :data:`ONE_TASK` links are united by one task; beyond that, each round hooks a node to its least neighbour, shortens the paths once and contracts the links; links
    inside a component vanish. Both sides of every join are written tables, so a hub's rows can be split."""
    with scratch(links.sparkSession) as keep:
        found = staged(links.where("a <> b").select("a", "b"), "links")
        if found.limit(ONE_TASK + 1).count() <= ONE_TASK:
            return keep(staged(found.coalesce(1).mapInArrow(_united, "node long, label long"), "labels"))
        return _contracted(found, keep)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links of a task; a root is its component's least node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up] = root.setdefault(up, up)
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "label"])


def _contracted(links: DataFrame, keep) -> DataFrame:
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = staged(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")), "hooks")
        up = hooks.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        hooks = staged(hooks.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("to")), "hooks")
        if labels is None:
            labels = staged(hooks.withColumnRenamed("to", "label"), "labels")
        else:
            moved = hooks.withColumnRenamed("node", "label")
            labels = staged(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = (hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        half = staged(edges.join(a, "a").select("a2", "b"), "edges")
        edges = staged(half.join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if labels is None:
        return keep(staged(edges.select(F.col("a").alias("node"), F.col("b").alias("label")), "labels"))
    return keep(labels)
