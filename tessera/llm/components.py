"""Distributed connected components by contraction.

Each round points every node at the smallest of itself and its neighbours, follows the
pointers once more, and contracts the edges; edges within a component vanish, so they get
fewer in every round. Rounds are written to the shared folder. What is left when at most
``local_edges`` edges remain is finished by union-find in one executor task, a fixed bound of
memory at every size. Nothing is collected to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, written

PAIRS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", local_edges: int = 2_000_000) -> DataFrame:
    """(node, component) for every node of an edge between two nodes: the smallest node that edges reach from it."""
    edges = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a < b").distinct()
    edges = written(edges, "edges")
    pointers: list[DataFrame] = []
    while edges.count() > local_edges:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        least = written(least, "least")
        second = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        point = written(least.join(second, "to").select("node", F.col("further").alias("to")), "pointers")
        pointers.append(point)
        for end in ("a", "b"):
            edges = edges.join(point.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = edges.coalesce(1).mapInArrow(_finish, "node long, component long")
    for point in reversed(pointers):
        # nodes of this round: where they point, and on from there
        on = labels.select(F.col("node").alias("to"), "component")
        labels = point.join(on, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return labels


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    a, b = numbers[: len(a)], numbers[len(a) :]
    while True:  # pointer jumping; nodes are numbered in order, so the smallest number is the smallest node
        low = np.minimum(parent[a], parent[b])
        new = parent.copy()
        np.minimum.at(new, parent[a], low)
        np.minimum.at(new, parent[b], low)
        new = np.minimum(new, parent)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, parent):
            break
        parent = new
    for k in range(0, len(nodes), 65536):
        yield batch(PAIRS, node=nodes[k : k + 65536], component=nodes[parent[k : k + 65536]])
