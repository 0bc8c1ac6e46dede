"""Connected components by contraction with minimum labels and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume.llm.scratch import Scratch


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges that make a spanning forest, in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def connected_components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the component's smallest node.

    Each round points every node at its smallest neighbour, jumps pointers twice, and
    moves the edges to what their ends point at; equal and closed edges go. The edges
    left shrink by a factor every round, a long chain's by four. Minima combine before
    the shuffle, and every join is between two written tables, so a hot node is split at
    run time. No edges give no rows. ``edges`` must be a written table.
    """
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "up")
        for _ in range(2):
            ahead = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = scratch.table(up.join(ahead, "up", "left").select("node", F.coalesce("next", "up").alias("up")), "up")
        if labels is None:
            labels = scratch.table(up.select("node", F.col("up").alias("label")), "labels")
        else:
            moved = up.select(F.col("node").alias("label"), F.col("up").alias("to"))
            labels = scratch.table(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = scratch.table(moved, "left_edges")
        if edges.isEmpty():
            scratch.drop("up", "left_edges")
            return labels
