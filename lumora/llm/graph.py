"""Connected components of an edge table by hooking and pointer jumping, in DataFrame operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable from it.

    Each round hooks every root to its smallest neighbour, halves the paths until they are stars, and contracts
    the edges; edges inside a component vanish, so the tables shrink. Every round ends in a checkpoint. A null end
    is dropped, repeated edges and loops have no effect, no edges give an empty table.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    roots = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not live.isEmpty():
        up = live.select(F.col("b").alias("node"), F.col("a").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        up = cut(up)
        while True:
            above = up.select(F.col("node").alias("to"), F.col("to").alias("top"))
            jumped = cut(up.join(above, "to", "left").select("node", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")))
            up = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        roots = cut(roots.join(up.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for end in ("a", "b"):
            live = live.join(up.select(F.col("node").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        live = cut(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots


def lowest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes the lowest that the links (a, b) lead to."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        np.minimum.at(low, x, y)
        np.minimum.at(low, y, x)
        while (low[low] != low).any():
            low = low[low]
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    return low
