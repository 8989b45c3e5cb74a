"""Connected components of a graph given as an edge table, in rounds of large-star and small-star joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes as the pairs (a, b) but number fewer than the nodes: (node, smallest node of its part)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b): the smallest node it is connected to.

    Each round points nodes at the smallest neighbour of their neighbours, so the number of rounds grows with the
    logarithm of a component's width. A hub's edges are grouped by partial minima and joined (adaptive execution
    splits its partition), never gathered in one row. Each round is cut through the shared checkpoint folder.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        found = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(found) == mark or not found[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())
        mark = tuple(found)
        both = state.union(state.select("v", "u"))
        lows = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u"), F.least("u", "w").alias("w"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(lows, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).union(lows.select("u", "w")).distinct()
        state = cut(small)
