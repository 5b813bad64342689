"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b), both long; root is the smallest reachable node.

    Alternates the two star operations: each node links its larger neighbours to its smallest one,
    then its smaller ones and itself. Both keep the components and at most the number of edges, and
    a few rounds (logarithmic in the longest chain) end in stars. Neighbours are reduced with
    ``min`` before they move, and the rounds join edges with one row per node, so a node with a
    third of all edges is a skewed join side that adaptive execution splits, never one value.
    Edges with a null end are no edges.
    """
    edges = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                   .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(lowest, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(lowest.select("a", F.col("m").alias("b"))).distinct())
        edges = stored(small, "edges")
        # Stars that no longer change: same number of edges and same sum of their ends.
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component, for links that are in one task's memory.

    As many edges as nodes replace any number of links between them; components stay the same.
    """
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = flat[:len(a)], flat[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        # The labels' own labels are lowered too, so chains shrink by half and more in each turn.
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    more = label != np.arange(len(nodes))
    return nodes[more], nodes[label[more]]
