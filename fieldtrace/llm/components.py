"""Connected components of an edge table, as Spark joins; nothing but a count of changes reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of ``edges`` (a, b); the label is the smallest node reachable.

    Each round hangs every node on its smallest neighbour, follows these to their roots and contracts the edges to edges between roots.
    So an edge is joined once and not in every round; what is left are the few edges between roots. The number of joins
    of a round grows with the logarithm of a chain's length. A node with very many edges is pre-aggregated in the map tasks.
    """
    left = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "roots")
        while True:
            far = roots.select(F.col("node").alias("label"), F.col("label").alias("far"))
            after = stage(roots.join(far, "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")), "roots")
            roots = after.select("node", "label")
            if after.where(F.col("old") != F.col("label")).isEmpty():
                break
        if labels is None:
            labels = roots
        else:
            labels = stage(labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
                           .select("node", F.coalesce("root", "label").alias("label")), "labels")
        ends = left.join(roots.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(roots.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        left = stage(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels


def fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (places of roots, each root its own) after the links ``a[i] - b[i]``: the larger root hangs on the smaller, then paths are cut short."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
