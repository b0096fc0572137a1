"""Connected components of a large edge list."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def forest(batches):
    """Union-find over a partition's edges: each node but the roots, with its root."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    rows = [(x, root(x)) for x in up]
    rows = [(x, r) for x, r in rows if x != r]
    yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node.

    Each round joins the edges of a partition in a union-find, hooks every node
    to its smallest neighbour, lets pointers jump to the roots, and contracts
    the edges to edges between roots.  Edges at a common node are combined
    before they are shuffled.  Rounds: logarithmic in the number of nodes.
    """
    ints = "a long, b long"
    left = C.materialised(edges.select("a", "b").filter("a <> b").mapInPandas(forest, ints).distinct())
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        up = jump(C.materialised(up))
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("b").alias("root"))
        else:
            labels = labels.join(up, labels["root"] == up["a"], "left").select(
                "node", F.coalesce("b", "root").alias("root"))
        labels = C.materialised(labels)
        one = up.select(F.col("a").alias("_a"), F.col("b").alias("x"))
        two = up.select(F.col("a").alias("_b"), F.col("b").alias("y"))
        left = (left.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
                .filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
        left = C.materialised(left.mapInPandas(forest, ints).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels


def jump(up: DataFrame) -> DataFrame:
    """Each node's pointer replaced by the root it leads to; reach doubles each round."""
    while True:
        to = up.select(F.col("a").alias("_a"), F.col("b").alias("c"))
        up = C.materialised(up.join(to, F.col("b") == F.col("_a"), "left").select(
            "a", F.coalesce("c", "b").alias("b"), (F.coalesce("c", "b") != F.col("b")).alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("a", "b")
        up = up.select("a", "b")
