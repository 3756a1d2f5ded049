"""Connected components as DataFrame joins; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()


def components(edges: DataFrame, store=stored) -> DataFrame:
    """(a, b): each node of the links a - b (longs) that isn't the least of its component, with that least node.

    Alternates large stars (greater neighbours move to a node's least neighbour)
    and small stars (lesser neighbours do) until nothing moves, which takes a
    number of rounds in the order of the logarithm of the size. Loops and links
    with a null end are ignored. store: what keeps the result.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
        mark = _mark(now)
        while mark[0]:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            small = large.groupBy("a").agg(F.min("b").alias("m"))
            moved = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = scratch.store(moved.unionByName(small.withColumnRenamed("m", "b")).distinct(), "components")
            before, mark = mark, _mark(now)
            if tuple(before) == tuple(mark):
                break
        return store(now, "components")


def local_roots(n: int, a, b):
    """For nodes 0..n-1 with links a - b (index arrays), the least node of each one's component."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        if (before == root).all():
            return root
