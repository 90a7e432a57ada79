"""Connected components of a graph given as links, by large-star and small-star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalith.llm.common import discard, written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of n nodes by the links a[i] - b[i], within one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour v of u (larger ones, or smaller ones and u itself) with the smallest node around u."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Spark adds up minima before the shuffle and splits a hub's rows in the join.
    low = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("u", "m").alias("m"))
    joined = around.join(low, F.col("a") == F.col("u"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*")
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for each node of links(a, b): root is the smallest node reachable.  Nodes without a link have no row.

    Links may be repeated, run either way, or join a node to itself; none gives no rows.  Every round is a written table,
    so lost executors cost one round at most; the number of rounds grows with the logarithm of the largest component.
    """
    now = written(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        after_large = written(_star(now, True), "links")
        after = written(_star(after_large, False), "links")
        discard(now)
        discard(after_large)
        now = after
        new = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
