"""Weighted hierarchies: every node's value from the leaves below it.

Keys may be of any type that can be compared: strings, numbers, structs for several levels of equal number, or arrays where
the number of levels varies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalith.functions.grid import valid
from zonalith.operators.reduce import HOW
from zonalith.plans.store import written

#: Edges, and pairs of a leaf and a node above it, up to which a tree is composed on the driver; beyond, in the cluster.
DRIVER_EDGES, DRIVER_PAIRS = 100_000, 500_000


@dataclass(frozen=True)
class Tree:
    """rows: node, leaf, weight, depth; a leaf has itself with weight 1 and depth 0, a node the longest way down to a leaf."""

    rows: DataFrame
    how: str

    @classmethod
    def build(cls, edges: DataFrame, how: str = "mean", weighted: bool = True, *, child: str = "child", parent: str = "parent", weight: str = "weight", driver_edges: int = DRIVER_EDGES) -> Tree:
        """From edges(child, parent, weight): weights over those of all siblings for a mean, as they are for a sum.

        Refused: a child with two parents, weights that are not positive and finite, a cycle anywhere, no edges at all.
        """
        _check_how(how)
        if missing := [c for c in (child, parent, *([weight] if weighted else [])) if c not in edges.columns]:
            raise ValueError(f"the edges lack {missing[0]!r}")
        e = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"), (F.col(weight) if weighted else F.lit(1.0)).cast("double").alias("w"))
        head = e.limit(driver_edges + 1).collect()
        rows = _on_driver(e, head, how) if len(head) <= driver_edges else None
        return cls(rows if rows is not None else _in_cluster(e, how), how)

    def leaves(self) -> DataFrame:
        return self.rows.filter(F.col("depth") == 0).select("leaf").distinct()

    def nodes(self) -> DataFrame:
        """node, depth, position: the leaves in the order of their keys, then the nodes above by depth and key."""
        order = [F.col("depth"), F.col("node")]
        found = self.rows.select("node", "depth").distinct().sort(*order)
        schema = T.StructType([*found.schema.fields, T.StructField("position", T.LongType())])
        return found.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(schema)


def _check_how(how: str) -> None:
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}, got {how!r}")


_NO_TREE = "the edges hold a cycle"


def _key(x):
    return tuple(x) if isinstance(x, list) else x


def _on_driver(e: DataFrame, edges: list, how: str) -> DataFrame | None:
    """The rows of a tree of few edges; nothing if its pairs are many."""
    if not edges:
        raise ValueError("there are no edges")
    up = {_key(r["child"]): (_key(r["parent"]), r["w"]) for r in edges}
    if len(up) < len(edges):
        raise ValueError("a child has more than one parent")
    if not all(w is not None and 0 < w < float("inf") for _, w in up.values()):
        raise ValueError("edge weights must be positive and finite")
    if how == "mean":
        total: dict = {}
        for p, w in up.values():
            total[p] = total.get(p, 0.0) + w
        up = {c: (p, w / total[p]) for c, (p, w) in up.items()}
    above: dict = {}  # levels above each node; a walk that comes back to itself is a cycle
    for node in up:
        way = []
        while node in up and node not in above:
            above[node] = None
            way.append(node)
            node = up[node][0]
        if above.get(node, 0) is None:
            raise ValueError(f"{_NO_TREE}: {node!r} is above itself")
        levels = above.get(node, 0)
        for back in reversed(way):
            levels += 1
            above[back] = levels
    parents = {p for p, _ in up.values()}
    leaves = [c for c in up if c not in parents]
    if sum(above[x] + 1 for x in leaves) > DRIVER_PAIRS:
        return None
    pairs, depth = [], {}
    for leaf in leaves:
        node, weight, n = leaf, 1.0, 0
        while True:
            pairs.append((node, leaf, weight))
            depth[node] = max(depth.get(node, 0), n)
            if node not in up:
                break
            node, weight, n = up[node][0], weight * up[node][1], n + 1
    kind = e.schema["child"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("leaf", kind), T.StructField("weight", T.DoubleType()), T.StructField("depth", T.IntegerType())])
    return e.sparkSession.createDataFrame([(n, x, w, depth[n]) for n, x, w in pairs], schema)


def _in_cluster(e: DataFrame, how: str) -> DataFrame:
    """The same by doubling: round k joins ways of 2^k levels, so a tree takes as many rounds as its depth has binary digits."""
    if e.groupBy("child").count().filter("count > 1").limit(1).count():
        raise ValueError("a child has more than one parent")
    if e.filter(~(valid(F.col("w")) & (F.col("w") > 0) & (F.col("w") < float("inf")))).limit(1).count():
        raise ValueError("edge weights must be positive and finite")
    if how == "mean":
        total = e.groupBy(F.col("parent").alias("p")).agg(F.sum("w").alias("t"))
        e = e.join(total, F.col("parent") == F.col("p")).select("child", "parent", (F.col("w") / F.col("t")).alias("w"))
    jump = e = written(e, "tree")
    n_edges, reach = e.count(), 1
    leaves = e.select("child").join(e.select(F.col("parent").alias("p")).distinct(), F.col("child") == F.col("p"), "left_anti")
    pairs = written(leaves.select(F.col("child").alias("node"), F.col("child").alias("leaf"), F.lit(1.0).alias("weight"), F.lit(0).alias("level")), "tree")
    while jump.limit(1).count():
        if reach > n_edges:
            raise ValueError(_NO_TREE)
        on = jump.select(F.col("child").alias("c"), F.col("parent").alias("to"), "w")
        more = pairs.join(on, F.col("node") == F.col("c")).select(F.col("to").alias("node"), "leaf", (F.col("weight") * F.col("w")).alias("weight"), (F.col("level") + F.lit(reach)).cast("int").alias("level"))
        pairs = written(pairs.unionByName(more), "tree")
        jump = written(jump.select("child", "parent", F.col("w").alias("w0")).join(on, F.col("parent") == F.col("c")).select("child", F.col("to").alias("parent"), (F.col("w0") * F.col("w")).alias("w")), "tree")
        reach *= 2
    depth = pairs.groupBy(F.col("node").alias("n")).agg(F.max("level").alias("depth"))
    return pairs.join(depth, F.col("node") == F.col("n")).select("node", "leaf", "weight", "depth")


def missing_leaves(reduced: DataFrame, tree: Tree, key: str = "geom_key") -> DataFrame:
    return tree.leaves().join(reduced.select(F.col(key).alias("leaf")).distinct(), "leaf", "left_anti")


def aggregate(reduced: DataFrame, tree: Tree, batch: list[str], values: list[str], key: str = "geom_key", check: bool = True) -> DataFrame:
    """batch, node and values for all leaves and inner nodes.

    Weights are composed down to the leaves first: a mean over the leaves with a value renormalises once, not level by
    level, and is null without any; a sum takes null and NaN as 0.  Keys that are no leaves are dropped.
    """
    if taken := [c for c in (*batch, *values) if c.startswith("_z_")]:
        raise ValueError(f"{taken[0]!r} is a reserved name")
    if check and (lost := [r[0] for r in missing_leaves(reduced, tree, key).sort("leaf").limit(5).collect()]):
        raise ValueError(f"no values for leaves {lost!r}")
    side = tree.rows.select(F.col("node").alias("_z_node"), F.col("leaf").alias("_z_leaf"), F.col("weight").alias("_z_w"))
    met = reduced.select(*batch, *values, F.col(key).alias("_z_key")).join(side, F.col("_z_key") == F.col("_z_leaf"))
    aggs = []
    for i, v in enumerate(values):
        on = valid(F.col(v))
        num, den = F.sum(F.when(on, F.col("_z_w") * F.col(v)).otherwise(0.0)), F.sum(F.when(on, F.col("_z_w")).otherwise(0.0))
        aggs.append((num if tree.how == "sum" else F.when(den > 0, num / den)).alias(f"_z_v{i}"))
    return met.groupBy(*batch, F.col("_z_node").alias("node")).agg(*aggs).withColumnsRenamed({f"_z_v{i}": v for i, v in enumerate(values)})


def roll_up(reduced: DataFrame, edges: DataFrame, batch: list[str], values: list[str], *, how: str = "mean", weighted: bool = True, key: str = "geom_key", **columns: str) -> DataFrame:
    """Build the tree and aggregate in one call; the nodes come in a column named as the leaves' keys."""
    return aggregate(reduced, Tree.build(edges, how, weighted, **columns), batch, values, key).withColumnRenamed("node", key)


def levels(df: DataFrame, node: str, names: list[str]) -> DataFrame:
    """The levels of a struct key as columns of their own, in place of it."""
    fields = [f.name for f in df.schema[node].dataType]
    if len(fields) != len(names):
        raise ValueError(f"{node!r} has {len(fields)} levels, not {len(names)}")
    return df.select(*[c for c in df.columns if c != node], *[F.col(f"{node}.`{f}`").alias(n) for f, n in zip(fields, names, strict=True)])
