"""A store of built operators under a digest of what they were built from, and written intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalith.functions.grid import Grid

if TYPE_CHECKING:
    from zonalith.operators.resample import Resampler
    from zonalith.operators.stencil import Stencil
    from zonalith.operators.tree import Tree

VERSION = 1
KINDS = ("stencil", "resampler", "tree", "operator")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="zonalith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest(*parts: object) -> str:
    """16 hexadecimal digits over numbers, texts and DataFrames (by their rows, in any order)."""
    h = hashlib.sha256()
    for p in parts:
        if isinstance(p, DataFrame):
            row = F.sha2(F.to_json(F.struct(*sorted(p.columns)), {"ignoreNullFields": "false"}), 256)
            p = p.agg(F.count("*"), *[F.bit_xor(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("long")) for i in range(4)], F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)"))).first()
        h.update(repr(p).encode() + b"\0")
    return h.hexdigest()[:16]


def grid_digest(grid: Grid) -> str:
    """The same for a grid given from north to south and from south to north."""
    return digest("grid", grid.lats, grid.lons)


def geom_digest(edges: DataFrame) -> str:
    """Of polygons by their keys and edges, in any order."""
    return digest("geom", edges.select("geom_key", "xa", "ya", "xb", "yb"))


def stencil_digest(grid: Grid, edges: DataFrame, spherical: bool = True) -> str:
    return digest("stencil", grid_digest(grid), geom_digest(edges), bool(spherical))


def resampler_digest(r: Resampler) -> str:
    return digest("resampler", grid_digest(r.source), grid_digest(r.target), int(r.iterations))


def operator_digest(stencil: str, grid: Grid, iterations: int = 1) -> str:
    """`stencil`: its digest."""
    return digest("operator", stencil, grid_digest(grid), int(iterations))


def tree_digest(edges: DataFrame, how: str = "mean", weighted: bool = True) -> str:
    """Of edges(child, parent, weight) in any order; names of levels in struct keys count."""
    return digest("tree", how, edges.schema["child"].dataType.simpleString(), edges.select("child", "parent", *(["weight"] if weighted else [])))


class OperatorStore:
    """Parquet below root/kind/digest, each build in a folder of its own.

    A build counts once its writer has ended; readers take the latest that has.  A forced build leaves the one before it in
    place, for those who read it, and removes older ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _builds(self, path: str) -> list[str]:
        at, fs = self._at(path)
        found = [x.getPath().toString() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(x for x in found if fs.exists(self._at(f"{x}/_SUCCESS")[0]))

    def get_or_build(self, kind: str, key: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        path = f"{self.root}/{kind}/{key}"
        before = self._builds(path)
        if force or not before:
            build().withColumn("_z_version", F.lit(VERSION)).write.parquet(f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex}")
            for old in before[:-1]:
                at, fs = self._at(old)
                fs.delete(at, True)
        at = self._builds(path)[-1]
        out = self.spark.read.parquet(at)
        if out.filter(F.col("_z_version") != VERSION).limit(1).count():
            raise ValueError(f"{at} has another format version")
        return out.drop("_z_version")

    def stencil(self, grid: Grid, edges: DataFrame, spherical: bool = True, force: bool = False) -> Stencil:
        """Built once for the same grid and polygons, and checked where it is built."""
        from zonalith.operators.stencil import Stencil

        rows = self.get_or_build("stencil", stencil_digest(grid, edges, spherical), lambda: Stencil.build(edges, grid, spherical).weights, force)
        return Stencil(rows, grid, spherical, rows.count())

    def operator(self, stencil: Stencil, key: str, grid: Grid, iterations: int = 1, force: bool = False) -> DataFrame:
        """operator() of a stencil whose digest is `key`."""
        from zonalith.operators.reduce import operator

        return self.get_or_build("operator", operator_digest(key, grid, iterations), lambda: operator(stencil, grid, iterations), force)

    def resampler(self, r: Resampler, force: bool = False) -> DataFrame:
        """The matrix() of a resampler."""
        from zonalith.operators.resample import matrix

        return self.get_or_build("resampler", resampler_digest(r), lambda: matrix(self.spark, r), force)

    def tree(self, edges: DataFrame, how: str = "mean", weighted: bool = True, force: bool = False) -> Tree:
        from zonalith.operators.tree import Tree

        return Tree(self.get_or_build("tree", tree_digest(edges, how, weighted), lambda: Tree.build(edges, how, weighted).rows, force), how)
