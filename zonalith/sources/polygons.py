"""Polygons as directed edges (geom_key, xa, ya, xb, yb): exterior rings counter-clockwise, holes clockwise."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "geom_key {key}, is_hole boolean, pts array<struct<x:double,y:double>>"


def edges_of(rings: DataFrame) -> DataFrame:
    """Edges of rings(geom_key, is_hole, pts), closed or not, in either direction; a multipolygon has several rings."""
    open_ = F.expr("if(size(pts) > 1 and element_at(pts, 1) = element_at(pts, -1), slice(pts, 1, size(pts) - 1), pts)")
    rings = rings.select("geom_key", "is_hole", open_.alias("pts")).filter(F.size("pts") > 2)
    rings = rings.withColumn("next", F.expr("concat(slice(pts, 2, size(pts) - 1), slice(pts, 1, 1))"))
    area = F.expr("aggregate(zip_with(pts, next, (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)")
    turned = (area > 0) == F.col("is_hole")
    e = rings.select("geom_key", turned.alias("t"), F.explode(F.arrays_zip("pts", "next")).alias("e"))
    pick = lambda a, b: F.when(F.col("t"), F.col(b)).otherwise(F.col(a))
    return e.select("geom_key", pick("e.pts.x", "e.next.x").alias("xa"), pick("e.pts.y", "e.next.y").alias("ya"), pick("e.next.x", "e.pts.x").alias("xb"), pick("e.next.y", "e.pts.y").alias("yb"))


def boxes(df: DataFrame) -> DataFrame:
    """Rings of df(geom_key, xmin, ymin, xmax, ymax)."""
    corners = (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))
    return df.select("geom_key", F.lit(False).alias("is_hole"), F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in corners]).alias("pts"))


def read_geojson(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rings of a FeatureCollection of Polygons and MultiPolygons, keyed by property `key`."""
    schema = f"features array<struct<properties:struct<`{key}`:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    raw = F.when(F.col("f.geometry.type") == "Polygon", F.concat(F.lit("["), F.col("f.geometry.coordinates"), F.lit("]"))).otherwise(F.col("f.geometry.coordinates"))
    parts = f.select(F.col(f"f.properties.`{key}`").alias("geom_key"), F.explode(F.from_json(raw, "array<array<array<array<double>>>>")).alias("part"))
    rings = parts.select("geom_key", F.posexplode("part").alias("ring", "p"))
    return rings.select("geom_key", (F.col("ring") > 0).alias("is_hole"), F.transform("p", lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("pts"))


def wkb_rings(wkb: bytes) -> Iterator[tuple[bool, list[tuple[float, float]]]]:
    """(is_hole, points) of each ring of a WKB Polygon or MultiPolygon."""
    at = 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(order + form, wkb, at)
        at += struct.calcsize(order + form)
        return out

    def one() -> Iterator[tuple[bool, list[tuple[float, float]]]]:
        nonlocal at, order
        order = "<" if wkb[at] else ">"
        at += 1
        (kind,) = take("I")
        if kind not in (3, 6):
            raise ValueError(f"WKB type {kind}: only Polygon and MultiPolygon are supported")
        (n,) = take("I")
        for i in range(n):
            if kind == 6:
                yield from one()
            else:
                (m,) = take("I")
                flat = take(f"{2 * m}d")
                yield i > 0, list(zip(flat[::2], flat[1::2], strict=True))

    order = "<"
    yield from one()


def from_wkb(df: DataFrame, key_type: str = "string") -> DataFrame:
    """Rings of df(geom_key, wkb)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, hole, [{"x": x, "y": y} for x, y in pts]) for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w for hole, pts in wkb_rings(w)]
            points = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], points)], names=["geom_key", "is_hole", "pts"])

    return df.select("geom_key", "wkb").mapInArrow(read, RINGS.format(key=key_type))
