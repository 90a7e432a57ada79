"""Grid axes: centres, edges, areas, resampling factors.  Axes are small and live on the driver; cells are DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
RADIUS = 6_371_008.8
#: Two axes are one grid if their centres differ by at most ATOL + RTOL * |centre|.
ATOL, RTOL = 1e-9, 1e-5


@dataclass(frozen=True)
class Grid:
    """Ascending cell centres.  A cell's id is lat_idx * n_lon + lon_idx."""

    lats: tuple[float, ...]
    lons: tuple[float, ...]

    @classmethod
    def of(cls, lats, lons) -> Grid:
        """Descending latitudes are turned round; longitudes must ascend."""
        lat, lon = [float(x) for x in lats], [float(x) for x in lons]
        if len(lat) > 1 and lat[0] > lat[-1]:
            lat.reverse()
        for name, own in (("latitudes", lat), ("longitudes", lon)):
            if any(b <= a for a, b in zip(own, own[1:], strict=False)):
                raise ValueError(f"{name} must be strictly ascending" + " or descending" * (name == "latitudes"))
        return cls(tuple(lat), tuple(lon))

    def same(self, other: Grid) -> bool:
        pairs = ((self.lats, other.lats), (self.lons, other.lons))
        return all(len(a) == len(b) and all(abs(x - y) <= ATOL + RTOL * abs(y) for x, y in zip(a, b, strict=True)) for a, b in pairs)

    def require_regular(self) -> None:
        for name, own in (("latitudes", self.lats), ("longitudes", self.lons)):
            if len(own) < 2:
                raise ValueError(f"{name}: a grid needs at least two points on each axis")
            steps = np.diff(own)
            mean = steps.mean()
            if mean == 0 or np.abs(steps - mean).max() > 1e-4 * abs(mean):
                raise ValueError(f"{name} are not regularly spaced")

    def refined(self, resolution: float) -> Grid:
        """Centres from the lowest to the highest, `resolution` apart; the last may stop short."""
        return Grid(tuple(target_axis(self.lats, resolution)), tuple(target_axis(self.lons, resolution)))

    @property
    def step(self) -> tuple[float, float]:
        return (self.lats[1] - self.lats[0], self.lons[1] - self.lons[0])


def midpoint_edges(centres) -> list[float]:
    if len(centres) < 2:
        raise ValueError("need at least two centres")
    inner = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
    return [centres[0] - (inner[0] - centres[0]), *inner, centres[-1] + (centres[-1] - inner[-1])]


def target_axis(centres, resolution: float) -> list[float]:
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    low, high = min(centres), max(centres)
    return [low + i * resolution for i in range(math.ceil((high + resolution / 2 - low) / resolution))]


def bilinear(source, target) -> list[tuple[int, int, float]]:
    """(target, source, weight), two for each target, a zero weight too: it lets a NaN through as a dense product would.

    Targets beyond the ends take the end's value; a source of one point has one weight of 1.
    """
    if len(source) == 1:
        return [(t, 0, 1.0) for t in range(len(target))]
    out = []
    for t, x in enumerate(target):
        i = min(max(int(np.searchsorted(source, x, side="left")) - 1, 0), len(source) - 2)
        share = min(max((x - source[i]) / (source[i + 1] - source[i]), 0.0), 1.0)
        out += [(t, i, 1.0 - share), (t, i + 1, share)]
    return out


def nearest(source, target) -> list[tuple[int, int]]:
    """(target, nearest source); a tie goes to the lower coordinate."""
    return [(t, min(range(len(source)), key=lambda i: (abs(source[i] - x), source[i]))) for t, x in enumerate(target)] if len(source) < 64 else _nearest_sorted(source, target)


def _nearest_sorted(source, target) -> list[tuple[int, int]]:
    out = []
    for t, x in enumerate(target):
        i = min(max(int(np.searchsorted(source, x, side="left")), 1), len(source) - 1)
        out.append((t, i - 1 if abs(x - source[i - 1]) <= abs(source[i] - x) else i))
    return out


def axis_frame(spark: SparkSession, centres) -> DataFrame:
    """idx, centre, lo, hi."""
    edges = midpoint_edges(centres)
    return spark.createDataFrame([(i, float(c), edges[i], edges[i + 1]) for i, c in enumerate(centres)], "idx int, centre double, lo double, hi double")


def cell_area(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column) -> Column:
    """Square metres of a cell on the sphere."""
    return F.lit(RADIUS * RADIUS) * (F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo))) * F.radians(lon_hi - lon_lo)


def areas(spark: SparkSession, grid: Grid, spherical: bool = True) -> DataFrame:
    """lat_idx, lon_idx, cell_id, area; 1 for each cell of a plane."""
    lat = axis_frame(spark, grid.lats).select(F.col("idx").alias("lat_idx"), F.col("lo").alias("y0"), F.col("hi").alias("y1"))
    lon = axis_frame(spark, grid.lons).select(F.col("idx").alias("lon_idx"), F.col("lo").alias("x0"), F.col("hi").alias("x1"))
    cells = lat.withColumn("lon_idx", F.explode(F.sequence(F.lit(0), F.lit(len(grid.lons) - 1)))).join(F.broadcast(lon), "lon_idx")  # an axis
    area = cell_area(F.col("y0"), F.col("y1"), F.col("x0"), F.col("x1")) if spherical else F.lit(1.0)
    return cells.select("lat_idx", "lon_idx", (F.col("lat_idx").cast("long") * len(grid.lons) + F.col("lon_idx")).alias("cell_id"), area.alias("area"))


def subdivide(centres, factor: int) -> list[float]:
    """Centres of `factor` equal parts of each cell."""
    edges = midpoint_edges(centres)
    return [lo + (hi - lo) * (k + 0.5) / factor for lo, hi in zip(edges, edges[1:], strict=False) for k in range(factor)]


def valid(x: Column) -> Column:
    """A value that counts: neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x)
