"""The stencil: for each polygon and cell, the share of the cell that is covered, times the cell's area."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalith.functions.grid import RADIUS, Grid, midpoint_edges

#: Shares below this are rounding left over from cancelling edges.
DUST = 1e-12


class EmptyOverlapError(ValueError):
    """A polygon that covers no cell."""

    def __init__(self, geom_key):
        super().__init__(f"polygon {geom_key!r} does not overlap the grid")
        self.geom_key = geom_key


def _above(p: Column, q: Column, w: Column) -> Column:
    """The area between a line that runs from height p to q over width w and height 0, where it is above 0."""
    top = F.greatest(p, q)
    return F.when((p >= 0) & (q >= 0), w * (p + q) / 2).when((p <= 0) & (q <= 0), 0.0).otherwise(w * top * top / (2 * F.abs(p - q)))


def coverage(edges: DataFrame, grid: Grid) -> DataFrame:
    """geom_key, lat_idx, lon_idx, cell_id, coverage: exact shares, by Green's theorem edge by edge.

    Each edge is cut at the columns it spans.  In a column it adds a signed area to the rows it touches, and a whole cell's
    width to all rows below: a running sum down the column, whose value between two touched rows is the share of all rows
    between them.  So there is no clipping, no ring order and no join of polygons with cells, and the work is that of the
    cells on the edges and of the result.  A polygon's edges meet by column, never in one task.
    """
    grid.require_regular()
    (y_edges, x_edges), (dy, dx) = (midpoint_edges(grid.lats), midpoint_edges(grid.lons)), grid.step
    x_first, y_first, n_lat, n_lon = x_edges[0], y_edges[0], len(grid.lats), len(grid.lons)

    def index(value: Column, first: float, step: float, low: int, high: int) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), F.floor((value - first) / step))).cast("int")

    left, right = F.least("xa", "xb"), F.greatest("xa", "xb")
    e = edges.filter(F.col("xa") != F.col("xb")).filter((right > x_first) & (left < x_first + dx * n_lon) & (F.greatest("ya", "yb") > y_first))
    e = e.withColumn("lon_idx", F.explode(F.sequence(index(left, x_first, dx, 0, n_lon - 1), index(right, x_first, dx, 0, n_lon - 1))))
    e = e.withColumn("lx", F.greatest(left, x_first + F.col("lon_idx") * dx)).withColumn("hx", F.least(right, x_first + (F.col("lon_idx") + 1) * dx)).filter(F.col("hx") > F.col("lx"))
    at = lambda x: F.col("ya") + (F.col(x) - F.col("xa")) * (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))
    e = e.withColumn("yl", at("lx")).withColumn("yh", at("hx")).filter(F.greatest("yl", "yh") > y_first)
    low, high = index(F.least("yl", "yh"), y_first, dy, 0, n_lat), index(F.greatest("yl", "yh"), y_first, dy, 0, n_lat)
    # Row n_lat stands for all that is above the grid: only what is below it counts.
    e = e.withColumn("low", low).withColumn("lat_idx", F.explode(F.sequence(F.col("low"), F.greatest(F.col("low"), high))))
    y0, y1, w = y_first + F.col("lat_idx") * dy, y_first + (F.col("lat_idx") + 1) * dy, F.col("hx") - F.col("lx")
    sign = F.when(F.col("xb") > F.col("xa"), -1.0).otherwise(1.0)
    part = F.when(F.col("lat_idx") < n_lat, _above(F.col("yl") - y0, F.col("yh") - y0, w) - _above(F.col("yl") - y1, F.col("yh") - y1, w)).otherwise(0.0)
    # One shuffle serves the sums and the running sums.
    rows = e.repartition("geom_key", "lon_idx").groupBy("geom_key", "lon_idx", "lat_idx").agg(F.sum(sign * part).alias("own"), F.sum(F.when(F.col("lat_idx") == F.col("low"), sign * w * dy).otherwise(0.0)).alias("step"))
    down = Window.partitionBy("geom_key", "lon_idx").orderBy(F.col("lat_idx").desc())  # no more rows than latitudes
    rows = rows.select("*", F.sum("step").over(down).alias("below"), F.coalesce(F.lead("lat_idx").over(down), F.lit(-1)).alias("next"))
    touched = F.struct(F.col("lat_idx").alias("y"), (F.col("own") + F.col("below") - F.col("step")).alias("a"))
    between = F.when((F.col("below") > DUST * dx * dy) & (F.col("next") + 1 < F.col("lat_idx")), F.transform(F.sequence(F.col("next") + 1, F.col("lat_idx") - 1), lambda y: F.struct(y.alias("y"), F.col("below").alias("a"))))
    cells = rows.select("geom_key", "lon_idx", F.explode(F.concat(F.array(touched), F.coalesce(between, F.array().cast("array<struct<y:int,a:double>>")))).alias("c"))
    shares = cells.select("geom_key", F.col("c.y").alias("lat_idx"), "lon_idx", (F.col("c.a") / (dx * dy)).alias("coverage")).filter((F.col("coverage") > DUST) & (F.col("lat_idx") < n_lat))
    return shares.select("geom_key", "lat_idx", "lon_idx", (F.col("lat_idx").cast("long") * n_lon + F.col("lon_idx")).alias("cell_id"), "coverage")


@dataclass(frozen=True)
class Stencil:
    """weights: geom_key, lat_idx, lon_idx, cell_id, coverage, weight, on `grid`; n_rows of them, where that is known."""

    weights: DataFrame
    grid: Grid
    spherical: bool = True
    n_rows: int | None = None

    @classmethod
    def build(cls, edges: DataFrame, grid: Grid, spherical: bool = True, check: bool = True) -> Stencil:
        """check: count the rows, and raise EmptyOverlapError for a polygon without a cell, ValueError without polygons (one job)."""
        y_first, (dy, dx) = midpoint_edges(grid.lats)[0], grid.step
        y0 = y_first + F.col("lat_idx") * dy
        area = F.lit(RADIUS * RADIUS) * (F.sin(F.radians(y0 + dy)) - F.sin(F.radians(y0))) * F.radians(F.lit(dx)) if spherical else F.lit(1.0)
        out = cls(coverage(edges, grid).withColumn("weight", F.col("coverage") * area), grid, spherical)
        return out.checked(edges) if check else out

    def checked(self, edges: DataFrame) -> Stencil:
        sums = self.weights.groupBy(F.col("geom_key").alias("_z_key")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
        both = edges.select("geom_key").distinct().join(sums, F.col("geom_key").eqNullSafe(F.col("_z_key")), "left")
        found = both.agg(F.count("*").alias("keys"), F.sum("n").alias("n"), F.count_if(F.coalesce("w", F.lit(0.0)) <= 0).alias("lost"), F.min(F.when(F.coalesce("w", F.lit(0.0)) <= 0, F.col("geom_key"))).alias("first")).first()
        if not found["keys"]:
            raise ValueError("there are no polygons")
        if found["lost"]:
            raise EmptyOverlapError(found["first"])
        return replace(self, n_rows=found["n"])

    def row_sums(self) -> DataFrame:
        return self.weights.groupBy("geom_key").agg(F.sum("weight").alias("row_sum"))

    def normalised(self) -> DataFrame:
        """geom_key, cell_id, share: weights over their polygon's total."""
        return self.weights.join(self.row_sums(), "geom_key").select("geom_key", "cell_id", (F.col("weight") / F.col("row_sum")).alias("share"))


def empty_keys(edges: DataFrame, stencil: Stencil) -> DataFrame:
    """Keys of polygons whose weights are missing or add up to nothing."""
    found = stencil.row_sums().filter(F.col("row_sum") > 0)
    return edges.select("geom_key").distinct().join(found, "geom_key", "left_anti")
