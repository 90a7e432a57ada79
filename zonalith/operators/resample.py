"""Mean-preserving resampling between grids.

B interpolates, A averages the targets whose nearest source a cell is, P hands a source's value to its targets.  One
iteration gives B x corrected by P (x - A B x); further ones first repeat the smooth correction.  Each of the three is a
product of a factor along latitudes and one along longitudes, so a slice is resampled as one array, and the whole operator
is a short sum of such products, whatever the number of iterations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalith.functions.grid import Grid, bilinear, nearest

#: Cells of a slice, on either grid, up to which it is resampled as one array in a task (a value takes 8 bytes in each);
#: larger ones by joins with the operator's rows.
MOST_CELLS = 1 << 24
#: Rows of a factor: by target, (source, weight), zero weights included: they let a NaN through as a dense product would.
Factor = list[dict[int, float]]


def _product(a: Factor, b: Factor) -> Factor:
    out: Factor = []
    for row in a:
        new: dict[int, float] = {}
        for k, w in row.items():
            for c, v in b[k].items():
                new[c] = new.get(c, 0.0) + w * v
        out.append(new)
    return out


class _Sum:
    """A factor applied along the first axis of arrays."""

    def __init__(self, factor: Factor):
        self.rows = len(factor)
        self.own = np.array([t for t, row in enumerate(factor) if row], np.int64)
        sizes = [len(row) for row in factor if row]
        self.first = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)
        self.source = np.array([s for row in factor for s in row], np.int64)
        self.weight = np.array([w for row in factor for w in row.values()], np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, *x.shape[1:]))
        if len(self.own):
            out[self.own] = np.add.reduceat(self.weight.reshape(-1, *[1] * (x.ndim - 1)) * x[self.source], self.first, axis=0)
        return out


@dataclass(frozen=True)
class Resampler:
    source: Grid
    target: Grid
    iterations: int = 1

    def __post_init__(self):
        if self.iterations < 1:
            raise ValueError("iterations must be at least 1")

    @cached_property
    def factors(self) -> tuple[dict[str, Factor], dict[str, Factor]]:
        """B, A and P along latitudes and along longitudes; rows are bounded by the axes."""
        out = []
        for s, t in ((self.source.lats, self.target.lats), (self.source.lons, self.target.lons)):
            parent = nearest(s, t)
            b: Factor = [{} for _ in t]
            for i, j, w in bilinear(s, t):
                b[i][j] = b[i].get(j, 0.0) + w
            a: Factor = [{} for _ in s]
            for i, j in parent:
                a[j][i] = 1.0
            out.append({"B": b, "A": [dict.fromkeys(row, 1.0 / len(row)) if row else {} for row in a], "P": [{j: 1.0} for _, j in parent]})
        return out[0], out[1]

    def terms(self) -> list[tuple[float, Factor, Factor]]:
        """(c, lat, lon): the operator is the sum of c * (lat x lon).

        With n iterations it is P + (I - P A) sum over k of (-1)^k C(n, k + 1) (B A)^k B, as the sum of the powers of
        I - B A gives by the binomial theorem.
        """
        axes, n = self.factors, self.iterations
        out = [(1.0, axes[0]["P"], axes[1]["P"])]
        power = [f["B"] for f in axes]
        for k in range(n):
            c = float((-1) ** k * comb(n, k + 1))
            down = [_product(f["A"], p) for f, p in zip(axes, power, strict=True)]
            out += [(c, power[0], power[1]), (-c, *[_product(f["P"], d) for f, d in zip(axes, down, strict=True)])]
            power = [_product(f["B"], d) for f, d in zip(axes, down, strict=True)]
        return out

    def side(self, spark: SparkSession, axis: int) -> DataFrame:
        """(_z_t, _z_term, _z_s, _z_w) of one axis; coefficients go with latitudes.  No longer than an axis times the terms and their widths."""
        rows = [(t, k, s, w * (term[0] if axis == 0 else 1.0)) for k, term in enumerate(self.terms()) for t, row in enumerate(term[1 + axis]) for s, w in row.items()]
        return spark.createDataFrame(rows, "_z_t int, _z_term int, _z_s int, _z_w double")


class _Slice:
    """One slice, as an array, through all stages."""

    def __init__(self, resampler: Resampler, batch: int, values: int, schema: list[str]):
        self.r, self.batch, self.values, self.schema = resampler, batch, values, schema

    def __call__(self, cells: pa.Table) -> pa.Table:
        r = self.r
        sums = [{k: _Sum(f) for k, f in axis.items()} for axis in r.factors]

        def through(kind: str, x: np.ndarray) -> np.ndarray:
            return sums[0][kind](sums[1][kind](x.T).T)

        at = tuple(cells.column(self.batch + k).to_numpy() for k in (0, 1))
        shape = (len(r.source.lats), len(r.source.lons))
        inside = (at[0] >= 0) & (at[0] < shape[0]) & (at[1] >= 0) & (at[1] < shape[1])
        out = []
        for k in range(self.values):
            x = np.full(shape, np.nan)
            own = cells.column(self.batch + 2 + k).to_numpy()
            x[at[0][inside], at[1][inside]] = np.array(own, np.float64)[inside]
            y = term = through("B", x)
            for _ in range(1, r.iterations):
                term = term - through("B", through("A", term))
                y = y + term
            out.append((y + through("P", x - through("A", y))).reshape(-1))
        n_lat, n_lon = len(r.target.lats), len(r.target.lons)
        keys = [cells.column(k).slice(0, 1).take(pa.array(np.zeros(n_lat * n_lon, np.int64))) for k in range(self.batch)]
        lat, lon = np.divmod(np.arange(n_lat * n_lon, dtype=np.int32), np.int32(n_lon))
        return pa.Table.from_arrays([*keys, pa.array(lat), pa.array(lon), *map(pa.array, out)], names=self.schema)


def resample(field: DataFrame, resampler: Resampler, batch: list[str], values: list[str]) -> DataFrame:
    """field(batch, lat_idx, lon_idx, values) on the target grid, every cell of it for each slice.

    A value that is null, NaN or missing spreads to all cells that a dense product would touch.  Of rows that repeat a cell,
    any one counts.  Cells are keyed by ascending index, so the direction in which latitudes were given does not matter.  A
    slice up to MOST_CELLS is one array in one task: one shuffle for any number of iterations; larger ones are joined.
    """
    if max(len(g.lats) * len(g.lons) for g in (resampler.source, resampler.target)) > MOST_CELLS:
        return apply_matrix(field, matrix(field.sparkSession, resampler), resampler, resampler.source, batch, values)
    x = field.select(*batch, F.col("lat_idx").cast("int"), F.col("lon_idx").cast("int"), *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in values])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in x.schema])
    run = _Slice(resampler, len(batch), len(values), x.columns)

    def whole(cells: pa.Table) -> pa.Table:
        return run(cells)

    return x.groupBy(*batch).applyInArrow(whole, schema)


def fused(weights: DataFrame, resampler: Resampler, key: str = "geom_key", zeros: bool = False) -> DataFrame:
    """(key, lat_idx, lon_idx, cell_id, weight) on the source grid: weights on the target grid after resampling.

    Two joins with factors of an axis and two sums, whatever the number of iterations; the resampling is never built.
    With `zeros` cells that weigh nothing stay, as they let a NaN through.
    """
    spark = weights.sparkSession
    w = weights.select(F.col(key).alias("_z_key"), F.col("lat_idx").alias("_z_y"), F.col("lon_idx").alias("_z_x"), "weight")
    met = w.join(F.broadcast(resampler.side(spark, 0)), F.col("_z_y") == F.col("_z_t"))
    half = met.groupBy("_z_key", F.col("_z_term").alias("_z_k"), F.col("_z_s").alias("lat_idx"), "_z_x").agg(F.sum(F.col("weight") * F.col("_z_w")).alias("_z_v"))
    met = half.join(F.broadcast(resampler.side(spark, 1)), (F.col("_z_x") == F.col("_z_t")) & (F.col("_z_k") == F.col("_z_term")))
    out = met.groupBy(F.col("_z_key").alias(key), "lat_idx", F.col("_z_s").alias("lon_idx")).agg(F.sum(F.col("_z_v") * F.col("_z_w")).alias("weight"))
    n = len(resampler.source.lons)
    out = out if zeros else out.filter(F.col("weight") != 0)
    return out.select(key, "lat_idx", "lon_idx", (F.col("lat_idx").cast("long") * n + F.col("lon_idx")).alias("cell_id"), "weight")


def matrix(spark: SparkSession, resampler: Resampler) -> DataFrame:
    """The whole resampling as (target_cell, lat_idx, lon_idx, cell_id, weight), for inspection and reuse on many fields; zero weights included."""
    n = len(resampler.target.lons)
    cells = spark.range(len(resampler.target.lats) * n).select(F.col("id").alias("target_cell"), F.floor(F.col("id") / n).cast("int").alias("lat_idx"), (F.col("id") % n).cast("int").alias("lon_idx"), F.lit(1.0).alias("weight"))
    return fused(cells, resampler, "target_cell", zeros=True)


def apply_matrix(field: DataFrame, t: DataFrame, resampler: Resampler, grid: Grid, batch: list[str], values: list[str]) -> DataFrame:
    """matrix() applied to a field on `grid`, which must be the matrix's source grid; null, NaN and missing cells spread as NaN."""
    if not grid.same(resampler.source):
        raise ValueError("the field's grid is not the resampler's source grid")
    n = len(resampler.target.lons)
    return multiplied(field, t.withColumnRenamed("target_cell", "_z_key"), batch, values).select(*batch, F.floor(F.col("_z_key") / n).cast("int").alias("lat_idx"), (F.col("_z_key") % n).cast("int").alias("lon_idx"), *values)


def multiplied(field: DataFrame, rows: DataFrame, batch: list[str], values: list[str], small: bool = False) -> DataFrame:
    """batch, _z_key and the sums of weight * value over rows(_z_key, lat_idx, lon_idx, weight); NaN where any cell of a row is null, NaN or missing."""
    side = rows.select("_z_key", F.col("lat_idx").alias("_z_y"), F.col("lon_idx").alias("_z_x"), F.col("weight").alias("_z_w"))
    met = field.join(F.broadcast(side) if small else side, (F.col("lat_idx") == F.col("_z_y")) & (F.col("lon_idx") == F.col("_z_x")))
    nan = F.lit(float("nan"))
    sums = met.groupBy(*batch, "_z_key").agg(F.count("*").alias("_z_n"), *[F.sum(F.col("_z_w") * F.coalesce(F.col(v), nan)).alias(f"_z_v{i}") for i, v in enumerate(values)])
    whole = rows.groupBy(F.col("_z_key").alias("_z_key2")).agg(F.count("*").alias("_z_all"))
    out = sums.join(F.broadcast(whole) if small else whole, F.col("_z_key") == F.col("_z_key2"))
    return out.select(*batch, "_z_key", *[F.when(F.col("_z_n") == F.col("_z_all"), F.col(f"_z_v{i}")).otherwise(nan).alias(v) for i, v in enumerate(values)])
