"""Zonal reduction: one value for each polygon and slice.

Columns are lat_idx, lon_idx and geom_key unless `dims` gives other names for them.  Names that begin with _z_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalith.functions.grid import Grid, axis_frame, valid
from zonalith.operators.resample import Resampler, fused, multiplied, resample
from zonalith.operators.stencil import Stencil

HOW = ("mean", "sum")
DIMS = ("lat_idx", "lon_idx", "geom_key")
#: Rows of an operator up to which it is broadcast to the field; beyond, both are shuffled by cell.
BROADCAST_ROWS = 2_000_000


def _check(field: DataFrame, how: str, columns: list[str]) -> None:
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}, got {how!r}")
    if missing := [c for c in columns if c not in field.columns]:
        raise ValueError(f"the field has no column {missing[0]!r}")
    if taken := [c for c in columns if c.startswith("_z_")]:
        raise ValueError(f"{taken[0]!r} is a reserved name")


def _is_small(rows: DataFrame, known: int | None, small: bool | None) -> bool:
    if small is not None:
        return small
    return (rows.limit(BROADCAST_ROWS + 1).count() if known is None else known) <= BROADCAST_ROWS


def with_weight(field: DataFrame, weight: str, weights: DataFrame | None = None, grid: Grid | None = None) -> DataFrame:
    """The field with a column `weight`: its own, or that of `weights`, spread over the dimensions it lacks, or a coordinate of the grid.

    `weights` has the weight and any of the field's other columns, by which it is joined; without any of them it has one row.
    """
    if weights is not None:
        on = [c for c in weights.columns if c != weight and c in field.columns]
        if weight not in weights.columns or len(on) + 1 < len(weights.columns):
            raise ValueError(f"weights must have {weight!r} and columns of the field only")
        rows = weights.count()
        if not on and rows > 1:
            raise ValueError("weights have several rows and no column to tell them apart")
        side = F.broadcast(weights) if rows <= BROADCAST_ROWS else weights
        bare = field.drop(weight)
        return bare.join(side, on, "left") if on else bare.crossJoin(side)  # one row
    if weight in field.columns:
        return field
    axes = {"latitude": ("lat_idx", grid.lats), "longitude": ("lon_idx", grid.lons)} if grid else {}
    if weight not in axes:
        raise ValueError(f"weight {weight!r} is neither a column of the field nor a coordinate of its grid")
    index, centres = axes[weight]
    axis = axis_frame(field.sparkSession, centres).select(F.col("idx").alias("_z_i"), F.col("centre").alias(weight))
    return field.join(F.broadcast(axis), F.col(index) == F.col("_z_i"), "left").drop("_z_i")


def _renamed(field: DataFrame, dims: tuple[str, str, str]) -> DataFrame:
    return field.withColumnsRenamed({a: b for a, b in zip(dims[:2], DIMS[:2], strict=True) if a != b})


def reduce_with_stencil(
    field: DataFrame, stencil: Stencil, batch: list[str], values: list[str], *, how: str = "mean", weight: str | None = None, weights: DataFrame | None = None, nan_weight: str = "drop",
    grid: Grid | None = None, iterations: int = 1, dims: tuple[str, str, str] = DIMS, small: bool | None = None,
) -> DataFrame:
    """batch, geom_key and each of `values`, averaged or summed with the stencil's weights.

    Cells that are missing, null or NaN do not count: a mean is over the rest, null where the rest weighs nothing or less,
    and a sum takes them as 0.  `weight` (see with_weight()) multiplies each cell's weight; where it is NaN the cell does
    not count, or with nan_weight="poison" makes the polygon's value NaN.  One join and one partial aggregation serve all
    values.  A field on another `grid` than the stencil's is resampled first, its weight too.
    """
    if iterations < 1:
        raise ValueError("iterations must be at least 1")
    field = _renamed(field, dims)
    if weight:
        field = with_weight(field, weight, weights, grid or stencil.grid)
    _check(field, how, [*batch, "lat_idx", "lon_idx", *values, *([weight] if weight else [])])
    if grid and not grid.same(stencil.grid):
        field = resample(field, Resampler(grid, stencil.grid, iterations), batch, [*values, *([weight] if weight and weight not in values else [])])
    slim = stencil.weights.select("geom_key", F.col("lat_idx").alias("_z_y"), F.col("lon_idx").alias("_z_x"), F.col("weight").alias("_z_w"))
    side = F.broadcast(slim) if _is_small(stencil.weights, stencil.n_rows, small) else slim
    met = field.select(*batch, "lat_idx", "lon_idx", *dict.fromkeys([*values, *([weight] if weight else [])])).join(side, (F.col("lat_idx") == F.col("_z_y")) & (F.col("lon_idx") == F.col("_z_x")))
    w = F.col("_z_w") * F.col(weight) if weight else F.col("_z_w")
    aggs = []
    for i, v in enumerate(values):
        on = valid(F.col(v))
        if weight and nan_weight == "drop":
            on = on & valid(F.col(weight))
        if weight and nan_weight == "poison":
            lost = ~valid(F.col(weight))
            aggs.append(F.max(lost).alias(f"_z_lost{i}"))
            on = on & ~lost
        aggs += [F.sum(F.when(on, w * F.col(v)).otherwise(0.0)).alias(f"_z_num{i}"), F.sum(F.when(on, w).otherwise(0.0)).alias(f"_z_den{i}")]
    sums = met.groupBy(*batch, "geom_key").agg(*aggs)
    out = []
    for i, v in enumerate(values):
        x = F.col(f"_z_num{i}") if how == "sum" else F.when(F.col(f"_z_den{i}") > 0, F.col(f"_z_num{i}") / F.col(f"_z_den{i}"))
        if weight and nan_weight == "poison":
            x = F.when(F.col(f"_z_lost{i}"), F.lit(float("nan"))).otherwise(x)
        out.append(x.alias(v))
    return sums.select(*batch, F.col("geom_key").alias(dims[2]), *out)


def reduce_field(field: DataFrame, edges: DataFrame, grid: Grid, batch: list[str], values: list[str], *, resolution: float | None = None, iterations: int = 1, spherical: bool = True, **how) -> DataFrame:
    """Build the stencil on the field's grid or a finer one, and reduce.  NaNs spread through resampling before they are dropped."""
    stencil = Stencil.build(edges, grid.refined(resolution) if resolution else grid, spherical)
    return reduce_with_stencil(field, stencil, batch, values, grid=grid, iterations=iterations, **how)


def operator(stencil: Stencil, grid: Grid, iterations: int = 1) -> DataFrame:
    """The stencil's weights on the field's own grid: resampling and reduction as one operator."""
    return stencil.weights.select("geom_key", "lat_idx", "lon_idx", "cell_id", "weight") if stencil.grid.same(grid) else fused(stencil.weights, Resampler(grid, stencil.grid, iterations))


def has_gaps(field: DataFrame, values: list[str]) -> bool:
    """Whether any value is null or NaN: then reduce_with_operator() gives NaNs, and reduce_with_stencil() is meant."""
    gap = ~valid(F.col(values[0]))
    for v in values[1:]:
        gap = gap | ~valid(F.col(v))
    return bool(field.filter(gap).limit(1).count())


def reduce_with_operator(
    field: DataFrame, op: DataFrame, row_sums: DataFrame, batch: list[str], values: list[str], *, how: str = "mean", grid: Grid | None = None, source: Grid | None = None, dims: tuple[str, str, str] = DIMS, small: bool | None = None,
) -> DataFrame:
    """For fields without gaps: one product with operator(), a mean over the stencil's row sums.

    A polygon any of whose cells is null, NaN or missing in a slice gets NaN there: the operator cannot weigh the rest
    anew.  With `grid` (the field's) and `source` (the operator's), grids that differ raise a ValueError.
    """
    field = _renamed(field, dims)
    _check(field, how, [*batch, "lat_idx", "lon_idx", *values])
    if grid and source and not grid.same(source):
        raise ValueError(f"the field's grid ({len(grid.lats)} x {len(grid.lons)}) is not the operator's ({len(source.lats)} x {len(source.lons)})")
    small = _is_small(op, None, small)
    sums = multiplied(field.select(*batch, "lat_idx", "lon_idx", *values), op.withColumnRenamed("geom_key", "_z_key"), batch, values, small)
    if how == "sum":
        return sums.withColumnRenamed("_z_key", dims[2])
    totals = row_sums.select(F.col("geom_key").alias("_z_key"), F.col("row_sum").alias("_z_sum"))
    return sums.join(totals, "_z_key").select(*batch, F.col("_z_key").alias(dims[2]), *[(F.col(v) / F.col("_z_sum")).alias(v) for v in values])
