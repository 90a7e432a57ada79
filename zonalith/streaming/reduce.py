"""Reduction of a stream of cells: the stencil is static, so it is a stream-static join and a windowed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalith.functions.grid import valid
from zonalith.operators.stencil import Stencil


def reduce_stream(cells: DataFrame, stencil: Stencil, time: str, window: str, late: str, value: str) -> DataFrame:
    """window, geom_key, mean of `value` over cells(time, lat_idx, lon_idx, value) that arrive at most `late` after others."""
    side = stencil.weights.select("geom_key", F.col("lat_idx").alias("_y"), F.col("lon_idx").alias("_x"), F.col("weight").alias("_w"))
    met = cells.withWatermark(time, late).join(side, (F.col("lat_idx") == F.col("_y")) & (F.col("lon_idx") == F.col("_x")))
    on = valid(F.col(value))
    sums = met.groupBy(F.window(time, window).alias("window"), "geom_key").agg(F.sum(F.when(on, F.col("_w") * F.col(value))).alias("num"), F.sum(F.when(on, F.col("_w"))).alias("den"))
    return sums.select("window", "geom_key", F.when(F.col("den") > 0, F.col("num") / F.col("den")).alias(value))
