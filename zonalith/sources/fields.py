"""Gridded fields: one row for each slice and cell, batch columns beside lat_idx, lon_idx and the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpacked(df: DataFrame, array: str, n_lon: int, value: str = "v") -> DataFrame:
    """A row for each element of a row-major array column; the other columns are batch columns."""
    rest = [c for c in df.columns if c != array]
    e = df.select(*rest, F.posexplode(array).alias("_i", "_x"))
    return e.select(*rest, F.floor(F.col("_i") / n_lon).cast("int").alias("lat_idx"), (F.col("_i") % n_lon).alias("lon_idx"), F.col("_x").cast("double").alias(value))


def packed(field: DataFrame, batch: list[str], n_lon: int, value: str = "v") -> DataFrame:
    """The inverse of unpacked(), for dense fields."""
    cells = F.sort_array(F.collect_list(F.struct((F.col("lat_idx") * n_lon + F.col("lon_idx")).alias("i"), F.col(value).alias("x"))))
    return field.groupBy(*batch).agg(F.transform(cells, lambda c: c["x"]).alias(value))


def masked(field: DataFrame, condition, value: str = "v") -> DataFrame:
    """`value` set to NaN where the condition holds."""
    return field.withColumn(value, F.when(condition, F.lit(float("nan"))).otherwise(F.col(value)))


def selected(messages: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted value, or one of several; a filter that the scan takes over."""
    for column, value in wanted.items():
        if column not in messages.columns:
            raise ValueError(f"the messages have no {column!r}")
        messages = messages.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    return messages
