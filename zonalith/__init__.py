"""Zonal statistics on Spark: sparse linear operators kept as DataFrames of weights."""

__version__ = "0.1.0"
