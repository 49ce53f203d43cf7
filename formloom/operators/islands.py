"""Gaps and islands: numbering runs of neighbouring values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_chains(
    df: DataFrame, keys: Sequence[str], value: str, max_gap: Column | float, out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Number chains in which each value is at most ``max_gap`` after the one before."""
    w = Window.partitionBy(*keys).orderBy(value, *tie)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("_brk", F.when(step > max_gap, 1).otherwise(0)).withColumn(
        out, F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_brk")


def number_interval_islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, max_gap: Column | float, out: str
) -> DataFrame:
    """Number groups of intervals whose hulls are at most ``max_gap`` apart.

    ``start``/``end`` are compared as given: a new island starts where
    ``start - max(end so far) > max_gap``.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_brk", F.when(F.col(start) - reach > max_gap, 1).otherwise(0)).withColumn(
        out, F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_brk")
