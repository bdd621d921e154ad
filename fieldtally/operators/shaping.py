"""Reshaping: wide to long, overlapping source merges, stacked segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """Wide to long over the listed columns only, so that the others are never read."""
    return df.select(*ids, *values).unpivot(list(ids), list(values), name, value)


def stacked_segments(
    df: DataFrame, x: str, level: Column | str, value: str, fixed: Sequence[str] = ()
) -> DataFrame:
    """Lower and upper bound of each bar segment; the first level is on top, null at the bottom.

    A window holds the levels of one bar, a short list by construction.
    """
    stack = (
        Window.partitionBy(*fixed, x)
        .orderBy(F.desc_nulls_first(level))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upper = F.sum(value).over(stack)
    return df.withColumn("ymax", upper).withColumn("ymin", F.col("ymax") - F.col(value))


def moving_mean(
    df: DataFrame, by: Sequence[str], order: str, value: str, k: int, name: str = "moving_mean"
) -> DataFrame:
    """Mean of the last ``k`` rows (not years) of each series; null until ``k`` values are there.

    Expects one row per series and season, as the winter means deliver: a window then holds the
    seasons of one series and stays short however many counts stand behind it.
    """
    rows = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - k, Window.currentRow)
    full = F.count(value).over(rows) == k
    return df.withColumn(name, F.when(full, F.avg(value).over(rows)))
