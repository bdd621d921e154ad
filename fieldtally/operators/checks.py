"""Checks on counts and results, as frames to store or compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_count_checks(
    df: DataFrame, frames: Mapping[str, Column], expected: Mapping[str, int]
) -> DataFrame:
    """One row per check: rows found, rows expected (null if not stated), whether they agree.

    Each check is given as how many rows a row of ``df`` stands for in it (null for none), so
    that all of them are counted in one pass.
    """
    names = list(frames)
    counted = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in frames.items()])
    wanted = F.create_map(
        *[F.lit(v) for n in names for v in (n, expected.get(n))]
    )
    return (
        counted.unpivot([], names, "frame", "n_rows")
        .withColumn("n_expected", F.element_at(wanted, F.col("frame")).cast("bigint"))
        .withColumn("agrees", F.col("n_rows") == F.col("n_expected"))
    )


def completeness(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows found, and rows without a value, against the product of the distinct key values.

    A null key counts as a value of that key.
    """
    distinct = [F.count_distinct(F.struct(k)).alias(f"n_{k}") for k in keys]
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        *distinct,
    )
    full = reduce(lambda a, b: a * b, [F.col(f"n_{k}") for k in keys])
    return counted.withColumn("n_complete", full).withColumn(
        "is_complete", F.col("n_rows") == F.col("n_complete")
    )


def unknown_groups(counts: DataFrame, label: str) -> DataFrame:
    """Count rows whose taxon group is the one given (such as the label for unknown)."""
    return counts.filter(F.col("taxon_group") == label)


def describe_counts(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum of the rows per value of ``column``.

    Group sizes are tallied before the quantiles, which then work on (size, frequency) pairs.
    """
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    tally = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("f"))
    quartile = {
        name: F.percentile("n", F.lit(p), F.col("f"))
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    }
    return tally.agg(
        F.min("n").alias("minimum"),
        quartile["q1"].alias("q1"),
        quartile["median"].alias("median"),
        (F.sum(F.col("n") * F.col("f")) / F.sum("f")).alias("mean"),
        quartile["q3"].alias("q3"),
        F.max("n").alias("maximum"),
    )


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """The frame itself, or an error naming the first columns that differ in name or type."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in expected]
    if found != wanted:
        missing = [c for c in wanted if c not in found]
        extra = [c for c in found if c not in wanted]
        raise ValueError(f"schema differs: missing {missing}, unexpected {extra}, or order")
    return df


def listings(columns: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct values of named columns, such as surveys, groups and families: ``listing``, ``value``."""
    parts = [
        df.select(F.lit(name).alias("listing"), F.col(column).alias("value")).distinct()
        for name, (df, column) in columns.items()
    ]
    return reduce(DataFrame.unionByName, parts)
