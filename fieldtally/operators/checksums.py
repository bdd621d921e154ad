"""Checksums of parts of a table that do not depend on the order of rows, and the parts that changed.

A row's hash is taken over every column and whether it is missing, columns by name; hashes of a part are
summed, so repeated rows count as often as they occur. A part is compared by its sum, by a second one of
other hashes, and by its number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N, FIRST, SECOND = "n_rows", "checksum", "checksum_2"


def _hash(names: Sequence[str], seed: int) -> Column:
    parts = [part for n in names for part in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]
    return F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")


def checksums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per part: its key, n_rows, checksum, checksum_2. One aggregation, combined map-side."""
    names = sorted(df.columns)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(N), F.sum(_hash(names, 1)).alias(FIRST), F.sum(_hash(names, 2)).alias(SECOND)
    )


def changed_parts(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys of the parts that are new, gone or changed, given the checksums of both readings."""
    values = (N, FIRST, SECOND)
    both = old.select(*by, *values, F.lit(0).alias("__in")).unionByName(
        new.select(*by, *values, F.lit(1).alias("__in"))
    )
    same = F.lit(True)
    for v in values:
        same = same & (F.min(v) == F.max(v))
    parts = both.groupBy(*by).agg((same & (F.count_distinct("__in") == 2)).alias("__same"))
    return parts.where("NOT __same").select(*by)
