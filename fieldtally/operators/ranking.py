"""Top-n lists, rest buckets and rankings side by side.

Every ranking states its tie rule: larger value first, missing values last, then the name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.missing import strict_sum
from fieldtally.operators.joins import null_safe_join
from fieldtally.operators.totals import VALUE


def top_rows(df: DataFrame, value: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the largest value over the whole frame."""
    return df.orderBy(F.desc_nulls_last(value), *[F.asc_nulls_last(t) for t in ties]).limit(n)


def top_n(df: DataFrame, key: str, n: int, value: str = VALUE, total: str = "total") -> DataFrame:
    """The ``n`` keys with the largest strict grand total."""
    totals = df.groupBy(key).agg(strict_sum(value).alias(total))
    return top_rows(totals, total, n, [key])


def with_rest_bucket(
    df: DataFrame, top: DataFrame, key: str, rest: str, bucket: str = "bucket"
) -> DataFrame:
    """Add ``bucket``: the key if it is in the top list, else the rest label.

    The list holds as many rows as its limit says, so Spark broadcasts it.
    """
    flagged = top.select(key, F.lit(True).alias("__listed"))
    joined = null_safe_join(df, flagged, [key], "left")
    return joined.withColumn(
        bucket, F.when(F.col("__listed"), F.col(key)).otherwise(F.lit(rest))
    ).drop("__listed")


def ranked(top: DataFrame, value: str, key: str, names: Sequence[str]) -> DataFrame:
    """Number a top list from 1; its rows come from a limit, so one task sorts a handful."""
    order = Window.orderBy(F.desc_nulls_last(value), F.asc_nulls_last(key))
    return top.select(
        F.row_number().over(order).alias("position"),
        F.col(key).alias(names[0]),
        F.col(value).alias(names[1]),
    )


def rank_side_by_side(
    first: DataFrame, second: DataFrame, key: str, n: int, names: Sequence[str]
) -> DataFrame:
    """Two top-n lists joined on their position; the shorter one is filled with nulls."""
    sides = [
        ranked(top_n(df, key, n), "total", key, (f"{key}_{name}", f"total_{name}"))
        for df, name in zip((first, second), names)
    ]
    return sides[0].join(sides[1], "position", "full")
