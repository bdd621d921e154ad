"""Joins in which a missing key matches a missing key, and joins with area membership.

No broadcast hint is given here: membership and lookup tables are small by nature, and Spark
broadcasts a side only if its known size is under ``spark.sql.autoBroadcastJoinThreshold``.
A larger side falls back to a sort-merge join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RIGHT = "__right_"


def _same(keys: Sequence[str]) -> Column:
    return reduce(
        Column.__and__, [F.col(k).eqNullSafe(F.col(_RIGHT + k)) for k in keys]
    )


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``on`` with null equal to null; each key appears once in the result.

    Other columns must not collide: name them apart before joining.
    """
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    renamed = right.select(
        *[F.col(c).alias(_RIGHT + c if c in on else c) for c in right.columns]
    )
    if how in ("left_semi", "left_anti"):
        renamed = renamed.select(*[_RIGHT + k for k in on])
        return left.join(renamed, _same(on), how)
    joined = left.join(renamed, _same(on), how)
    if how == "right":
        joined = joined.withColumns({k: F.col(_RIGHT + k) for k in on})
    elif how == "full":
        joined = joined.withColumns({k: F.coalesce(k, _RIGHT + k) for k in on})
    return joined.drop(*[_RIGHT + k for k in on])


def natural_left_join(
    left: DataFrame, right: DataFrame, expect: Sequence[str] | None = None
) -> DataFrame:
    """Left join over all shared column names; ``expect`` guards against accidental ones."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared or (expect is not None and set(shared) != set(expect)):
        raise ValueError(f"shared columns are {shared}, expected {expect}")
    return null_safe_join(left, right, shared, "left")


def chained_join(
    frames: Sequence[DataFrame], on: Sequence[str], how: str = "full"
) -> DataFrame:
    """Join several series on the same keys, left to right."""
    return reduce(lambda a, b: null_safe_join(a, b, on, how), frames)


def _valid_on(day: str) -> Column:
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(day))) & (
        F.col("valid_to").isNull() | (F.col(day) <= F.col("valid_to"))
    )


def in_areas(
    counts: DataFrame,
    membership: DataFrame,
    on: str = "location",
    how: str = "inner",
    as_of: str | None = None,
) -> DataFrame:
    """Counts with the area groups of their location, one row per membership.

    A location in two groups yields its counts twice: totals rely on that. Membership columns
    that counts also have get the suffix ``_area``. Validity dates are ignored unless ``as_of``
    names the date column of the counts.

    ``how="right"`` also keeps memberships without counts. It is put together from the inner
    join and the unmatched memberships, because a right outer join cannot broadcast the
    membership side and would shuffle every count row on the location, however hot.
    """
    if how not in ("inner", "right"):
        raise ValueError(f"how must be inner or right, not {how!r}")
    shared = set(counts.columns) - {on}
    members = membership.select(
        *[F.col(c).alias(c + "_area") if c in shared else F.col(c) for c in membership.columns]
    )
    renamed = members.withColumnRenamed(on, _RIGHT + on)
    match = _same([on]) if as_of is None else _same([on]) & _valid_on(as_of)
    inner = counts.join(renamed, match, "inner").drop(_RIGHT + on)
    if how == "inner":
        return inner
    seen_columns = [on] if as_of is None else [on, as_of]
    seen = counts.select(*seen_columns).distinct().withColumnRenamed(on, _RIGHT + on)
    unmatched = members.join(seen, match, "left_anti")
    return inner.unionByName(unmatched, allowMissingColumns=True)


def areas_without_counts(
    membership: DataFrame, counts: DataFrame, on: str = "location"
) -> DataFrame:
    """Membership rows whose location has no count.

    Locations are made distinct first (combined before the shuffle), so the anti join meets one
    row per location instead of all counts.
    """
    return null_safe_join(membership, counts.select(on).distinct(), [on], "left_anti")
