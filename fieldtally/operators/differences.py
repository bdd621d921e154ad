"""What changed between two readings of the same table.

Each row counts +1 in the new reading and -1 in the old one; rows whose sum is not zero were gained or
lost, as often as the sum says. That is one aggregation, combined map-side: a row that occurs a million
times costs one entry per task, and equal rows never meet as pairs. Missing values equal each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAINED, LOST = "n_gained", "n_lost"


def _signed(old: DataFrame, new: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    names = list(columns or new.columns)
    absent = sorted(set(names) - set(old.columns) | set(names) - set(new.columns))
    if absent or (columns is None and set(old.columns) != set(new.columns)):
        raise ValueError(f"readings have different columns: {absent or sorted(set(old.columns) ^ set(names))}")
    if taken := {GAINED, LOST, "__sign"} & set(names):
        raise ValueError(f"columns have the names of results: {sorted(taken)}")
    quoted = [F.col(f"`{n}`") for n in names]
    plus = new.select(*quoted, F.lit(1).cast("bigint").alias("__sign"))
    minus = old.select(*quoted, F.lit(-1).cast("bigint").alias("__sign"))
    return plus.unionByName(minus), names


def changed_rows(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of which one reading has more copies, with n_gained and n_lost copies (one of them is 0)."""
    signed, names = _signed(old, new, columns)
    copies = signed.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.sum("__sign").alias("__sign"))
    return copies.where("__sign <> 0").select(
        *[F.col(f"`{n}`") for n in names],
        F.greatest(F.col("__sign"), F.lit(0)).cast("bigint").alias(GAINED),
        F.greatest(-F.col("__sign"), F.lit(0)).cast("bigint").alias(LOST),
    )


def changes_per_group(
    old: DataFrame, new: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Per group: rows in either reading, and copies gained and lost; a changed row is one of each.

    Groups without a change stay, so that the two totals can be compared with stated ones.
    """
    signed, names = _signed(old, new, columns)
    copies = signed.groupBy(*[F.col(f"`{n}`") for n in names]).agg(
        F.count_if(F.col("__sign") < 0).alias("n_old"), F.count_if(F.col("__sign") > 0).alias("n_new")
    )
    gained, lost = (F.greatest(F.col(a) - F.col(b), F.lit(0)) for a, b in (("n_new", "n_old"), ("n_old", "n_new")))
    return copies.groupBy(*by).agg(
        F.sum("n_old").alias("n_old"),
        F.sum("n_new").alias("n_new"),
        F.sum(gained).alias(GAINED),
        F.sum(lost).alias(LOST),
    )
