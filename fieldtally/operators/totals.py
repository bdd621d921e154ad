"""Totals, means and shares over nested and overlapping areas.

Membership is first reduced to one row per location (or per location and class) holding how many
membership rows stand behind it. Counts then join it one to one, and the multiplicity enters as a
factor. The totals equal those of the fanned-out join, but counts are read once for all areas, are
not multiplied, and are summed map-side before the only shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.fixed_values import ROUNDS_PER_WINTER
from fieldtally.functions.missing import (
    ratio,
    strict_max,
    strict_mean,
    strict_sum,
    strict_sum_where,
)
from fieldtally.operators.joins import null_safe_join

VALUE = "individuals"
ROWS = "n_rows"
FOLD_KEYS = ("season_start", "round", "location", "taxon", "taxon_group", "taxon_group_code")


def rows_behind(df: DataFrame) -> Column:
    """Count rows a row stands for: ``n_rows`` of folded counts, else one."""
    return F.col(ROWS) if ROWS in df.columns else F.lit(1)


def fold_counts(counts: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """Counts summed to season, round, location and species, with the number of rows behind.

    Every plan gives the same result on folded counts. A report of many tables folds once, writes
    the result, and reads the counts a single time.
    """
    return counts.groupBy(*keys).agg(
        strict_sum(VALUE).alias(VALUE), F.sum(rows_behind(counts)).alias(ROWS)
    )


def round_totals(df: DataFrame, keys: Sequence[str], total: str = "total") -> DataFrame:
    """Strict sum of individuals per key."""
    return df.groupBy(*keys).agg(strict_sum(VALUE).alias(total))


def row_counts(df: DataFrame, by: Sequence[str], name: str = "n_rows") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(rows_behind(df)).alias(name))


def area_weights(
    membership: DataFrame, areas: Mapping[str, Column], on: str = "location"
) -> DataFrame:
    """One row per location: number of membership rows in each named area."""
    return membership.groupBy(on).agg(
        *[F.count_if(test).alias(f"{name}_copies") for name, test in areas.items()]
    )


def label_copies(
    membership: DataFrame,
    class_column: str,
    labels: Mapping[str, Sequence[str]] | None = None,
    on: str = "location",
    label: str = "area_class",
) -> DataFrame:
    """One row per location and label: number of membership rows behind the label.

    Without ``labels`` every class is its own label, a null class included. With ``labels`` a
    class may appear under several, so that classes overlap ("A" and "A + B").
    """
    if labels is None:
        tagged = membership.select(on, F.col(class_column).alias(label))
    else:
        hits = [
            F.when(F.col(class_column).isin(*classes), F.lit(name))
            for name, classes in labels.items()
        ]
        tagged = membership.select(on, F.explode(F.array_compact(F.array(*hits))).alias(label))
    return tagged.groupBy(on, label).agg(F.count(F.lit(1)).alias("copies"))


def nested_totals(
    counts: DataFrame,
    weights: DataFrame,
    keys: Sequence[str],
    areas: Sequence[str],
    whole: str,
    on: str = "location",
) -> DataFrame:
    """Totals of the whole region and of each area inside it, per key, in one pass.

    An area without rows for a key has a null total, as after a full join of separate totals.
    """
    joined = null_safe_join(counts.select(*keys, on, VALUE), weights, [on], "left")
    totals = [
        strict_sum_where(
            F.col(f"{a}_copies") > 0, F.col(VALUE) * F.col(f"{a}_copies")
        ).alias(f"{a}_total")
        for a in areas
    ]
    present = [F.count_if(F.col(f"{a}_copies") > 0).alias(f"{a}_rows") for a in areas]
    return joined.groupBy(*keys).agg(
        *totals, strict_sum(VALUE).alias(f"{whole}_total"), *present
    )


def labelled_totals(
    counts: DataFrame,
    copies: DataFrame,
    keys: Sequence[str],
    label: str = "area_class",
    on: str = "location",
    total: str = "total",
) -> DataFrame:
    """Strict total per label and key; a location under several labels adds to each."""
    joined = null_safe_join(counts.select(*keys, on, VALUE), copies, [on], "inner")
    return joined.groupBy(label, *keys).agg(
        strict_sum(F.col(VALUE) * F.col("copies")).alias(total)
    )


def with_shares(
    totals: DataFrame, pairs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Add one quotient column per pair of total columns."""
    return totals.withColumns({name: ratio(a, b) for name, (a, b) in pairs.items()})


def means_over_rounds(
    totals: DataFrame,
    by: Sequence[str],
    means: Mapping[str, str],
    maxima: Mapping[str, str] | None = None,
) -> DataFrame:
    """Strict mean (and maximum) over the rounds present: result name -> column of ``totals``."""
    columns = [strict_mean(c).alias(name) for name, c in means.items()]
    columns += [strict_max(c).alias(name) for name, c in (maxima or {}).items()]
    return totals.groupBy(*by).agg(*columns)


def fixed_effort(total: Column | str, rounds: int = ROUNDS_PER_WINTER) -> Column:
    """Winter mean with a fixed number of rounds: absent rounds count as zero."""
    return ratio(total, F.lit(rounds))


def fixed_effort_means(
    df: DataFrame, keys: Sequence[str], rounds: int = ROUNDS_PER_WINTER, name: str = "mean"
) -> DataFrame:
    """Strict sum per key divided by the fixed number of rounds."""
    return df.groupBy(*keys).agg(fixed_effort(strict_sum(VALUE), rounds).alias(name))


def counted_areas(
    counts: DataFrame,
    membership: DataFrame,
    by: Sequence[str],
    distinct_on: Sequence[str],
    on: str = "location",
    name: str = "n_areas",
) -> DataFrame:
    """Number of distinct ``distinct_on`` rows per ``by``.

    Counts are reduced to their distinct own columns before they meet the membership.
    """
    own = [c for c in dict.fromkeys([*distinct_on, on]) if c in counts.columns]
    wanted = [c for c in distinct_on if c not in own]
    cells = null_safe_join(
        counts.select(*own).distinct(), membership.select(on, *wanted).distinct(), [on], "inner"
    )
    return cells.select(*distinct_on).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))
