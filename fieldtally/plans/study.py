"""What a study counts: period, excluded groups, area classes. Presets bind the fixed values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed
from fieldtally.functions.labels import relabel, season_start
from fieldtally.operators import checks
from fieldtally.operators.joins import null_safe_join
from fieldtally.operators.totals import rows_behind


@dataclass(frozen=True)
class Study:
    """Seasons strictly between ``after`` and ``before``, without the excluded groups.

    ``excluded_codes`` are left out of area totals only, not of species lists.
    """

    after: int
    before: int
    excluded_groups: tuple[str, ...] = (fixed.GULLS_AND_TERNS,)
    excluded_codes: tuple[str, ...] = ()
    area_classes: Mapping[str, str] = field(default_factory=lambda: dict(fixed.AREA_CLASSES))
    site_class: str = fixed.SITE_CLASS
    overlapping: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(fixed.OVERLAPPING_CLASSES)
    )
    rounds: int = fixed.ROUNDS_PER_WINTER


WITHOUT_WADERS = Study(after=1990, before=2024, excluded_codes=(fixed.WADERS_CODE,))
WITH_WADERS = Study(after=1998, before=2024)
PER_SPECIES = Study(after=1990, before=2024)


def in_period(study: Study) -> Column:
    return (F.col("season_start") > study.after) & (F.col("season_start") < study.before)


def exclude_groups(counts: DataFrame, study: Study) -> DataFrame:
    """Rows of no excluded taxon group; rows without a group are dropped as well."""
    for group in study.excluded_groups:
        counts = counts.filter(F.col("taxon_group") != group)
    return counts


def exclude_codes(counts: DataFrame, study: Study) -> DataFrame:
    for code in study.excluded_codes:
        counts = counts.filter(F.col("taxon_group_code") != code)
    return counts


def with_season_start(counts: DataFrame) -> DataFrame:
    """Add the season number, unless the counts come partitioned by it."""
    if "season_start" in counts.columns:
        return counts
    return counts.withColumn("season_start", season_start("season"))


def period_counts(counts: DataFrame, study: Study) -> DataFrame:
    """Counts of the study: its seasons, without its excluded groups."""
    return exclude_groups(with_season_start(counts), study).filter(in_period(study))


def with_class(membership: DataFrame, study: Study) -> DataFrame:
    """Membership with the class of its area code; null for a code without class."""
    return membership.withColumn("area_class", relabel("area_code", study.area_classes))


def area_classes(membership: DataFrame, study: Study) -> DataFrame:
    """Which code stands for which class."""
    return with_class(membership, study).select("area_code", "area_class").distinct()


def row_count_checks(
    counts: DataFrame, membership: DataFrame, study: Study, expected: Mapping[str, int]
) -> DataFrame:
    """Rows in all, in the study's period and groups, and of those in the valley; one pass."""
    copies = membership.groupBy("location").agg(F.count(F.lit(1)).alias("copies"))
    kept = in_period(study)
    for group in study.excluded_groups:
        kept = kept & (F.col("taxon_group") != group)
    rows = rows_behind(counts)
    return checks.row_count_checks(
        null_safe_join(with_season_start(counts), copies, ["location"], "left"),
        {
            "all": rows,
            "period": F.when(kept, rows),
            "valley": F.when(kept, rows * F.col("copies")),
        },
        expected,
    )
