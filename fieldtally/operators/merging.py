"""Merging a second count source with another schema into the counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.labels import relabel, season_of_date

SECOND_SOURCE_COLUMNS = (
    "location",
    "area_name",
    "sample_date",
    "season_start",
    "round",
    "taxon",
    "individuals",
    "taxon_group",
)


def wrangle_second_source(
    df: DataFrame,
    area_name: str | Column,
    rounds: Mapping[int, str],
    groups: Mapping[str, str],
    season_rule: str = "calendar_year",
) -> DataFrame:
    """Second-source rows in the columns of the counts.

    Months outside the rounds get a null round and stay in: they still enter season totals.
    With the default rule the season is the calendar year of the date.
    """
    return df.withColumns(
        {
            "area_name": F.lit(area_name),  # a label, or an expression over the rows
            "season_start": season_of_date("sample_date", season_rule),
            "round": relabel(F.month("sample_date"), rounds),
            "taxon_group": relabel("taxon_group", groups, keep_unlisted=True),
        }
    ).select(*SECOND_SOURCE_COLUMNS)


def replace_location(
    counts: DataFrame, location: str, after_season: int, other: DataFrame
) -> DataFrame:
    """Counts without one location after a season, plus the rows of the other source."""
    replaced = (F.col("location") == location) & (F.col("season_start") > after_season)
    return counts.filter(~replaced).unionByName(
        other.drop("area_name"), allowMissingColumns=True
    )


def append_membership(membership: DataFrame, other: DataFrame) -> DataFrame:
    """Membership plus the distinct (location, area) pairs of the other source."""
    return membership.unionByName(
        second_source_areas(other), allowMissingColumns=True
    )


def second_source_areas(other: DataFrame) -> DataFrame:
    return other.select("location", "area_name").distinct()


def reclassify_location(df: DataFrame, location: str, area_name: str) -> DataFrame:
    """Give every row of one location another area name."""
    return df.withColumn(
        "area_name",
        F.when(F.col("location") == location, F.lit(area_name)).otherwise(F.col("area_name")),
    )
