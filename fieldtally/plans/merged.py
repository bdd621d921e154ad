"""Counts merged with the second source, and totals by type of site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed
from fieldtally.operators import merging, ranking, totals
from fieldtally.operators.joins import null_safe_join
from fieldtally.plans.study import Study, period_counts, with_season_start


def merged_counts(
    counts: DataFrame,
    second: DataFrame,
    location: str = fixed.REPLACED_LOCATION,
    after_season: int = fixed.REPLACED_AFTER,
) -> DataFrame:
    """Counts in which the second source stands in for one location after a season."""
    return merging.replace_location(with_season_start(counts), location, after_season, second)


def source_ranking(
    counts: DataFrame,
    second: DataFrame,
    location: str = fixed.REPLACED_LOCATION,
    after_season: int = fixed.REPLACED_AFTER,
    unranked: Sequence[str] = fixed.SECOND_SOURCE_UNRANKED,
    n: int = 20,
) -> DataFrame:
    """The replaced rows and the second source: most counted species side by side."""
    replaced = with_season_start(counts).filter(
        (F.col("location") == location) & (F.col("season_start") > after_season)
    )
    for taxon in unranked:
        second = second.filter(F.col("taxon") != taxon)
    return ranking.rank_side_by_side(replaced, second, "taxon", n, ("counts", "second"))


def replaced_rows(counts: DataFrame, location: str = fixed.REPLACED_LOCATION) -> DataFrame:
    """Rows of one location per season: what the second source is to stand in for."""
    own = with_season_start(counts).filter(F.col("location") == location)
    return totals.row_counts(own, ["season_start"])


def areas_of(membership: DataFrame, location: str = fixed.REPLACED_LOCATION) -> DataFrame:
    """Names of the areas that a location is in."""
    return membership.filter(F.col("location") == location).select("area_name").distinct()


def rows_per_area_name(
    counts: DataFrame,
    membership: DataFrame,
    second: DataFrame,
    location: str = fixed.REPLACED_LOCATION,
    after_season: int = fixed.REPLACED_AFTER,
    reclassify: str = fixed.SITE_TYPES[0],
) -> DataFrame:
    """Rows of the merged counts per area name, before and after one location moves to another.

    Rows are tallied per location, and memberships per location and name, before they meet.
    """
    merged = merged_counts(counts, second, location, after_season)
    rows = F.coalesce(totals.rows_behind(merged), F.lit(1))  # the second source is not folded
    tally = merged.groupBy("location").agg(F.sum(rows).alias("rows"))
    members = merging.append_membership(membership, second)
    moved = F.col("location").eqNullSafe(F.lit(location))
    copies = members.groupBy("location", "area_name").agg(F.count(F.lit(1)).alias("copies"))
    names = F.array(
        F.struct(F.col("area_name").alias("area_name"), F.lit(1).alias("before"), F.lit(0).alias("after")),
        F.struct(
            F.when(moved, F.lit(reclassify)).otherwise(F.col("area_name")).alias("area_name"),
            F.lit(0).alias("before"),
            F.lit(1).alias("after"),
        ),
    )
    named = copies.select("location", "copies", F.inline(names))
    joined = null_safe_join(tally, named, ["location"], "inner")
    each = F.col("rows") * F.col("copies")
    return joined.groupBy("area_name").agg(
        F.sum(each * F.col("before")).alias("n_before"), F.sum(each * F.col("after")).alias("n_after")
    )


def site_type_totals(
    counts: DataFrame,
    membership: DataFrame,
    second: DataFrame,
    study: Study,
    location: str = fixed.REPLACED_LOCATION,
    after_season: int = fixed.REPLACED_AFTER,
    site_types: Sequence[str] = fixed.SITE_TYPES,
    reclassify: str | None = None,
) -> DataFrame:
    """Per season and type of site: fixed-effort mean of the merged counts.

    With ``reclassify`` every membership of the replaced location moves to that type, so a
    location in several groups then adds more than once. Counts are summed per season and
    location before they meet the membership, whose size Spark cannot know beforehand here.
    """
    merged = period_counts(merged_counts(counts, second, location, after_season), study)
    per_location = merged.groupBy("season_start", "location").agg(
        totals.strict_sum(totals.VALUE).alias(totals.VALUE)
    )
    members = merging.append_membership(membership, second)
    if reclassify is not None:
        members = merging.reclassify_location(members, location, reclassify)
    copies = totals.label_copies(
        members.filter(F.col("area_name").isin(*site_types)), "area_name", label="site_type"
    )
    cells = totals.labelled_totals(per_location, copies, ["season_start"], "site_type")
    return cells.select(
        "season_start",
        "site_type",
        totals.fixed_effort("total", study.rounds).alias("mean"),
    )
