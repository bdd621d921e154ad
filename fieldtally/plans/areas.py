"""Winter means, shares and counted areas of the region, the valley in it and the sites in that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed
from fieldtally.functions.missing import strict_sum_where
from fieldtally.operators import shaping, totals, trend
from fieldtally.operators.joins import chained_join, in_areas, null_safe_join
from fieldtally.plans.study import Study, exclude_codes, period_counts, with_class

CELL = ("season_start", "round")
SHARES = {
    "site_valley_share": ("site_total", "valley_total"),
    "site_region_share": ("site_total", "region_total"),
    "valley_region_share": ("valley_total", "region_total"),
}
MEANS = {"mean_site": "site_total", "mean_valley": "valley_total", "mean_region": "region_total"}
MAXIMA = {"max_site": "site_total", "max_valley": "valley_total", "max_region": "region_total"}


def _areas(study: Study) -> dict:
    return {
        "site": F.col("area_class") == study.site_class,
        "valley": F.lit(True),
    }


def nested_by(counts: DataFrame, membership: DataFrame, study: Study, keys) -> DataFrame:
    """Site, valley and region totals per key, read in one pass over prepared counts."""
    weights = totals.area_weights(with_class(membership, study), _areas(study))
    return totals.nested_totals(counts, weights, keys, ("site", "valley"), "region")


def valley_counts(
    counts: DataFrame, membership: DataFrame, study: Study, as_of: str | None = None
) -> DataFrame:
    """Counts of the study inside the area groups, one row per membership."""
    return in_areas(period_counts(counts, study), with_class(membership, study), as_of=as_of)


def area_round_totals(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per season and round: totals of site, valley and region, and their three shares."""
    kept = exclude_codes(period_counts(counts, study), study)
    cells = nested_by(kept, membership, study, CELL)
    return totals.with_shares(
        cells.select(*CELL, "site_total", "valley_total", "region_total"), SHARES
    )


def joined_round_totals(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """The same table from three separate totals and two full joins.

    All three add up one table of cells per kind of location: how often it is a site, and how
    often in the valley. Conditional sums, not filters on those keys, keep it one scan.
    """
    kept = exclude_codes(period_counts(counts, study), study)
    weights = totals.area_weights(with_class(membership, study), _areas(study))
    cells = (
        null_safe_join(kept, weights, ["location"], "left")
        .groupBy(*CELL, "site_copies", "valley_copies")
        .agg(totals.strict_sum(totals.VALUE).alias(totals.VALUE))
    )

    def total_of(area: str) -> DataFrame:
        copies = F.lit(1) if area == "region" else F.coalesce(f"{area}_copies", F.lit(0))
        return (
            cells.groupBy(*CELL)
            .agg(
                strict_sum_where(copies > 0, F.col(totals.VALUE) * copies).alias(f"{area}_total"),
                F.count_if(copies > 0).alias("n_cells"),
            )
            .filter(F.col("n_cells") > 0)
            .drop("n_cells")
        )

    joined = chained_join([total_of(a) for a in ("site", "valley", "region")], CELL, "full")
    return totals.with_shares(joined, SHARES)


def winter_means(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per season: mean and maximum over the rounds, and mean of the round shares.

    A round missing in an area leaves that area's mean, maximum and share empty.
    """
    return winter_means_of(area_round_totals(counts, membership, study))


def winter_means_of(cells: DataFrame) -> DataFrame:
    """Winter means from round totals and their shares."""
    means = {**MEANS, **{f"mean_{share}": share for share in SHARES}}
    return totals.means_over_rounds(cells, ["season_start"], means, MAXIMA)


def area_shares(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per season: mean over rounds of the shares between the nested areas."""
    cells = area_round_totals(counts, membership, study)
    return totals.means_over_rounds(
        cells, ["season_start"], {f"mean_{share}": share for share in SHARES}
    )


def long_area_means(
    counts: DataFrame, membership: DataFrame, study: Study, columns=("mean_site", "mean_valley")
) -> DataFrame:
    """Winter means as one row per season and series."""
    wide = winter_means(counts, membership, study)
    return shaping.long_form(wide, ["season_start"], columns)


def _class_cells(counts, membership, study, labels=None) -> DataFrame:
    copies = totals.label_copies(with_class(membership, study), "area_class", labels)
    kept = exclude_codes(period_counts(counts, study), study)
    return totals.labelled_totals(kept, copies, CELL)


def class_round_totals(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per area class, season and round: total."""
    return _class_cells(counts, membership, study)


def class_winter_means(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per area class and season: mean over the rounds present."""
    return totals.means_over_rounds(
        _class_cells(counts, membership, study),
        ["area_class", "season_start"],
        {"winter_mean": "total"},
    )


def overlapping_class_totals(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per overlapping class, season and round: total."""
    return _class_cells(counts, membership, study, study.overlapping)


def moving_winter_mean(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per overlapping class and season: winter mean and its mean over the last five rows."""
    means = totals.means_over_rounds(
        overlapping_class_totals(counts, membership, study),
        ["area_class", "season_start"],
        {"winter_mean": "total"},
    )
    return shaping.moving_mean(
        means, ["area_class"], "season_start", "winter_mean", fixed.MOVING_ROWS
    )


def target_gap(
    counts: DataFrame, membership: DataFrame, study: Study, target: float = fixed.TARGET_LEVEL
) -> DataFrame:
    """The moving mean against the target level."""
    return trend.target_gap(
        moving_winter_mean(counts, membership, study), "moving_mean", target
    )


def counted_areas(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Areas counted per season; an area in two classes counts twice."""
    return totals.counted_areas(
        period_counts(counts, study),
        with_class(membership, study),
        ["season_start"],
        ["season_start", "location", "area_class"],
    )


def counted_areas_by_class(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Areas counted per season and class."""
    return totals.counted_areas(
        period_counts(counts, study),
        with_class(membership, study),
        ["season_start", "area_class"],
        ["season_start", "location", "area_class"],
    )
