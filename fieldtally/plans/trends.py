"""Smoothed series behind the charts: which series are fitted, and within which limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.missing import strict_sum
from fieldtally.operators import blended, shaping, spline, totals, trend, wide_band
from fieldtally.operators.joins import null_safe_join
from fieldtally.plans import areas
from fieldtally.plans.study import Study, period_counts


def round_series(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Round totals of site, valley and region as three series."""
    return shaping.long_form(
        areas.area_round_totals(counts, membership, study),
        areas.CELL,
        ["site_total", "valley_total", "region_total"],
        "series",
        "total",
    )


def round_trend(counts, membership, study) -> DataFrame:
    """Trend of the round totals per area."""
    points = round_series(counts, membership, study)
    return trend.smoothed_trend(points, ["series"], "season_start", "total")


def blended_round_trend(counts, membership, study) -> DataFrame:
    """The same trend from fits at a few vertices, blended between them."""
    points = round_series(counts, membership, study)
    return blended.blended_trend(points, ["series"], "season_start", "total")


def blended_species_trend(counts, membership, study) -> DataFrame:
    """The trend of every species, blended."""
    points = species_round_totals(counts, membership, study)
    return blended.blended_trend(points, ["taxon"], "season_start", "total")


def share_trend(counts, membership, study, limits: tuple[float, float]) -> DataFrame:
    """Trend of the round shares; shares outside the limits do not enter the fit."""
    points = shaping.long_form(
        areas.area_round_totals(counts, membership, study),
        areas.CELL,
        list(areas.SHARES),
        "series",
        "share",
    )
    return trend.smoothed_trend(
        trend.censor(points, "share", *limits),
        ["series"],
        "season_start",
        "share",
    )


def round_band(counts, membership, study) -> DataFrame:
    """The same trend with its 95% band."""
    points = round_series(counts, membership, study)
    return trend.smoothed_band(points, ["series"], "season_start", "total")


def weekly_totals(counts, study) -> DataFrame:
    """Per taxon group and week (of seven days, counted from 1970): individuals in all areas."""
    week = F.floor(F.datediff("sample_date", F.lit("1970-01-01").cast("date")) / 7)
    return (
        period_counts(counts, study)
        .groupBy("taxon_group", week.alias("week"))
        .agg(strict_sum(F.col(totals.VALUE)).alias("total"))
    )


def weekly_band(counts, study, block: int) -> DataFrame:
    """Trend of the weekly totals with its 95% band: many distinct x, worked out in tiles."""
    return wide_band.wide_band(weekly_totals(counts, study), ["taxon_group"], "week", "total", block=block)


def weekly_residual_scale(counts, study, block: int) -> DataFrame:
    """Degrees of freedom and scale behind the weekly band."""
    points = weekly_totals(counts, study)
    return wide_band.wide_residual_scale(points, ["taxon_group"], "week", "total", block=block)


def weekly_spline(counts, study) -> DataFrame:
    """Trend of the weekly totals as a spline, its smoothing by cross-validation."""
    return spline.spline_trend(weekly_totals(counts, study), ["taxon_group"], "week", "total")


def round_spline(counts, membership, study, penalty: float) -> DataFrame:
    """Trend of the round totals per area as a spline of fixed smoothing."""
    points = round_series(counts, membership, study)
    return spline.spline_trend(points, ["series"], "season_start", "total", penalties=[penalty])


def class_trend(counts, membership, study) -> DataFrame:
    """Trend of the round totals per area class."""
    points = areas.class_round_totals(counts, membership, study)
    return trend.smoothed_trend(
        points, ["area_class"], "season_start", "total"
    )


def species_round_totals(counts, membership, study) -> DataFrame:
    """Per species, season and round: total in the valley."""
    copies = membership.groupBy("location").agg(F.count(F.lit(1)).alias("copies"))
    keys = ("taxon", *areas.CELL)
    kept = period_counts(counts, study).select(*keys, "location", totals.VALUE)
    return (
        null_safe_join(kept, copies, ["location"], "inner")
        .groupBy(*keys)
        .agg(strict_sum(F.col(totals.VALUE) * F.col("copies")).alias("total"))
    )


def species_trend(counts, membership, study) -> DataFrame:
    """Trend of the valley round totals of every species: one fit per species."""
    return trend.smoothed_trend(
        species_round_totals(counts, membership, study), ["taxon"], "season_start", "total"
    )
