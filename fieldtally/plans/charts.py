"""The tables behind the charts, and the job that writes all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame

from fieldtally import fixed_values as fixed
from fieldtally.functions.labels import level_order
from fieldtally.operators import shaping, totals, trend
from fieldtally.plans import areas, clusters, merged, species
from fieldtally.plans.study import (
    PER_SPECIES,
    WITH_WADERS,
    WITHOUT_WADERS,
    Study,
    with_season_start,
)
from fieldtally.sources.snapshots import write_chart_data, write_counts

Limits = Mapping[str, tuple[float, float]]
#: Writes a table that several charts are worked out from, and gives it as read back.
Keep = Callable[[DataFrame, str], DataFrame]


def _as_it_is(df: DataFrame, name: str) -> DataFrame:
    return df


@dataclass(frozen=True)
class Chart:
    """Points of a chart; ``by`` names its series, ``pages`` the columns with a folder each."""

    points: DataFrame
    y: str
    by: tuple[str, ...] = ()
    pages: tuple[str, ...] = ()
    limits: tuple[float, float] | None = None
    smooth: bool = True

    def curve(self) -> DataFrame:
        """Smoothed trend with its band; points outside the limits do not enter the fit."""
        points = self.points
        if self.limits is not None:
            points = trend.censor(points, self.y, *self.limits)
        return trend.smoothed_band(points, self.by, "season_start", self.y)


def area_charts(
    counts: DataFrame,
    membership: DataFrame,
    study: Study,
    limits: Limits,
    keep: Keep = _as_it_is,
) -> dict[str, Chart]:
    """Winter means and shares of the nested areas, and means per class."""
    cells = keep(areas.area_round_totals(counts, membership, study), "round_totals")
    winter = areas.winter_means_of(cells)
    columns = {
        "site_means": ("mean_site",),
        "valley_means": ("mean_valley",),
        "region_means": ("mean_region",),
        "site_and_valley_means": ("mean_site", "mean_valley"),
        "valley_and_region_means": ("mean_valley", "mean_region"),
        "site_share_of_valley": ("mean_site_valley_share",),
        "valley_share_of_region": ("mean_valley_region_share",),
        "site_share_of_region": ("mean_site_region_share",),
        "site_maxima": ("max_site",),
    }
    charts = {
        name: Chart(
            shaping.long_form(winter, ["season_start"], series, "series"),
            "value",
            ("series",),
            limits=limits.get(name),
        )
        for name, series in columns.items()
    }
    charts["site_round_totals"] = Chart(
        cells.select(*areas.CELL, "site_total"),
        "site_total",
    )
    charts["class_means"] = Chart(
        areas.class_winter_means(counts, membership, study), "winter_mean", ("area_class",)
    )
    return charts


def counted_area_charts(counts, membership, study) -> dict[str, Chart]:
    return {
        "counted_areas": Chart(
            areas.counted_areas(counts, membership, study), "n_areas", smooth=False
        ),
        "counted_areas_by_class": Chart(
            areas.counted_areas_by_class(counts, membership, study), "n_areas", smooth=False
        ),
    }


def target_charts(
    counts, membership, study, limits: tuple[float, float] = fixed.LIMITS_MOVING_MEANS
) -> dict[str, Chart]:
    return {
        "moving_means_and_target": Chart(
            areas.target_gap(counts, membership, study),
            "moving_mean",
            ("area_class",),
            limits=limits,
        )
    }


def composition_charts(
    counts, membership, cluster_table, study, keep: Keep = _as_it_is
) -> dict[str, Chart]:
    per_cluster = clusters.cluster_means(counts, membership, cluster_table, study)
    cells = keep(species.area_cells(counts, membership, study, "inner"), "species_cells")
    return {
        "site_composition": Chart(
            species.stacked_composition_of(cells, study), "mean", smooth=False
        ),
        "valley_composition": Chart(
            species.stacked_composition_of(cells, study, area="valley"),
            "mean",
            smooth=False,
        ),
        "cluster_composition": Chart(
            shaping.stacked_segments(per_cluster, "season_start", "cluster_order", "mean"),
            "mean",
            smooth=False,
        ),
    }


def species_charts(
    counts,
    membership,
    cluster_table,
    study,
    choice: species.SpeciesChoice,
    keep: Keep = _as_it_is,
) -> dict[str, Chart]:
    """Means and shares per species, in one table per chart with a folder per species."""
    shares = keep(species.species_shares(counts, membership, study, choice), "species_shares")
    charts = {
        f"species_{column}": Chart(
            shares.select(*species.SPECIES_SEASON, column), column, ("taxon",), ("taxon",)
        )
        for column in ("mean_site", "mean_valley", "site_valley_share", "site_region_share")
    }
    charts["species_by_class"] = Chart(
        species.species_by_class(counts, membership, study, choice),
        "mean",
        ("taxon", "area_class"),
        ("taxon",),
    )
    per_cluster = species.species_by_cluster(
        counts, membership, cluster_table, study, choice
    ).withColumn("cluster_order", level_order("cluster", fixed.CLUSTER_LEVELS))
    charts["species_by_cluster"] = Chart(
        shaping.stacked_segments(
            per_cluster, "season_start", "cluster_order", "mean", fixed=["taxon"]
        ),
        "mean",
        pages=("taxon",),
        smooth=False,
    )
    return charts


def site_type_charts(
    counts,
    membership,
    second,
    study,
    location: str = fixed.REPLACED_LOCATION,
    after_season: int = fixed.REPLACED_AFTER,
    limits: tuple[float, float] = fixed.LIMITS_SITE_TYPES,
) -> dict[str, Chart]:
    return {
        name: Chart(
            merged.site_type_totals(
                counts, membership, second, study, location, after_season, reclassify=reclassify
            ),
            "mean",
            ("site_type",),
            limits=limits,
        )
        for name, reclassify in (
            ("site_types", None),
            ("site_types_reclassified", fixed.SITE_TYPES[0]),
        )
    }


def all_charts(
    counts: DataFrame,
    membership: DataFrame,
    cluster_table: DataFrame,
    second: DataFrame,
    keep: Keep = _as_it_is,
) -> dict[str, Chart]:
    """Every chart under its own name, for the preset studies."""

    def kept(suffix: str) -> Keep:
        return lambda df, name: keep(df, f"{name}_{suffix}")

    without = area_charts(
        counts, membership, WITHOUT_WADERS, fixed.LIMITS_WITHOUT_WADERS, kept("without_waders")
    )
    with_them = area_charts(
        counts, membership, WITH_WADERS, fixed.LIMITS_WITH_WADERS, kept("with_waders")
    )
    return {
        **{f"{name}_without_waders": chart for name, chart in without.items()},
        **{f"{name}_with_waders": chart for name, chart in with_them.items()},
        **counted_area_charts(counts, membership, WITHOUT_WADERS),
        **target_charts(counts, membership, WITHOUT_WADERS),
        **composition_charts(counts, membership, cluster_table, WITH_WADERS, keep),
        **species_charts(
            counts, membership, cluster_table, PER_SPECIES, species.SpeciesChoice(), keep
        ),
        **site_type_charts(counts, membership, second, WITH_WADERS),
    }


def write_charts(charts: Mapping[str, Chart], base: str, day: date) -> None:
    """Points of every chart, and the curve of the smoothed ones, as ``<name>_curve``.

    A curve is fitted to the points as they were written, not to points worked out again.
    """
    for name, chart in charts.items():
        path = write_chart_data(chart.points, base, day, name, chart.pages)
        if chart.smooth:
            points = chart.points.sparkSession.read.schema(chart.points.schema).parquet(path)
            curve = replace(chart, points=points).curve()
            write_chart_data(curve, base, day, f"{name}_curve", chart.pages)


def publish(
    counts: DataFrame,
    membership: DataFrame,
    cluster_table: DataFrame,
    second: DataFrame,
    base: str,
    day: date,
) -> None:
    """Write all chart tables under ``base``, a folder every executor can reach.

    Counts are folded once into a small table, written by season. Tables that several charts share
    (round totals per study, species cells and shares) are worked out from it once and written
    too. An executor lost on the way costs its tasks, not another read of the counts.
    """
    spark = counts.sparkSession
    folded = totals.fold_counts(with_season_start(counts))
    cells = spark.read.parquet(write_counts(folded, base, day, name="folded_counts"))

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{base}/cells/snapshot={day.isoformat()}/table={name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = all_charts(cells, membership, cluster_table, second, keep)
    write_charts(found, f"{base}/charts", day)
