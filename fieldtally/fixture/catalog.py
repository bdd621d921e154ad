"""Every registered query: name -> function of (spark, directory of test tables)."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.fixture import mapping as m
from fieldtally.operators import checks, checksums, differences, joins, merging, totals
from fieldtally.operators.trend import residual_scale
from fieldtally.plans import areas, charts, clusters, merged, species, study, trends
from fieldtally.sources.warehouse import taxon_groups

Tables = m.SurveyTables
CENSOR_LIMITS = (0, 0.5)
TARGET = 500
#: Rows of the sf0.01 tables; other sizes are reported as not agreeing.
BUCKETS = 8
#: Weeks of a block of the weekly bands: few, so that a series has several.
WEEKS = 64
EXPECTED_ROWS = {"all": 11189, "period": 8603, "valley": 7646}


def _in_study(plan, of: study.Study, *args):
    return lambda t: plan(t.counts(of), t.members(), of, *args)


def _cold_gear(t: Tables) -> DataFrame:
    counts = t.counts(m.STUDY).filter(F.col("taxon") == "cold gear")
    return areas.winter_means(counts, t.members(), m.STUDY)


def _merged(t: Tables) -> DataFrame:
    return merged.merged_counts(t.counts(), t.second(), m.REPLACED, m.REPLACED_AFTER).select(
        "location", "season", "season_start", "round", "sample_date", "taxon", "taxon_group",
        "individuals",
    )


def _site_types(reclassify: str | None = None):
    return lambda t: merged.site_type_totals(
        t.counts(m.WITH_WADERS), t.members(), t.second(), m.WITH_WADERS,
        m.REPLACED, m.REPLACED_AFTER, reclassify=reclassify,
    )


def _species_curve(name: str):
    def curve(t: Tables) -> DataFrame:
        of = m.SPECIES_CURVES
        found = charts.species_charts(t.counts(of), t.members(), t.clusters(), of, m.CHOICE)
        return found[name].curve()

    return curve


def _area_curve(name: str):
    return lambda t: charts.area_charts(
        t.counts(m.CURVES), t.members(), m.CURVES, m.CURVE_LIMITS
    )[name].curve()


PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    # sources
    "star_counts": lambda t: t.star_counts(),
    "bucketed_star_counts": lambda t: t.star_counts(BUCKETS),
    "counts_by_csv": lambda t: t.counts_by_csv(),
    "ordered_counts": lambda t: t.ordered_counts(("season", "-individuals")),
    "changed_rows": lambda t: differences.changed_rows(t.earlier_counts(), t.counts_with_survey()),
    "changes_per_survey": lambda t: differences.changes_per_group(
        t.earlier_counts(), t.counts_with_survey(), ["survey"]
    ),
    "changed_seasons": lambda t: checksums.changed_parts(
        *(checksums.checksums(df, ["season_start"]) for df in (t.earlier_counts(by_parity=True), t.counts_with_survey())),
        ["season_start"],
    ),
    "taxon_groups": lambda t: taxon_groups(t.taxa()),
    "area_membership": lambda t: t.members(),
    "cluster_membership": lambda t: t.clusters(),
    "counts_with_group": lambda t: joins.natural_left_join(
        t.counts_without_group(), t.taxon_lookup(), expect=["taxon"]
    ),
    # filters and checks
    "exclude_groups": lambda t: study.exclude_codes(
        study.exclude_groups(t.counts(), m.STUDY), m.STUDY
    ),
    "period_counts": lambda t: study.period_counts(t.counts(m.STUDY), m.STUDY),
    "period_counts_from_label": lambda t: study.period_counts(t.counts_from_label(), m.STUDY),
    "unknown_groups": lambda t: checks.unknown_groups(t.counts(), "STANDARD"),
    "rows_per_survey": lambda t: totals.row_counts(t.counts_with_survey(), ["survey"]),
    "row_count_checks": lambda t: study.row_count_checks(
        t.counts(), t.members(), m.STUDY, EXPECTED_ROWS
    ),
    "completeness_check": lambda t: checks.completeness(
        species.composition(t.counts(m.WITH_WADERS), t.members(), m.WITH_WADERS),
        ["season_start", "species"],
        "mean",
    ),
    "areas_without_counts": lambda t: joins.areas_without_counts(t.members(), t.counts()),
    "area_classes": lambda t: study.area_classes(t.members(), m.STUDY),
    "membership_summary": lambda t: checks.describe_counts(
        merging.append_membership(t.members(), t.second()), "location"
    ),
    # areas
    "valley_counts": _in_study(areas.valley_counts, m.STUDY),
    "valley_counts_as_of": _in_study(areas.valley_counts, m.STUDY, "sample_date"),
    "area_right_join": lambda t: joins.in_areas(t.counts(), t.members(), how="right").select(
        "location", "area_code", "season_start", "round", "taxon", "individuals"
    ),
    "folded_counts": lambda t: totals.fold_counts(t.counts()),
    "round_totals": lambda t: totals.round_totals(
        study.exclude_codes(study.period_counts(t.counts(m.STUDY), m.STUDY), m.STUDY), areas.CELL
    ),
    "area_round_totals": _in_study(areas.area_round_totals, m.STUDY),
    "joined_round_totals": _in_study(areas.joined_round_totals, m.STUDY),
    "winter_means": _in_study(areas.winter_means, m.STUDY),
    "winter_means_with_waders": _in_study(areas.winter_means, m.WITH_WADERS),
    "winter_means_one_taxon": _cold_gear,
    "long_area_means": _in_study(areas.long_area_means, m.STUDY),
    "area_shares": _in_study(areas.area_shares, m.STUDY),
    "class_winter_means": _in_study(areas.class_winter_means, m.STUDY),
    "overlapping_classes": _in_study(areas.overlapping_class_totals, m.STUDY),
    "moving_winter_mean": _in_study(areas.moving_winter_mean, m.STUDY),
    "target_gap": _in_study(areas.target_gap, m.STUDY, TARGET),
    "counted_areas": _in_study(areas.counted_areas, m.STUDY),
    "counted_areas_by_class": _in_study(areas.counted_areas_by_class, m.STUDY),
    # species
    "species_season_stats": _in_study(species.species_season_stats, m.STUDY),
    "top20_concentrations": _in_study(species.top_concentrations, m.STUDY),
    "top20_totals": _in_study(species.top_concentrations, m.STUDY, "total"),
    "top20_species": _in_study(species.top_concentration_species, m.STUDY),
    "top20_total_species": _in_study(
        species.top_concentration_species, m.STUDY, "total"
    ),
    "top5_species": _in_study(species.top_species, m.STUDY, 5),
    "top_species_other": _in_study(species.composition, m.WITH_WADERS),
    "valley_composition": _in_study(
        species.composition, m.WITH_WADERS, 10, "Andere", "valley"
    ),
    "stacked_composition": _in_study(species.stacked_composition, m.WITH_WADERS),
    "species_list": _in_study(species.species_list, m.PER_SPECIES, m.CHOICE),
    "species_shares": _in_study(species.species_shares, m.PER_SPECIES, m.CHOICE),
    "species_by_class": _in_study(species.species_by_class, m.PER_SPECIES, m.CHOICE),
    "species_by_cluster": lambda t: species.species_by_cluster(
        t.counts(m.PER_SPECIES), t.members(), t.clusters(), m.PER_SPECIES, m.CHOICE
    ),
    "fixed_effort_means": lambda t: totals.fixed_effort_means(
        study.period_counts(t.counts(m.PER_SPECIES), m.PER_SPECIES), ["taxon", "season_start"]
    ),
    # clusters
    "cluster_row_counts": lambda t: clusters.cluster_row_counts(
        t.counts(m.WITH_WADERS), t.members(), t.clusters(), m.WITH_WADERS
    ),
    "cluster_counts_renamed": lambda t: clusters.cluster_counts_renamed(
        t.counts(m.WITH_WADERS), t.members(), t.clusters(), m.WITH_WADERS
    ),
    "cluster_means": lambda t: clusters.cluster_means(
        t.counts(m.WITH_WADERS), t.members(), t.clusters(), m.WITH_WADERS
    ),
    # second source
    "second_source": lambda t: t.second(),
    "second_source_winter_rule": lambda t: totals.round_totals(
        t.second("winter_start"), ["area_name", "season_start", "round"]
    ),
    "second_source_areas": lambda t: merging.second_source_areas(t.second()),
    "merge_sources": _merged,
    "rank_side_by_side": lambda t: merged.source_ranking(
        t.counts(), t.second(), m.REPLACED, m.REPLACED_AFTER, m.UNRANKED
    ),
    "rows_per_area_name": lambda t: merged.rows_per_area_name(
        t.counts(), t.members(), t.second(), m.REPLACED, m.REPLACED_AFTER, "Sigma-Estuarien"
    ),
    "replaced_location_rows": lambda t: merged.replaced_rows(t.counts(), m.REPLACED),
    "replaced_location_areas": lambda t: merged.areas_of(t.members(), m.REPLACED),
    "listings": lambda t: checks.listings(
        {
            "survey": (t.counts_with_survey(), "survey"),
            "group": (t.taxa(), "taxon_group"),
            "family": (t.second_raw(), "taxon_group"),
        }
    ),
    "site_type_totals": _site_types(),
    "reclassified_totals": _site_types("Sigma-Estuarien"),
    # trends
    "smoothed_trend": _in_study(trends.round_trend, m.STUDY),
    "blended_trend": _in_study(trends.blended_round_trend, m.STUDY),
    "blended_species_trend": _in_study(trends.blended_species_trend, m.STUDY),
    "censored_trend": _in_study(trends.share_trend, m.STUDY, CENSOR_LIMITS),
    "class_trend": _in_study(trends.class_trend, m.STUDY),
    "species_trend": _in_study(trends.species_trend, m.STUDY),
    "weekly_spline": lambda t: trends.weekly_spline(t.counts(m.STUDY), m.STUDY),
    "round_spline": _in_study(trends.round_spline, m.STUDY, 1.0),
    "weekly_band": lambda t: trends.weekly_band(t.counts(m.STUDY), m.STUDY, WEEKS),
    "weekly_residual_scale": lambda t: trends.weekly_residual_scale(t.counts(m.STUDY), m.STUDY, WEEKS),
    "smoothed_band": _in_study(trends.round_band, m.STUDY),
    "residual_scale": lambda t: residual_scale(
        trends.round_series(t.counts(m.STUDY), t.members(), m.STUDY),
        ["series"],
        "season_start",
        "total",
    ),
    # curves of the charts: one point per season
    "winter_mean_trend": _area_curve("site_and_valley_means"),
    "share_mean_trend": _area_curve("site_share_of_valley"),
    "class_mean_trend": _area_curve("class_means"),
    "moving_mean_trend": lambda t: charts.target_charts(
        t.counts(m.CURVES), t.members(), m.CURVES, m.CURVE_LIMITS["moving_means"]
    )["moving_means_and_target"].curve(),
    "species_mean_trend": _species_curve("species_mean_site"),
    "species_share_trend": _species_curve("species_site_valley_share"),
    "species_class_trend": _species_curve("species_by_class"),
    "site_type_trend": lambda t: charts.site_type_charts(
        t.counts(m.SPECIES_CURVES), t.members(), t.second(), m.SPECIES_CURVES,
        m.REPLACED, m.REPLACED_AFTER, m.CURVE_LIMITS["site_types"],
    )["site_types"].curve(),
}

#: Fitted values carry rounding noise from sums in another order; they are compared to 4 digits
#: (weekly totals, which are larger, to 3).
FITTED = ("smoothed_trend", "censored_trend", "class_trend", "species_trend", "smoothed_band",
          "residual_scale", "winter_mean_trend", "share_mean_trend", "class_mean_trend",
          "moving_mean_trend", "species_mean_trend", "species_share_trend", "species_class_trend",
          "site_type_trend", "blended_trend", "blended_species_trend",
          "weekly_band", "weekly_residual_scale", "weekly_spline", "round_spline")


#: Whole numbers that may be missing are compared as doubles: engines hand them on differently.
MAYBE_MISSING = {
    "max_site", "max_valley", "max_region", "site_total", "valley_total", "region_total",
    "total_counts", "total_second", "cluster_order",
}
MAYBE_MISSING_IN = {"area_right_join": {"season_start", "individuals"}}


def comparable(df: DataFrame, digits: int = 6, as_double: Collection[str] = ()) -> DataFrame:
    """Doubles rounded and dates as text, so that results compare across engines."""
    columns = []
    for name, kind in df.dtypes:
        if name in as_double:
            columns.append(F.col(name).cast("double").alias(name))
        elif kind == "double":
            columns.append(F.round(name, digits).alias(name))
        elif kind == "date":
            columns.append(F.col(name).cast("string").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def _registered(name: str, plan: Callable[[Tables], DataFrame]):
    digits = 3 if name == "weekly_band" else 4 if name in FITTED else 6
    as_double = MAYBE_MISSING | MAYBE_MISSING_IN.get(name, set())

    def query(spark: SparkSession, directory: str) -> DataFrame:
        return comparable(plan(Tables(spark, directory)), digits, as_double)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _registered(name, plan) for name, plan in PLANS.items()}
