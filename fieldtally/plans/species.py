"""Species rankings, composition and per-species series. No plan loops over species."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed
from fieldtally.functions.missing import ratio, strict_sum, strict_sum_where
from fieldtally.operators import ranking, shaping, totals
from fieldtally.operators.joins import null_safe_join
from fieldtally.plans.clusters import cluster_copies
from fieldtally.plans.study import Study, period_counts, with_class

SPECIES_SEASON = ("taxon", "season_start")


def _valley_copies(membership: DataFrame) -> DataFrame:
    return membership.groupBy("location").agg(F.count(F.lit(1)).alias("copies"))


def species_season_stats(counts: DataFrame, membership: DataFrame, study: Study) -> DataFrame:
    """Per species and season in the valley: rows, total, and total per row."""
    kept = period_counts(counts, study).select(
        *SPECIES_SEASON, "location", totals.VALUE, totals.rows_behind(counts).alias("rows")
    )
    joined = null_safe_join(kept, _valley_copies(membership), ["location"], "inner")
    return (
        joined.groupBy(*SPECIES_SEASON)
        .agg(
            F.sum(F.col("copies") * F.col("rows")).alias("n"),
            strict_sum(F.col(totals.VALUE) * F.col("copies")).alias("total"),
        )
        .withColumn("mean", ratio("total", "n"))
    )


def top_concentrations(counts, membership, study, value: str = "mean", n: int = 20) -> DataFrame:
    """The ``n`` species-seasons with the largest mean (or total)."""
    return ranking.top_rows(
        species_season_stats(counts, membership, study), value, n, SPECIES_SEASON
    )


def top_concentration_species(counts, membership, study, value="mean", n=20) -> DataFrame:
    """Species among the top concentrations: the limit comes first, then the distinct names."""
    return top_concentrations(counts, membership, study, value, n).select("taxon").distinct()


def area_cells(counts, membership, study, how: str) -> DataFrame:
    """Individuals per species, season and kind of location.

    The kind is how often the location is a site and how often it is in the valley. Everything
    below is worked out from this small table. It holds one sum and its keys, so each branch of
    a plan needs all of it, and Spark runs the scan and its shuffle once and reuses them. (A
    filter on a key would slip below the sum in one branch only, so branches use conditional
    sums instead.)
    """
    weights = totals.area_weights(
        with_class(membership, study),
        {"site": F.col("area_class") == study.site_class, "valley": F.lit(True)},
    )
    kept = period_counts(counts, study).select(*SPECIES_SEASON, "location", totals.VALUE)
    return (
        null_safe_join(kept, weights, ["location"], how)
        .groupBy(*SPECIES_SEASON, "site_copies", "valley_copies")
        .agg(strict_sum(totals.VALUE).alias(totals.VALUE))
    )


def _in(area: str) -> Column:
    return F.col(f"{area}_copies") > 0


def _area_total(area: str) -> Column:
    return strict_sum_where(_in(area), F.col(totals.VALUE) * F.col(f"{area}_copies"))


def _top_of(cells: DataFrame, n: int) -> DataFrame:
    grand = cells.groupBy("taxon").agg(
        _area_total("valley").alias("total"), F.count_if(_in("valley")).alias("n_cells")
    )
    return ranking.top_rows(
        grand.filter(F.col("n_cells") > 0).drop("n_cells"), "total", n, ["taxon"]
    )


def top_species(counts: DataFrame, membership: DataFrame, study: Study, n: int) -> DataFrame:
    """The ``n`` most counted species of the valley over the whole period."""
    return _top_of(area_cells(counts, membership, study, "inner"), n)


def composition(
    counts: DataFrame,
    membership: DataFrame,
    study: Study,
    n: int = 10,
    rest: str = fixed.REST_LABEL,
    area: str = "site",
) -> DataFrame:
    """Per season and top species or rest: fixed-effort mean in the sites or the valley."""
    return composition_of(area_cells(counts, membership, study, "inner"), study, n, rest, area)


def composition_of(
    cells: DataFrame,
    study: Study,
    n: int = 10,
    rest: str = fixed.REST_LABEL,
    area: str = "site",
) -> DataFrame:
    """The composition from species cells."""
    return (
        ranking.with_rest_bucket(cells, _top_of(cells, n), "taxon", rest, "species")
        .groupBy("season_start", "species")
        .agg(
            totals.fixed_effort(_area_total(area), study.rounds).alias("mean"),
            F.count_if(_in(area)).alias("n_cells"),
        )
        .filter(F.col("n_cells") > 0)
        .drop("n_cells")
    )


def stacked_composition(counts, membership, study, n=10, rest=fixed.REST_LABEL, area="site"):
    """The composition as bar segments, one bar per season."""
    cells = area_cells(counts, membership, study, "inner")
    return stacked_composition_of(cells, study, n, rest, area)


def stacked_composition_of(cells, study, n=10, rest=fixed.REST_LABEL, area="site"):
    """The bar segments from species cells."""
    return shaping.stacked_segments(
        composition_of(cells, study, n, rest, area),
        "season_start",
        "species",
        "mean",
    )


@dataclass(frozen=True)
class SpeciesChoice:
    """Which species are reported, each from its own season on.

    The top list, less the species left out, starts with the study. Species in ``later`` have
    their own start, which wins when they are in the top list too.
    """

    n: int = 12
    left_out: tuple[str, ...] = fixed.TOP_LIST_EXCLUDED
    later: Mapping[str, int] = field(default_factory=lambda: dict(fixed.LATER_START_TAXA))

    def parameters(self, top: DataFrame, study: Study) -> DataFrame:
        """One row per species: its name and the season after which it is reported."""
        own = [*self.left_out, *self.later]
        general = top.select("taxon", F.lit(study.after).alias("after_season"))
        if own:
            general = general.filter(~F.col("taxon").isin(*own))
        if not self.later:
            return general
        starts = top.sparkSession.createDataFrame(
            sorted(self.later.items()), "taxon string, after_season int"
        )
        return general.unionByName(starts)


def species_list(
    counts: DataFrame, membership: DataFrame, study: Study, choice: SpeciesChoice
) -> DataFrame:
    return choice.parameters(top_species(counts, membership, study, choice.n), study)


def _chosen(cells: DataFrame, parameters: DataFrame) -> DataFrame:
    return (
        null_safe_join(cells, parameters, ["taxon"], "inner")
        .filter(F.col("season_start") > F.col("after_season"))
        .drop("after_season")
    )


def species_shares(counts, membership, study, choice: SpeciesChoice) -> DataFrame:
    """Per species and season with site counts: fixed-effort means and two ratios of means."""
    cells = area_cells(counts, membership, study, "left")
    chosen = _chosen(cells, choice.parameters(_top_of(cells, choice.n), study))
    means = (
        chosen.groupBy(*SPECIES_SEASON)
        .agg(
            *[
                totals.fixed_effort(_area_total(area), study.rounds).alias(f"mean_{area}")
                for area in ("site", "valley")
            ],
            totals.fixed_effort(strict_sum(totals.VALUE), study.rounds).alias("mean_region"),
            F.count_if(_in("site")).alias("n_cells"),
        )
        .filter(F.col("n_cells") > 0)
        .drop("n_cells")
    )
    return totals.with_shares(
        means,
        {
            "site_valley_share": ("mean_site", "mean_valley"),
            "site_region_share": ("mean_site", "mean_region"),
        },
    )


def species_by_class(counts, membership, study, choice: SpeciesChoice) -> DataFrame:
    """Per species, season and area class: fixed-effort mean.

    Classes split the valley, so the ranking adds up the same cells.
    """
    copies = totals.label_copies(with_class(membership, study), "area_class")
    cells = totals.labelled_totals(period_counts(counts, study), copies, SPECIES_SEASON)
    top = ranking.top_n(cells, "taxon", choice.n, "total")
    return _chosen(cells, choice.parameters(top, study)).select(
        *SPECIES_SEASON, "area_class", totals.fixed_effort("total", study.rounds).alias("mean")
    )


def species_by_cluster(
    counts, membership, clusters, study, choice: SpeciesChoice, levels=fixed.CLUSTER_LEVELS
) -> DataFrame:
    """Per species, season and cluster: fixed-effort mean in the sites.

    Cells are kept per kind of location: its valley memberships and its clusters.
    """
    listed = cluster_copies(membership, clusters, study, levels)
    kinds = null_safe_join(
        _valley_copies(membership).withColumnRenamed("copies", "valley_copies"),
        listed.groupBy("location").agg(
            F.sort_array(F.collect_list(F.struct("cluster", "copies"))).alias("clusters")
        ),
        ["location"],
        "left",
    )
    kept = period_counts(counts, study).select(*SPECIES_SEASON, "location", totals.VALUE)
    cells = (
        null_safe_join(kept, kinds, ["location"], "inner")
        .groupBy(*SPECIES_SEASON, "valley_copies", "clusters")
        .agg(strict_sum(totals.VALUE).alias(totals.VALUE))
    )
    parameters = choice.parameters(_top_of(cells, choice.n), study)
    return (
        _chosen(cells, parameters)
        .select(*SPECIES_SEASON, totals.VALUE, F.inline("clusters"))
        .groupBy(*SPECIES_SEASON, "cluster")
        .agg(
            totals.fixed_effort(
                strict_sum(F.col(totals.VALUE) * F.col("copies")), study.rounds
            ).alias("mean")
        )
    )
