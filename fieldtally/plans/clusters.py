"""Site totals per cluster of locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed
from fieldtally.functions.labels import level_order, listed_level, shorten
from fieldtally.operators import totals
from fieldtally.operators.joins import null_safe_join
from fieldtally.plans.study import Study, period_counts, with_class

SHORT_NAME = (fixed.CLUSTER_SHORT_PATTERN, fixed.CLUSTER_SHORT_NAME)


def _cluster_locations(clusters: DataFrame) -> DataFrame:
    return clusters.select("location", F.col("area_name").alias("cluster"))


def cluster_row_counts(
    counts: DataFrame, membership: DataFrame, clusters: DataFrame, study: Study
) -> DataFrame:
    """Rows per cluster of the right join of valley counts with clusters, full and short name.

    A cluster location without counts gives one row. Counts are tallied per location first, so
    the outer join is between two tables of locations.
    """
    tally = totals.row_counts(period_counts(counts, study), ["location"], "rows")
    copies = membership.groupBy("location").agg(F.count(F.lit(1)).alias("copies"))
    per_location = null_safe_join(tally, copies, ["location"], "inner").select(
        "location", (F.col("rows") * F.col("copies")).alias("rows")
    )
    joined = null_safe_join(per_location, _cluster_locations(clusters), ["location"], "right")
    return (
        joined.groupBy("cluster")
        .agg(F.sum(F.coalesce("rows", F.lit(1))).alias("n_rows"))
        .withColumn("short_name", shorten("cluster", *SHORT_NAME))
    )


def cluster_counts_renamed(
    counts: DataFrame, membership: DataFrame, clusters: DataFrame, study: Study
) -> DataFrame:
    """The same rows per short name: clusters that share one are counted together."""
    rows = cluster_row_counts(counts, membership, clusters, study)
    return rows.groupBy(F.col("short_name").alias("cluster")).agg(F.sum("n_rows").alias("n_rows"))


def cluster_copies(
    membership: DataFrame,
    clusters: DataFrame,
    study: Study,
    levels: Sequence[str] = fixed.CLUSTER_LEVELS,
) -> DataFrame:
    """Per location and cluster level: site memberships times cluster memberships.

    A cluster outside the levels becomes the null cluster, which is kept.
    """
    sites = (
        with_class(membership, study)
        .filter(F.col("area_class") == study.site_class)
        .groupBy("location")
        .agg(F.count(F.lit(1)).alias("site_copies"))
    )
    named = _cluster_locations(clusters).withColumn(
        "cluster", listed_level(shorten("cluster", *SHORT_NAME), levels)
    )
    return (
        null_safe_join(named, sites, ["location"], "inner")
        .groupBy("location", "cluster")
        .agg(F.sum("site_copies").alias("copies"))
    )


def cluster_means(
    counts: DataFrame,
    membership: DataFrame,
    clusters: DataFrame,
    study: Study,
    levels: Sequence[str] = fixed.CLUSTER_LEVELS,
) -> DataFrame:
    """Per season and cluster: fixed-effort mean in the sites, with the order of the cluster."""
    cells = totals.labelled_totals(
        period_counts(counts, study),
        cluster_copies(membership, clusters, study, levels),
        ["season_start"],
        "cluster",
    )
    return cells.select(
        "season_start",
        "cluster",
        level_order("cluster", levels).alias("cluster_order"),
        totals.fixed_effort("total", study.rounds).alias("mean"),
    )
