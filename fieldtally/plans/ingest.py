"""From the warehouse to snapshots: counts with their taxon group, and both memberships."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame

from fieldtally import fixed_values as fixed
from fieldtally.operators.joins import natural_left_join
from fieldtally.operators.totals import row_counts
from fieldtally.plans.updates import write_checksums
from fieldtally.sources.snapshots import with_exported_names, write_counts, write_csv_snapshot
from fieldtally.sources.warehouse import membership, taxon_groups, warehouse_counts


def grouped_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Warehouse counts with the group of their taxon, matched on the common name."""
    return natural_left_join(
        warehouse_counts(tables), taxon_groups(tables["DimTaxonWV"]), expect=["taxon"]
    )


def rows_per_survey(counts: DataFrame) -> DataFrame:
    return row_counts(counts, ["survey"])


def ingest(tables: Mapping[str, DataFrame], base: str, day: date) -> dict[str, str]:
    """Write the snapshots of a day under ``base``; returns name -> path.

    Counts become Parquet by season, which later reads can skip through; memberships are small
    and become CSV under their exported headers.
    """
    bridge = tables["FactLocationGroup"]
    paths = {"counts": write_counts(grouped_counts(tables), base, day)}
    spark = bridge.sparkSession
    paths["checksums"] = write_checksums(spark.read.parquet(paths["counts"]), base, day)
    for name, codes in (("areas", fixed.AREA_CODES), ("clusters", fixed.CLUSTER_CODES)):
        rows = with_exported_names(membership(bridge, codes), fixed.MEMBERSHIP_HEADER)
        paths[name] = write_csv_snapshot(rows, base, name, day)
    return paths
