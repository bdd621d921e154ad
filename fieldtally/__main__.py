"""Command line: ``ingest`` writes the snapshots of a day, ``publish`` the tables of all charts."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from fieldtally import fixed_values as fixed
from fieldtally.operators.merging import wrangle_second_source
from fieldtally.plans.charts import publish
from fieldtally.plans.ingest import ingest
from fieldtally.plans.updates import publish_changes
from fieldtally.session import build_session
from fieldtally.sources import snapshots
from fieldtally.sources.warehouse import read_tables


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fieldtally", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("ingest", help="warehouse tables (Parquet) to snapshots")
    one.add_argument("--warehouse", required=True, help="folder with one Parquet table each")
    two = jobs.add_parser("publish", help="snapshots to chart tables")
    two.add_argument("--counts", required=True, help="Parquet snapshot, or a .csv export")
    two.add_argument("--areas", required=True, help="membership CSV of the area groups")
    two.add_argument("--clusters", required=True, help="membership CSV of the clusters")
    two.add_argument(
        "--second",
        action="append",
        required=True,
        metavar="AREA=CSV",
        help="second source and the area it belongs to; may be repeated",
    )
    two.add_argument(
        "--before", type=date.fromisoformat, metavar="DAY",
        help="a published day: only seasons whose counts differ from it are read",
    )
    for job in (one, two):
        job.add_argument("--out", required=True, help="folder that every executor can reach")
        job.add_argument("--day", type=date.fromisoformat, default=date.today())
    return parser.parse_args(argv)


def _counts(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return snapshots.read_counts(spark, path)
    return spark.read.parquet(path)


def _second(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    parts = []
    for source in sources:
        area, path = source.split("=", 1)
        raw = snapshots.read_second_source(spark, path)
        parts.append(
            wrangle_second_source(raw, area, fixed.ROUNDS, fixed.SECOND_SOURCE_GROUPS)
        )
    return reduce(DataFrame.unionByName, parts)


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    spark = build_session(f"fieldtally-{args.job}")
    if args.job == "ingest":
        tables = read_tables(spark, args.warehouse, list(fixed.WAREHOUSE_COLUMNS))
        ingest(tables, args.out, args.day)
    else:
        tables = (
            _counts(spark, args.counts),
            snapshots.read_membership(spark, args.areas),
            snapshots.read_membership(spark, args.clusters),
            _second(spark, args.second),
        )
        if args.before:
            publish_changes(*tables, args.out, args.day, args.before)
        else:
            publish(*tables, args.out, args.day)


if __name__ == "__main__":
    main()
