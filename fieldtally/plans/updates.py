"""Publishing a day whose counts mostly are those of a day before.

When counts are written, each season gets a checksum. A later day reads two tables of checksums, one row
per season, and of the counts only the seasons that differ; the folded counts of the others are those of
the day before. Charts are worked out from the folded counts, which are small; a curve, the costly part,
is fitted again only for pages (such as taxa) whose points changed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators import totals
from fieldtally.operators.checksums import changed_parts, checksums
from fieldtally.operators.joins import null_safe_join
from fieldtally.plans.charts import Chart, all_charts
from fieldtally.plans.study import with_season_start
from fieldtally.sources.snapshots import write_chart_data, write_counts

SEASON = "season_start"


def _at(base: str, name: str, day: date) -> str:
    return f"{base}/{name}/snapshot={day.isoformat()}"


def write_checksums(counts: DataFrame, base: str, day: date, name: str = "counts") -> str:
    """Checksum of each season of the counts of a day, beside them; returns its path."""
    path = _at(base, f"{name}_checksums", day)
    checksums(counts, [SEASON]).write.mode("overwrite").parquet(path)
    return path


def changed_seasons(spark: SparkSession, old: str, new: str) -> list[int | None]:
    """Seasons whose checksum differs between two days: a list as long as the seasons at most."""
    parts = changed_parts(spark.read.parquet(old), spark.read.parquet(new), [SEASON])
    return [row[SEASON] for row in parts.collect()]


def _in_seasons(seasons: Sequence[int | None]) -> Column:
    """Stated on the partition column, so that other seasons' folders are not opened."""
    named = [s for s in seasons if s is not None]
    condition = F.col(SEASON).isin(named) if named else F.lit(False)
    condition = F.coalesce(condition, F.lit(False))
    return condition | F.col(SEASON).isNull() if None in seasons else condition


def fold_changes(
    counts: DataFrame, seasons: Sequence[int | None], base: str, day: date, before: date
) -> DataFrame:
    """Folded counts of a day: changed seasons from the counts, the others from the day before."""
    spark = counts.sparkSession
    folded = totals.fold_counts(with_season_start(counts).where(_in_seasons(seasons)))
    earlier = spark.read.parquet(_at(base, "folded_counts", before))
    kept = earlier.where(~_in_seasons(seasons)).select(*folded.columns)
    return spark.read.parquet(write_counts(folded.unionByName(kept), base, day, name="folded_counts"))


def write_changed_charts(charts: Mapping[str, Chart], base: str, day: date, before: date) -> dict[str, int]:
    """Points of every chart of a day; curves fitted where the points of a page changed.

    The other pages' curves are those of the day before. Returns chart -> number of pages fitted.
    """
    fitted = {}
    for name, chart in charts.items():
        path = write_chart_data(chart.points, base, day, name, chart.pages)
        if not chart.smooth:
            continue
        spark = chart.points.sparkSession
        points = spark.read.schema(chart.points.schema).parquet(path)
        old_path, curve_path = (f"{base}/snapshot={before.isoformat()}/chart={n}" for n in (name, f"{name}_curve"))
        old = spark.read.schema(chart.points.schema).parquet(old_path)
        pages = list(chart.pages)
        page = pages or ["__page"]
        now, then = (df if pages else df.withColumn("__page", F.lit(1)) for df in (points, old))
        # One row per page that changed, written: the fits and the copies are told apart by the same rows.
        changed_path = f"{base}/snapshot={day.isoformat()}/changed={name}"
        changed_parts(checksums(then, page), checksums(now, page), page).write.mode("overwrite").parquet(changed_path)
        changed = spark.read.schema(now.select(*page).schema).parquet(changed_path)
        fitted[name] = changed.count()
        again = null_safe_join(now, changed, page, "left_semi").select(*points.columns)
        curve = replace(chart, points=again).curve()
        # Pages that are gone have changed, so none of theirs is copied.
        copied = spark.read.schema(curve.schema).parquet(curve_path)
        copied = copied if pages else copied.withColumn("__page", F.lit(1))
        copied = null_safe_join(copied, changed, page, "left_anti").select(*curve.columns)
        write_chart_data(curve.unionByName(copied), base, day, f"{name}_curve", chart.pages)
    return fitted


def publish_changes(
    counts: DataFrame,
    membership: DataFrame,
    cluster_table: DataFrame,
    second: DataFrame,
    base: str,
    day: date,
    before: date,
) -> dict[str, int]:
    """The chart tables of a day, as `charts.publish` writes them, from those of the day before.

    Counts of both days, partitioned by season, must have their checksums (`write_checksums`) under
    ``base``. Memberships and the second source may differ: every chart's points are worked out anew.
    """
    spark = counts.sparkSession
    seasons = changed_seasons(spark, *(_at(base, "counts_checksums", d) for d in (before, day)))
    cells = fold_changes(counts, seasons, base, day, before)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{base}/cells/snapshot={day.isoformat()}/table={name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = all_charts(cells, membership, cluster_table, second, keep)
    return write_changed_charts(found, f"{base}/charts", day, before)
