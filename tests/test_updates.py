"""Checksums of parts, and a day published from the day before."""

import datetime as dt
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import totals
from fieldtally.operators.checksums import changed_parts, checksums
from fieldtally.plans import updates
from fieldtally.plans.charts import Chart, write_charts
from fieldtally.sources.snapshots import write_counts

MONDAY, TUESDAY = dt.date(2025, 1, 20), dt.date(2025, 1, 21)
COUNTS = (
    "season_start int, season string, round string, location string, taxon string, individuals bigint, "
    "taxon_group string, taxon_group_code string"
)


def counts(spark, extra=()):
    rows = [
        (s, f"{s}/x", r, f"p{i % 3}", t, 1 + (5 * (s or 0) + 3 * i + len(t)) % 17, "G", "g")
        for s in [*range(1999, 2009), None]
        for r in ("Maart", "Januari")
        for i, t in enumerate(["duck", "goose", "Wulp"] * 2)
    ]
    return spark.createDataFrame([*rows, *extra], COUNTS)


def rows_of(df):
    return Counter(tuple(sorted(map(str, r.asDict().items()))) for r in df.collect())


def changed(old, new):
    parts = changed_parts(checksums(old, ["k"]), checksums(new, ["k"]), ["k"])
    return {r.k for r in parts.collect()}


def test_checksums_see_every_change_and_no_order(spark):
    schema = "k int, a string, b string"
    rows = [(1, "x", None), (1, "x", None), (2, None, "x"), (None, "y", "z"), (3, "x", "y"), (3, "y", "x")]
    df = spark.createDataFrame(rows, schema)
    assert changed(df, spark.createDataFrame(rows[::-1], schema).select("b", "k", "a")) == set()
    swapped = [(2, "x", None) if r[0] == 2 else r for r in rows]
    assert changed(df, spark.createDataFrame(swapped, schema)) == {2}
    # One copy less, a part that is gone, and one that is new.
    assert changed(df, spark.createDataFrame(rows[1:3] + [(4, "n", "n")], schema)) == {1, 3, 4, None}
    assert changed(df.limit(0), df.limit(0)) == set()


@pytest.fixture
def few_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_only_changed_seasons_are_read(spark, tmp_path, few_tasks):
    base, full = str(tmp_path / "base"), str(tmp_path / "full")
    new = (2003, "2003/x", "Maart", "p9", "duck", 500, "G", "g")
    first, second = counts(spark), counts(spark, [new, (None, "?", "Maart", "p9", "duck", 1, "G", "g")])
    paths = {}
    for day, df in ((MONDAY, first), (TUESDAY, second)):
        paths[day] = write_counts(df, base, day)
        updates.write_checksums(spark.read.parquet(paths[day]), base, day)
    write_counts(totals.fold_counts(first), base, MONDAY, name="folded_counts")
    seasons = updates.changed_seasons(spark, *(f"{base}/counts_checksums/snapshot={d}" for d in (MONDAY, TUESDAY)))
    assert set(seasons) == {2003, None}
    # Nothing can be read of the other seasons: their files hold no table.
    schema = spark.read.parquet(paths[TUESDAY]).schema
    for file in Path(paths[TUESDAY]).glob("season_start=*/*.parquet"):
        if file.parent.name not in ("season_start=2003", "season_start=__HIVE_DEFAULT_PARTITION__"):
            file.write_bytes(b"not a table")
    found = updates.fold_changes(spark.read.schema(schema).parquet(paths[TUESDAY]), seasons, base, TUESDAY, MONDAY)
    wanted = spark.read.parquet(write_counts(totals.fold_counts(second), full, TUESDAY))
    assert rows_of(found) == rows_of(wanted)


def charts_of(df):
    points = df.groupBy("taxon", "season_start").agg(F.sum("individuals").cast("double").alias("mean"))
    points = points.where("season_start IS NOT NULL")
    every = points.groupBy("season_start").agg(F.sum("mean").alias("mean"))
    return {
        "taxa": Chart(points, "mean", ("taxon",), ("taxon",)),
        "all": Chart(every, "mean"),
        "bars": Chart(points, "mean", ("taxon",), ("taxon",), smooth=False),
    }


def test_only_curves_of_changed_pages_are_fitted(spark, tmp_path, few_tasks):
    base, full = str(tmp_path / "base"), str(tmp_path / "full")
    extra = [(2003, "2003/x", "Maart", "p9", "duck", 500, "G", "g")]
    extra += [(s, f"{s}/x", "Maart", "p9", "swan", s % 7, "G", "g") for s in range(1999, 2009)]
    first, second = charts_of(counts(spark)), charts_of(counts(spark, extra).where("taxon <> 'Wulp'"))
    write_charts(first, base, MONDAY)
    assert updates.write_changed_charts(second, base, TUESDAY, MONDAY) == {"taxa": 3, "all": 1}
    write_charts(second, full, TUESDAY)
    for name in ("taxa", "taxa_curve", "all", "all_curve", "bars"):
        found, wanted = (spark.read.parquet(f"{b}/snapshot={TUESDAY}/chart={name}") for b in (base, full))
        assert rows_of(found) == rows_of(wanted), name
        if name == "taxa_curve":
            assert {r.taxon for r in found.select("taxon").distinct().collect()} == {"duck", "goose", "swan"}
    # Nothing changed: nothing is fitted, and the tables stay.
    later = TUESDAY + dt.timedelta(1)
    assert updates.write_changed_charts(second, base, later, TUESDAY) == {"taxa": 0, "all": 0}
    again = spark.read.parquet(f"{base}/snapshot={later}/chart=taxa_curve")
    assert rows_of(again) == rows_of(spark.read.parquet(f"{full}/snapshot={TUESDAY}/chart=taxa_curve"))
