"""Differences of readings, bucketed tables and ordered files on hand-made rows."""

from collections import Counter

import pytest
from compare import executed_plan
from pyspark.sql import functions as F

from fieldtally.fixture import mapping
from fieldtally.operators import differences
from fieldtally.sources import ordered, warehouse

SCHEMA = "place string, n int"


def changes(old, new):
    columns = differences.changed_rows(old, new).collect()
    return {(r.place, r.n): (r.n_gained, r.n_lost) for r in columns}


def test_copies_and_missing_values(spark):
    old = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, None), ("c", 3)], SCHEMA)
    new = spark.createDataFrame([("a", 1), ("b", None), (None, None), (None, None), ("d", 4)], SCHEMA)
    assert changes(old, new) == {("a", 1): (0, 1), (None, None): (1, 0), ("c", 3): (0, 1), ("d", 4): (1, 0)}
    assert changes(old, old) == {} and changes(old.limit(0), old.limit(0)) == {}
    # Columns are matched by name, and a choice of them may be compared.
    assert changes(old.select("n", "place"), old) == {}
    places = differences.changed_rows(old, new, ["place"]).collect()
    assert {r.place: r.n_gained - r.n_lost for r in places} == {"a": -1, None: 1, "c": -1, "d": 1}
    found = differences.changes_per_group(old, new, ["place"]).collect()
    assert {r.place: tuple(r)[1:] for r in found} == {
        "a": (2, 1, 0, 1), "b": (1, 1, 0, 0), None: (1, 2, 1, 0), "c": (1, 0, 0, 1), "d": (0, 1, 1, 0)
    }


def test_readings_of_other_columns_are_refused(spark):
    old = spark.createDataFrame([("a", 1)], SCHEMA)
    with pytest.raises(ValueError, match="different columns"):
        differences.changed_rows(old, old.withColumn("x", F.lit(1)))
    with pytest.raises(ValueError, match="names of results"):
        differences.changed_rows(old.withColumn("n_lost", F.lit(1)), old.withColumn("n_lost", F.lit(1)))


def test_a_hot_row_is_combined_before_the_shuffle(spark):
    hot = spark.range(0, 300_000, 1, 8).select(F.lit("hot").alias("place"), F.lit(1).alias("n"))
    df = differences.changed_rows(hot.limit(299_990), hot)
    assert [tuple(r) for r in df.collect()] == [("hot", 1, 10, 0)]
    plan = executed_plan(differences.changed_rows(hot.where("place <> 'x'"), hot))
    aggregated = plan.split("Exchange hashpartitioning")[1]
    assert "partial_sum" in aggregated and "Join" not in plan


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_bucketed_tables_meet_without_a_shuffle(spark, testdata, no_broadcast, capsys):
    tables = mapping.SurveyTables(spark, testdata)
    parts = {warehouse.FACT: tables._fact(), warehouse.SAMPLES: tables._samples(), "other": tables.taxa()}
    made = warehouse.with_buckets(parts, 4)
    assert made["other"] is parts["other"]
    fact, samples = made[warehouse.FACT], made[warehouse.SAMPLES]
    columns = ("sample_key", "individuals", "coverage")
    plain = (tables._fact(), tables._samples(), [], mapping.STATUSES, mapping.SKIP_COVERAGE, mapping.ANALYSIS_SETS, columns)
    joined = warehouse.star_counts(fact, samples, *plain[2:])
    plan = executed_plan(joined)
    join = plan.index("SortMergeJoin")
    # Below the join nothing is dealt by the key; the filter of the samples is built aside and looked up
    # where the counts are read.
    assert "Exchange hashpartitioning(sample_key" not in plan[join:]
    joined.explain("formatted")
    described = capsys.readouterr().out
    # Counts and samples, and the samples once more for the filter.
    assert described.count("SelectedBucketsCount: 4 out of 4") >= 2
    assert "might_contain" in described and "bloom_filter_agg" in described
    assert changed_pairs(joined, warehouse.star_counts(*plain)) == 0
    # One file per bucket.
    assert fact.select(F.input_file_name()).distinct().count() <= 4


def changed_pairs(a, b):
    return differences.changed_rows(a, b).count()


@pytest.mark.parametrize("parts", [None, 6])
def test_files_in_name_order_are_sorted(spark, tmp_path, parts):
    rows = [(i % 7 if i % 3 else None, "hot" if i % 3 else f"p{i % 40}", i % 11) for i in range(4000)]
    df = spark.createDataFrame(rows, "season int, place string, `a.b` int").repartition(8)
    path = ordered.write_ordered(df, str(tmp_path / "out"), ["season", "-place"], parts)
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    read = [tuple(r) for f in files for r in spark.read.parquet(str(f)).collect()]
    by = sorted(sorted(rows, key=lambda r: r[2]), key=lambda r: r[1], reverse=True)
    wanted = sorted(by, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:2] for r in read] == [r[:2] for r in wanted] and Counter(read) == Counter(rows)
    placed = ordered.read_ordered(spark, path, "nth").orderBy("nth").collect()
    assert [tuple(r)[:3] for r in placed] == read
    assert [r.nth for r in placed] == list(range(1, len(rows) + 1))
    if parts:
        # A key, and a repeated row, may fill several files.
        same = spark.createDataFrame([(1, "x", 2)], df.schema).crossJoin(spark.range(3000)).drop("id")
        ordered.write_ordered(same, path, ["season"], parts)
        sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
        assert len(sizes) == parts and max(r["count"] for r in sizes) < 1500


def test_an_empty_table_in_order(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    path = ordered.write_ordered(empty, str(tmp_path / "none"), ["place"])
    assert ordered.read_ordered(spark, path, "nth").collect() == []
    with pytest.raises(ValueError, match="has a column place"):
        ordered.read_ordered(spark, path)
