"""Column functions: missing values, seasons, labels, levels, quantile."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import labels, missing, student


def test_strict_aggregates_keep_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", None)], "k string, v bigint")
    found = {
        r.k: (r.s, r.m, r.x)
        for r in df.groupBy("k")
        .agg(
            missing.strict_sum("v").alias("s"),
            missing.strict_mean("v").alias("m"),
            missing.strict_max("v").alias("x"),
        )
        .collect()
    }
    assert found == {"a": (4, 2.0, 3), "b": (None, None, None)}


def test_strict_sum_where_looks_at_its_scope_only(spark):
    df = spark.createDataFrame(
        [("a", True, 1), ("a", False, None), ("b", True, None), ("c", False, 5)],
        "k string, inside boolean, v bigint",
    )
    total = missing.strict_sum_where(F.col("inside"), "v").alias("s")
    assert {r.k: r.s for r in df.groupBy("k").agg(total).collect()} == {
        "a": 1,
        "b": None,
        "c": None,
    }


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 3)], "a bigint, b bigint")
    assert [r[0] for r in df.select(missing.ratio("a", "b")).collect()] == [0.5, None, None]


def test_blank_to_null(spark):
    df = spark.createDataFrame([("",), ("  ",), ("NA",), (" x ",), (None,)], "t string")
    found = [r[0] for r in df.select(missing.blank_to_null("t")).collect()]
    assert found == [None, None, None, "x", None]


def test_season_start_of_label(spark):
    df = spark.createDataFrame([("1991/92",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(labels.season_start("s")).collect()] == [1991, None, None]


def test_season_rules(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 10),), (dt.date(2020, 10, 10),)], "d date")
    for rule, wanted in (("calendar_year", [2020, 2020]), ("winter_start", [2019, 2020])):
        assert [r[0] for r in df.select(labels.season_of_date("d", rule)).collect()] == wanted
    with pytest.raises(ValueError):
        labels.season_of_date("d", "other")


def test_within_winters_equals_the_season_filter(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1993-01-01', DATE'2002-12-31')) AS d")
    season = labels.season_of_date("d", "winter_start")
    wrong = days.filter(
        labels.within_winters("d", 1994, 2001) != ((season > 1994) & (season < 2001))
    )
    assert wrong.count() == 0


def test_season_label(spark):
    df = spark.createDataFrame([(1991,), (1999,), (2008,)], "y int")
    found = [r[0] for r in df.select(labels.season_label("y")).collect()]
    assert found == ["1991/92", "1999/00", "2008/09"]


def test_relabel(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    found = df.select(
        labels.relabel("c", {"a": "x"}), labels.relabel("c", {"a": "x"}, keep_unlisted=True)
    ).collect()
    assert [tuple(r) for r in found] == [("x", "x"), (None, "b"), (None, None)]


def test_levels(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    found = df.select(
        labels.listed_level("c", ["a", "b"]), labels.level_order("c", ["a", "b"])
    ).collect()
    assert [tuple(r) for r in found] == [("b", 2), (None, None), (None, None)]


def test_shorten(spark):
    df = spark.createDataFrame([("Polder van X",), ("Y",), (None,)], "c string")
    assert [r[0] for r in df.select(labels.shorten("c", "van X", "PX")).collect()] == [
        "PX",
        "Y",
        None,
    ]


def test_t_quantile_against_tables(spark):
    # fixed values: 97.5% points of t from printed tables
    table = {
        1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 5: 2.5706, 10: 2.2281, 30: 2.0423,
        120: 1.9799, 1e9: 1.95996,
    }
    values = [(float(v),) for v in table] + [(1.37,), (6.5,), (None,), (1 - 1e-12,)]
    df = spark.createDataFrame(values, "v double")
    found = {r[0]: r[1] for r in df.select("v", student.t_quantile_975("v")).collect()}
    assert found.pop(None) is None
    for v, quantile in found.items():
        assert quantile == pytest.approx(table.get(v, student.quantile(max(v, 1))), abs=6e-5)
