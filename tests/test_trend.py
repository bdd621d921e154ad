"""Trend and band against brute force in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.functions import student
from fieldtally.operators import trend


def _hat(x, places, span=0.75):
    """Rows of the local quadratic fit, one least-squares problem per place."""
    q = int(math.floor(len(x) * span + 1e-5))
    rows = []
    for x0 in places:
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        design = np.vander(x - x0, 3, increasing=True)
        rows.append(np.linalg.solve(design.T @ (w[:, None] * design), design.T * w)[0])
    return np.array(rows)


def _noisy_sine(n):
    x = np.arange(n, dtype=float) + 1991
    return x, 100 * np.sin(x / 5) + np.cos(17 * x) * 9


def _tied(seasons, rounds):
    x = np.repeat(np.arange(seasons, dtype=float), rounds)
    return x, 50 * np.sin(x) + np.cos(np.arange(len(x)) * 3.7) * 10


CASES = {"one_per_season": _noisy_sine(33), "six_per_season": _tied(20, 6)}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, int(a), float(b)) for k, (x, y) in CASES.items() for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "series string, season int, y double")


@pytest.mark.parametrize("name", CASES)
def test_band_equals_brute_force(series, name):
    x, y = CASES[name]
    found = (
        trend.smoothed_band(series, ["series"], "season", "y")
        .filter(F.col("series") == name)
        .orderBy("step")
        .toPandas()
    )
    grid = np.linspace(x.min(), x.max(), 80)
    residual = np.eye(len(x)) - _hat(x, x)
    d1 = np.trace(residual @ residual.T)
    s = math.sqrt(((residual @ y) ** 2).sum() / d1)
    weights = _hat(x, grid)
    assert found.x.to_numpy() == pytest.approx(grid)
    assert found.fit.to_numpy() == pytest.approx(weights @ y, abs=1e-8)
    assert found.se.to_numpy() == pytest.approx(s * np.sqrt((weights**2).sum(axis=1)), abs=1e-8)
    assert ((found.upper + found.lower) / 2).to_numpy() == pytest.approx(found.fit.to_numpy())
    assert ((found.upper - found.fit) / found.se > 1.96).all()


@pytest.mark.parametrize("name", CASES)
def test_residual_scale_equals_brute_force(series, name):
    x, y = CASES[name]
    row = (
        trend.residual_scale(series, ["series"], "season", "y")
        .filter(F.col("series") == name)
        .collect()[0]
    )
    residual = np.eye(len(x)) - _hat(x, x)
    product = residual @ residual.T
    assert row.n_points == len(x)
    assert row.d1 == pytest.approx(np.trace(product), rel=1e-9)
    assert row.d2 == pytest.approx(np.trace(product @ product), rel=1e-9)
    assert row.rss == pytest.approx(((residual @ y) ** 2).sum(), rel=1e-9)
    assert row.df == pytest.approx(np.trace(product) ** 2 / np.trace(product @ product))


@pytest.mark.parametrize(("n", "degrees"), [(6, None), (7, 2.0), (8, 2.0)])
def test_short_series(spark, n, degrees):
    """Six points are run through: no scale. From seven on there is a band, however wide."""
    x, y = _noisy_sine(n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    scale = trend.residual_scale(df, [], "x", "y").collect()[0]
    band = trend.smoothed_band(df, [], "x", "y").orderBy("step").toPandas()
    assert band.fit.to_numpy() == pytest.approx(_hat(x, np.linspace(x[0], x[-1], 80)) @ y)
    if degrees is None:
        assert abs(scale.d1) < 1e-9 and scale.s is None and scale.df is None
        assert band.se.isna().all() and band.lower.isna().all()
        return
    residual = np.eye(n) - _hat(x, x)
    product = residual @ residual.T
    df_wanted = np.trace(product) ** 2 / np.trace(product @ product)
    assert scale.df == pytest.approx(df_wanted) and 1 <= scale.df < 4
    assert scale.s == pytest.approx(math.sqrt(((residual @ y) ** 2).sum() / np.trace(product)))
    t = student.quantile(df_wanted)
    assert ((band.upper - band.fit) / band.se).to_numpy() == pytest.approx(np.full(80, t))


def test_trend_equals_the_curve_of_the_band(series):
    band = trend.smoothed_band(series, ["series"], "season", "y").select("series", "step", "fit")
    curve = trend.smoothed_trend(series, ["series"], "season", "y").select("series", "step", "fit")
    assert band.exceptAll(curve).count() == 0


def _fit(spark, points):
    df = spark.createDataFrame([(float(a), b) for a, b in points], "x double, y double")
    return [r.fit for r in trend.smoothed_trend(df, [], "x", "y").orderBy("step").collect()]


def test_short_series_has_no_fit(spark):
    fit = _fit(spark, [(a, 1.0) for a in range(5)])
    assert len(fit) == 80 and set(fit) == {None}


def test_single_x_gives_no_curve(spark):
    assert _fit(spark, [(1, 1.0), (1, 2.0)]) == []


def test_constant_stays_constant(spark):
    assert _fit(spark, [(a, 7.0) for a in range(10)]) == pytest.approx([7.0] * 80)


def test_quadratic_is_exact(spark):
    fit = _fit(spark, [(a, 2.0 * a * a - a + 3) for a in range(10)])
    grid = np.linspace(0, 9, 80)
    assert fit == pytest.approx(list(2 * grid**2 - grid + 3))


def test_missing_values_are_left_out(spark):
    points = [(a, float(a)) for a in range(10)]
    assert _fit(spark, [*points, (3, None)]) == pytest.approx(_fit(spark, points))


def test_values_outside_the_limits_are_left_out(spark):
    points = [(a, float(a)) for a in range(10)]
    df = spark.createDataFrame([*points, (4, 1000.0), (5, -1.0)], "x int, y double")
    fit = trend.smoothed_trend(trend.censor(df, "y", 0, 100), [], "x", "y").orderBy("step")
    assert [r.fit for r in fit.collect()] == pytest.approx(_fit(spark, points))


def test_hot_series_is_combined_before_the_shuffle(spark):
    """Half a million points of one series reach the second shuffle as one row per season."""
    df = spark.range(500_000).selectExpr(
        "if(id % 3 = 0, 'hot', CAST(id % 50 AS string)) AS series",
        "CAST(id % 30 AS int) AS season",
        "CAST(id % 7 AS double) AS y",
    )
    fitted = trend.smoothed_trend(df, ["series"], "season", "y")
    assert fitted.groupBy("series").count().filter("count <> 80").count() == 0
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "partial_var_pop" in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_series_without_a_name_keeps_its_band(spark):
    rows = [(k, a, float(a % 5 + a)) for k in (None, "x") for a in range(20)]
    df = spark.createDataFrame(rows, "k string, a int, y double")
    found = trend.smoothed_band(df, ["k"], "a", "y")
    assert found.filter("se IS NULL").count() == 0
    assert {r.k: r["count"] for r in found.groupBy("k").count().collect()} == {None: 80, "x": 80}


def test_series_are_spread_over_all_shuffle_partitions(spark):
    """Small rows, long work: adaptive execution must not merge them into one task."""
    df = spark.range(64 * 20).selectExpr("id % 64 AS s", "CAST(id DIV 64 AS int) AS x", "id AS y")
    fitted = trend.smoothed_trend(df, ["s"], "x", "y")
    tasks = fitted.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_most_points_at_one_x(spark):
    """The q nearest points all lie at x = 1: no distance, no weight, no fit there, no error."""
    points = [(1, float(i)) for i in range(30)] + [(a, 1.0) for a in (0, 2, 3, 4)]
    df = spark.createDataFrame([(float(a), b) for a, b in points], "x double, y double")
    found = trend.smoothed_band(df, [], "x", "y", points=5).orderBy("step").collect()
    assert [r.x for r in found] == [0, 1, 2, 3, 4]
    assert found[1].fit is None and {r.se for r in found} == {None}
    assert trend.residual_scale(df, [], "x", "y").collect()[0].d1 is None
