"""The band from tiles: equal to the one worked out in a row, and to numpy; spread over tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import trend, wide_band

def near(found, wanted):
    return found is wanted is None or found == pytest.approx(wanted, rel=1e-7, abs=1e-7)


SCALE = ("n_points", "d1", "d2", "rss", "s", "df")


def noisy(n, each=1, seed=3):
    rng = np.random.default_rng(seed)
    x = np.repeat(np.sort(rng.choice(3 * n, n, replace=False)).astype(float), each)
    return list(zip(x.tolist(), (50 * np.sin(x / n * 6) + rng.normal(size=len(x)) * 5).tolist(), strict=True))


def frame(spark, series):
    rows = [(name, x, y) for name, points in series.items() for x, y in points]
    return spark.createDataFrame(rows, "name string, x double, y double")


SERIES = {
    "plain": noisy(40),
    "rounds": noisy(25, 6),
    "hot": [(3.0, float(i % 7)) for i in range(300)] + noisy(30, seed=4),
    "six": noisy(6),
    "seven": noisy(7),
    "three": [(1.0, 2.0), (2.0, 5.0), (3.0, 1.0)],
    "two": [(1.0, 2.0), (4.0, 3.0)],
    "one": [(1.0, 2.0)] * 4,
    "gaps": [*noisy(20, seed=8), (5.5, None), (None, 3.0)],
    None: noisy(12, seed=9),
}


@pytest.mark.parametrize("block", [4, 7, 512])
def test_tiles_add_up_to_the_scale_of_a_row(spark, block):
    df = frame(spark, SERIES)
    wanted = {r.name: r for r in trend.residual_scale(df, ["name"], "x", "y").collect()}
    found = {r.name: r for r in wide_band.wide_residual_scale(df, ["name"], "x", "y", block=block).collect()}
    assert set(found) == set(wanted) == set(SERIES) - {"one"}
    for name, row in found.items():
        for c in SCALE:
            assert near(row[c], wanted[name][c]), (name, c, row[c], wanted[name][c])


def test_band_is_that_of_a_row(spark):
    df = frame(spark, SERIES)
    keys = ["name", "step"]
    wanted = {(r.name, r.step): r for r in trend.smoothed_band(df, ["name"], "x", "y").collect()}
    found = {(r.name, r.step): r for r in wide_band.wide_band(df, ["name"], "x", "y", block=8).collect()}
    assert set(found) == set(wanted) and len(found) == 80 * (len(SERIES) - 1)
    for key, row in found.items():
        for c in set(row.asDict()) - set(keys):
            assert near(row[c], wanted[key][c]), (key, c, row[c], wanted[key][c])


def hat(x, span=0.75):
    q = math.floor(len(x) * span + 1e-5)
    d = np.abs(x - x[:, None])
    h = np.sort(d, axis=1)[:, q - 1 : q]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
    dx = x - x[:, None]
    a = [(w * dx**k).sum(axis=1, keepdims=True) for k in range(5)]
    k0, k1, k2 = a[2] * a[4] - a[3] ** 2, a[1] * a[4] - a[2] * a[3], a[1] * a[3] - a[2] ** 2
    return w * (k0 - k1 * dx + k2 * dx * dx) / (a[0] * k0 - a[1] * k1 + a[2] * k2)


def test_many_distinct_x_are_spread_over_tasks(spark):
    points = noisy(5000)
    df = frame(spark, {"days": points})
    made = wide_band.tiles(df, ["name"], "x", "y", 0.75, wide_band.BLOCK, 8)
    rows = made.select("*", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 10 * 11 // 2 and len({r.task for r in rows}) >= 6
    x, y = np.array(points).T
    left = np.eye(len(x)) - hat(x)
    product = left @ left.T
    assert sum(r.n for r in rows) == 5000
    assert sum(r.d1 for r in rows) == pytest.approx(np.trace(product), rel=1e-9)
    assert sum(r.d2 for r in rows) == pytest.approx((product * product).sum(), rel=1e-9)
    assert sum(r.rss for r in rows) == pytest.approx(((left @ y) ** 2).sum(), rel=1e-9)


def test_columns_are_looked_at_in_parts(monkeypatch):
    x, y = np.array(noisy(200)).T
    values = x, np.ones(200), y, np.zeros(200)
    whole = wide_band.Series(*values, 0.75).tile(slice(0, 64), slice(64, 128))
    monkeypatch.setattr(wide_band, "COLUMNS", 17)
    assert wide_band.Series(*values, 0.75).tile(slice(0, 64), slice(64, 128)) == pytest.approx(whole)


def test_no_points_no_band(spark):
    df = frame(spark, {"one": [(1.0, 1.0)]})
    assert wide_band.wide_band(df, ["name"], "x", "y").count() == 0
    assert wide_band.wide_band(df.limit(0), [], "x", "y").count() == 0
