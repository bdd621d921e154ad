"""The penalised spline against least squares in numpy, on every point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import spline


def frame(spark, series):
    rows = [(name, x, y) for name, points in series.items() for x, y in points]
    return spark.createDataFrame(rows, "name string, x double, y double")


def wave(n, each=1, seed=1, noise=2.0):
    rng = np.random.default_rng(seed)
    x = np.repeat(np.sort(rng.random(n)) * 40 + 1980, each)
    y = 20 * np.sin(x / 5) + noise * rng.normal(size=len(x))
    return list(zip(x.tolist(), y.tolist(), strict=True))


def cox_de_boor(x, low, high, cells):
    """Cubic B-splines by their recursion, on knots that go on evenly beyond the ends."""
    width = (high - low) / cells
    knots = low + width * np.arange(-3, cells + 4)
    last = np.clip(((x - low) / width).astype(int), 0, cells - 1) + 3
    made = (np.arange(len(knots) - 1) == last[:, None]).astype(float)
    for d in range(1, 4):
        up = (x[:, None] - knots[: -d - 1]) / (d * width)
        down = (knots[d + 1 :] - x[:, None]) / (d * width)
        made = up * made[:, :-1] + down * made[:, 1:]
    return made


def brute(points, penalties=spline.PENALTIES, cells=spline.CELLS):
    """(grid, fit, penalty, edf): stacked least squares, and the hat matrix of all points."""
    x, y = np.array([p for p in points if None not in p]).T
    design = cox_de_boor(x, x.min(), x.max(), cells)
    bends = np.diff(np.eye(cells + 3), n=2, axis=0)
    scored = []
    for size in penalties:
        stacked = np.vstack([design, np.sqrt(size) * bends])
        inverse = np.linalg.pinv(stacked)
        edf = np.trace(design @ inverse[:, : len(x)])
        b = inverse[:, : len(x)] @ y
        score = len(x) * ((y - design @ b) ** 2).sum() / (len(x) - edf) ** 2 if len(x) - edf > spline.FREE else np.inf
        scored.append((score, size, edf, b))
    best = min(scored, key=lambda s: (s[0], s[1]))
    if best[0] == np.inf:
        best = scored[-1]
    grid = np.linspace(x.min(), x.max(), 80)
    return grid, cox_de_boor(grid, x.min(), x.max(), cells) @ best[3], best[1], best[2]


SERIES = {
    "wave": wave(60),
    "rounds": wave(20, 6, seed=2),
    "rough": wave(80, seed=3, noise=30.0),
    "few": wave(5, seed=4),
    "gaps": [(0.0, 1.0), (1.0, 3.0), (100.0, 2.0), (101.0, 5.0), (None, 2.0), (3.0, None)],
    "two": [(1.0, 2.0), (5.0, 10.0)],
    None: wave(30, seed=5),
}


@pytest.mark.parametrize("penalties", [spline.PENALTIES, (1.0,), (100.0,)])
def test_curve_is_that_of_numpy(spark, penalties):
    df = frame(spark, SERIES | {"one": [(1.0, 2.0)] * 3})
    found = spline.spline_trend(df, ["name"], "x", "y", penalties=penalties).orderBy("step").toPandas()
    assert found.columns.tolist() == ["name", "step", "x", "fit", "penalty", "edf"]
    assert len(found) == 80 * len(SERIES)
    for name, points in SERIES.items():
        own = found[found.name.isna() if name is None else found.name == name]
        grid, fit, size, edf = brute(points, penalties)
        assert own.x.to_numpy() == pytest.approx(grid), name
        assert set(own.penalty) == {size}, name
        assert own.edf.to_numpy() == pytest.approx(np.full(80, edf), abs=1e-6), name
        assert own.fit.to_numpy() == pytest.approx(fit, abs=1e-5), name


def test_a_line_is_kept_whatever_the_penalty(spark):
    df = frame(spark, {"line": [(float(i), 3.0 - 2.0 * i) for i in range(30)]})
    for size in (0.01, 1e6):
        made = spline.spline_trend(df, ["name"], "x", "y", penalties=[size]).collect()
        assert [r.fit for r in made] == pytest.approx([3 - 2 * r.x for r in made], abs=1e-6)


def test_long_series_are_reduced_before_the_shuffle(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("name"),
        (F.col("id") % 7919).cast("double").alias("x"),
        F.sin(F.col("id") % 7919 / 900).alias("y"),
    )
    sums = spline._cell_sums(df, ["name"], "x", "y", 10).collect()
    assert len(sums) == 51 and max(len(r.sums) for r in sums) == 10
    assert sum(r.n for r in sums) == 200_000
    made = spline.spline_trend(df, ["name"], "x", "y").where("name = 'hot'").collect()
    assert [r.fit for r in made] == pytest.approx([np.sin(r.x / 900) for r in made], abs=0.01)


def test_no_points_no_curve(spark):
    df = frame(spark, {"one": [(1.0, 1.0)]})
    assert spline.spline_trend(df, ["name"], "x", "y").count() == 0
    assert spline.spline_trend(df.limit(0), [], "x", "y").count() == 0
