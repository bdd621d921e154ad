"""Penalised cubic spline per series, from grouped normal equations, smoothed by cross-validation.

The local fit of `operators.trend` compares every place with every point. Here a series is a sum of
cubic B-splines over `CELLS` even cells of its range of x, with a penalty on the second differences of
their coefficients; its cost does not depend on the number of distinct x, so it suits long series.

1. Points are reduced to one entry per (series, x), then per (series, cell): sums of t^0 to t^6 and of
   y t^0 to y t^3, t being the place in the cell. Both combine map-side; a series with a third of all
   points shuffles as few rows as any other.
2. These sums make the normal equations A b = r of the series exactly: a row of `CELLS` cells.
3. For each penalty L of a fixed grid, (A + L P) b = r is solved; edf = tr((A + L P)^-1 A), and the one
   with the least n RSS / (n - edf)^2 is taken (the smaller penalty, if equal). Penalties that leave
   no freedom are passed over; where all do, the largest is taken.

Missing values: points without x or y take no part. Series with one distinct x are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.fixed_values import SMOOTH_POINTS
from fieldtally.operators.trend import _series_columns, _series_key
from fieldtally.session import share_package

CELLS = 10
#: Penalties tried: 10^(k / 2).
PENALTIES = tuple(10 ** (k / 2) for k in range(-4, 13))
#: Least freedom that a penalty has to leave.
FREE = 1e-6

#: Splines of a cell (row) by the powers of t (column).
_SHAPE = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6


def basis(place: np.ndarray, cells: int) -> np.ndarray:
    """Splines (column) at places (row), in cells from 0 to `cells`."""
    cell = np.clip(np.floor(place).astype(int), 0, cells - 1)
    t = (place - cell)[:, None] ** np.arange(4)
    made = np.zeros((len(place), cells + 3))
    for k in range(4):
        made[np.arange(len(place)), cell + k] = t @ _SHAPE[k]
    return made


def penalty(cells: int) -> np.ndarray:
    second = np.diff(np.eye(cells + 3), n=2, axis=0)
    return second.T @ second


def equations(cell: np.ndarray, t: np.ndarray, yt: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(A, r) from the sums of t^0..t^6 and y t^0..t^3 of the cells that hold points."""
    a, r = np.zeros((cells + 3, cells + 3)), np.zeros(cells + 3)
    power = np.arange(4)[:, None] + np.arange(4)
    for i, c in enumerate(cell):
        own = slice(c, c + 4)
        a[own, own] += _SHAPE @ t[i][power] @ _SHAPE.T
        r[own] += _SHAPE @ yt[i]
    return a, r


def solved(
    a: np.ndarray, r: np.ndarray, yy: float, n: float, penalties: Sequence[float]
) -> tuple[np.ndarray, float, float]:
    """(coefficients, penalty, edf) of the penalty with the least cross-validation score."""
    best: tuple[float, np.ndarray, float, float] | None = None
    for size in penalties:
        both = np.linalg.solve(a + size * penalty(len(r) - 3), np.column_stack([r, a]))
        b, edf = both[:, 0], float(np.trace(both[:, 1:]))
        rss = max(yy - 2 * b @ r + b @ a @ b, 0.0)
        score = n * rss / (n - edf) ** 2 if n - edf > FREE else np.inf
        if best is None or score < best[0] or score == best[0] == np.inf:
            best = score, b, size, edf
    return best[1], best[2], best[3]


def _cell_sums(df: DataFrame, by: Sequence[str], x: str, y: str, cells: int) -> DataFrame:
    """(series, low, high, n, yy, sums): one row per series, at most `cells` sums in it."""
    points = df.select(_series_key(by), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    entries = (
        points.filter("y IS NOT NULL")
        .groupBy("series", "x")
        .agg(F.expr("cast(count(1) AS double) AS c"), F.expr("sum(y) AS sy"), F.expr("sum(y * y) AS syy"))
    )
    ranges = entries.groupBy(F.col("series").alias("of")).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    met = entries.join(ranges.filter("high > low"), F.col("series").eqNullSafe(F.col("of")))
    met = met.withColumn("place", F.expr(f"(x - low) / (high - low) * {cells}"))
    met = met.withColumn("cell", F.expr(f"least(cast(floor(place) AS int), {cells - 1})"))
    met = met.withColumn("t", F.expr("place - cell"))
    sums = [F.expr(f"sum(c * pow(t, {k})) AS t{k}") for k in range(7)]
    sums += [F.expr(f"sum(sy * pow(t, {k})) AS y{k}") for k in range(4)]
    per_cell = met.groupBy("series", "low", "high", "cell").agg(*sums, F.expr("sum(if(x IS NULL, NULL, syy)) AS syy"))
    listed = F.struct(
        "cell",
        F.array(*[f"t{k}" for k in range(7)]).alias("t"),
        F.array(*[f"y{k}" for k in range(4)]).alias("y"),
    )
    return per_cell.groupBy("series", "low", "high").agg(
        F.sum("t0").alias("n"),
        F.sum("syy").alias("yy"),
        # Not by a filter on the points: that would slip below totals that both reads share.
        F.filter(F.sort_array(F.collect_list(listed)), lambda s: s["cell"].isNotNull()).alias("sums"),
    )


def spline_trend(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    points: int = SMOOTH_POINTS,
    cells: int = CELLS,
    penalties: Sequence[float] = PENALTIES,
) -> DataFrame:
    """Curve per series on an even grid: ``step`` from 0, ``x``, ``fit``, and its ``penalty`` and ``edf``.

    One penalty alone fixes the smoothing.
    """
    share_package(df.sparkSession)
    sums = _cell_sums(df, by, x, y, cells)
    rows = sums.select("series", "low", "high", "n", "yy", "sums.cell", "sums.t", F.col("sums.y").alias("yt"))
    schema = T.StructType(
        [
            sums.schema["series"],
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
            T.StructField("penalty", T.DoubleType()),
            T.StructField("edf", T.DoubleType()),
            T.StructField("fits", T.ArrayType(T.DoubleType())),
        ]
    )
    grid = basis(np.linspace(0, cells, points), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            n, yy = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for i in range(batch.num_rows):
                cell, t, yt = (np.array(batch.column(k)[i].as_py()) for k in (5, 6, 7))
                b, size, edf = solved(*equations(cell, t, yt, cells), yy[i], n[i], penalties)
                made.append((size, edf, (grid @ b).tolist()))
            kinds = (pa.float64(), pa.float64(), pa.list_(pa.float64()))
            columns = [pa.array([row[k] for row in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns], names=schema.names)

    fitted = rows.mapInArrow(run, schema).select("*", F.posexplode("fits").alias("step", "fit"))
    return fitted.select(
        *_series_columns(by),
        "step",
        F.expr(f"low + step * ((high - low) / {points - 1})").alias("x"),
        "fit",
        "penalty",
        "edf",
    )
