"""Residual scale and 95% band of series with many distinct x, from tiles that add up.

The band of `operators.trend` lets the distinct x of a series meet each with each in one row. Here the
places of a series are cut into blocks, and every two blocks of a series are a tile, a row of its own
that any task may work on. With L the weights of all points at the points themselves (one row of L per
distinct x) a tile holds the rows of its two blocks only, a few columns at a time, and gives its part of

    d1 = n - 2 tr(L) + sum(L^2),   d2 = n - 2 tr(V) + sum(V^2),   V = L + L' - L L',   RSS

with points at the same x counted by their number. The parts of a series are sums and are added up by
grouping. L itself is worked out in each tile from the entries of the series (x, number of points, sum
and spread of y), which are all that is sent: memory of a task is linear in the distinct x of a series,
its work in a tile as well. The fits at the grid need no tiles and are those of `operators.trend`.

Numpy multiplies the blocks; everything else is built-in functions. Missing values: points without x or
y take no part; a series with a place at which fewer than three x carry weight has neither scale nor
band, as one whose fit runs through its points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.fixed_values import SMOOTH_POINTS, SMOOTH_SPAN
from fieldtally.functions.student import t_quantile_975
from fieldtally.operators.trend import (
    MIN_SUPPORT,
    SATURATED,
    _fits,
    _gathered,
    _series,
    _series_columns,
    shuffle_partitions,
)
from fieldtally.session import share_package

#: Distinct x of a block, and those of the series that are looked at together.
BLOCK = 512
COLUMNS = 4096


class Series:
    """Distinct x of a series in ascending order: number of points, sum and squared deviations of y."""

    def __init__(self, x: np.ndarray, c: np.ndarray, sy: np.ndarray, ss: np.ndarray, span: float):
        self.x, self.c, self.sy, self.ss = x, c, sy, ss
        upto = np.cumsum(c)
        q = np.floor(upto[-1] * span + 1e-5)
        # The shortest runs of entries that hold q points.
        last = np.maximum(np.searchsorted(upto, upto - c + q), np.arange(len(x)))
        full = last < len(x)
        self.low, self.high = x[full], x[last[full]]

    def columns(self) -> Iterator[slice]:
        for start in range(0, len(self.x), COLUMNS):
            yield slice(start, start + COLUMNS)

    def kernel(self, place: np.ndarray, reach: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """(weight, distance) of the entries `at` for each place."""
        dx = self.x[at] - place[:, None]
        far = np.abs(dx)
        inside = far < reach[:, None]
        ratio = np.divide(far, reach[:, None], out=np.ones_like(far), where=inside)
        return np.where(inside, (1 - ratio**3) ** 3, 0.0), dx

    def solved(self, rows: slice) -> tuple[np.ndarray, ...]:
        """(place, reach, three factors over the determinant) of the fits at these entries."""
        place = self.x[rows]
        reach = np.full(len(place), np.inf)
        for start in range(0, len(self.low), COLUMNS):
            at = slice(start, start + COLUMNS)
            span = np.maximum(place[:, None] - self.low[at], self.high[at] - place[:, None])
            reach = np.minimum(reach, span.min(axis=1))
        a = np.zeros((5, len(place)))
        support = np.zeros(len(place), dtype=np.int64)
        for at in self.columns():
            w, dx = self.kernel(place, reach, at)
            support += (w > 0).sum(axis=1)
            term = w * self.c[at]
            for k in range(5):
                a[k] += term.sum(axis=1)
                term = term * dx
        k0, k1, k2 = a[2] * a[4] - a[3] * a[3], a[1] * a[4] - a[2] * a[3], a[1] * a[3] - a[2] * a[2]
        det = a[0] * k0 - a[1] * k1 + a[2] * k2
        det = np.where((support >= MIN_SUPPORT) & (det != 0), det, np.nan)
        return place, reach, k0 / det, k1 / det, k2 / det

    def hat(self, solved: tuple[np.ndarray, ...], at: slice) -> np.ndarray:
        """Weight of one point at each of the entries `at` in the fits (row)."""
        place, reach, k0, k1, k2 = solved
        w, dx = self.kernel(place, reach, at)
        return w * (k0[:, None] - k1[:, None] * dx + k2[:, None] * dx * dx)

    def tile(self, a: slice, b: slice) -> tuple[float, float, float]:
        """Parts of d1, d2 and RSS; those of each block alone go to the tile of the block with itself."""
        same = a == b
        first = self.solved(a)
        second = first if same else self.solved(b)
        met = np.zeros((len(first[0]), len(second[0])))
        fit = np.zeros(len(first[0]))
        squares = np.zeros(len(first[0]))
        for at in self.columns():
            left = self.hat(first, at)
            right = left if same else self.hat(second, at)
            met += (left * self.c[at]) @ right.T
            if same:
                fit += left @ self.sy[at]
                squares += (left * left) @ self.c[at]
        own = self.hat(first, b)
        overlap = own + (own if same else self.hat(second, a)).T - met
        pairs = self.c[a] @ (overlap * overlap) @ self.c[b]
        if not same:
            return 0.0, 2 * pairs, 0.0
        c = self.c[a]
        misfit = self.sy[a] / c - fit
        d1 = c.sum() - 2 * (c * np.diag(own)).sum() + (c * squares).sum()
        d2 = c.sum() - 2 * (c * np.diag(overlap)).sum() + pairs
        return d1, d2, (self.ss[a] + c * misfit * misfit).sum()


def tiles(
    df: DataFrame, by: Sequence[str], x: str, y: str, span: float, block: int, tasks: int | None
) -> DataFrame:
    """(series, n, d1, d2, rss): the part of every tile; n counts the points of a block once."""
    share_package(df.sparkSession)
    gathered = _gathered(df, by, x, y, tasks)
    cut = gathered.withColumn("blocks", F.ceil(F.size("entries") / block).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"))
    cut = cut.select("*", F.explode(F.sequence(F.col("a"), F.col("blocks") - 1)).alias("b"))
    cut = cut.select("series", "a", "b", *[F.col(f"entries.{c}").alias(c) for c in ("x", "c", "sy", "ss")])
    spread = cut.repartition(tasks or shuffle_partitions(df), "series", "a", "b")
    parts = ("n", "d1", "d2", "rss")
    schema = T.StructType([cut.schema["series"], *[T.StructField(p, T.DoubleType()) for p in parts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                a, b = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                values = [batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(3, 7)]
                own = Series(*values, span)
                rows = [slice(k * block, min((k + 1) * block, len(own.x))) for k in (a, b)]
                made.append((own.c[rows[0]].sum() if a == b else 0.0, *own.tile(*rows)))
            columns = [pa.array(c, pa.float64()) for c in np.array(made).reshape(-1, len(parts)).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["series", *parts])

    return spread.mapInArrow(run, schema)


def _scale(
    df: DataFrame, by: Sequence[str], x: str, y: str, span: float, block: int, tasks: int | None
) -> DataFrame:
    """(series, n, d1, d2, rss, s, df) per series."""
    added = tiles(df, by, x, y, span, block, tasks).groupBy("series").agg(
        F.sum("n").alias("n"), *[F.nullif(F.sum(c), F.lit(float("nan"))).alias(c) for c in ("d1", "d2", "rss")]
    )
    free = F.col("d1") > F.col("n") * SATURATED
    return added.withColumns(
        {
            "s": F.when(free, F.sqrt(F.col("rss") / F.col("d1"))),
            "df": F.when(free, F.col("d1") * F.col("d1") / F.col("d2")),
        }
    )


def wide_residual_scale(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    block: int = BLOCK,
    tasks: int | None = None,
) -> DataFrame:
    """The columns of `trend.residual_scale`, for any number of distinct x."""
    return _scale(df, by, x, y, span, block, tasks).select(
        *_series_columns(by), F.col("n").cast("bigint").alias("n_points"), "d1", "d2", "rss", "s", "df"
    )


def wide_band(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    points: int = SMOOTH_POINTS,
    block: int = BLOCK,
    tasks: int | None = None,
) -> DataFrame:
    """The columns of `trend.smoothed_band`, for any number of distinct x."""
    scaled = _scale(df, by, x, y, span, block, tasks).select(
        F.col("series").alias("scaled"), "s", (t_quantile_975("df") * F.col("s")).alias("half")
    )
    fits = _fits(_series(df, by, x, y, span, tasks), points)
    return (
        fits.join(scaled, F.col("series").eqNullSafe(F.col("scaled")))
        .withColumn("spread", F.sqrt("squares"))
        .select(
            *_series_columns(by),
            "step",
            F.col("x0").alias("x"),
            "fit",
            F.expr("s * spread AS se"),
            F.expr("fit - half * spread AS lower"),
            F.expr("fit + half * spread AS upper"),
        )
    )
