"""Local quadratic regression at a few vertices, blended between them.

The direct fit (`operators.trend`) works out a regression at every place of the grid. Here a series is
cut into cells; the regression, with its slope, is worked out only at the cells' ends, and a cubic with
these values and slopes at both ends runs through each cell.

Cells: the range of x, widened by 10% of its width on either side, is the first one. A cell with more
than floor(n * span * cell) of the n points is cut at the median of its points (the mean of the two
middle ones, if their number is even); points at the cut are on its left. A cell whose points all lie
on one side of its median stays, as does one that was cut `LEVELS` times. Halves of halves hold that
few points after three cuts, unless many points share an x.

Near the data's own bends the curve departs from the direct fit by what a cubic cannot follow between
two vertices (on the tests' waves by 2.9% of the curve's height at most); both agree at the vertices,
in value, and everywhere where the series itself is a polynomial of second degree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.fixed_values import SMOOTH_POINTS, SMOOTH_SPAN
from fieldtally.operators.trend import _fits_at, _series, _series_columns, _steps

#: Largest part of the points that a fit uses which a cell may hold.
CELL = 0.2
#: Width that the first cell has beyond the points, on either side, as part of their range.
MARGIN = 0.1
LEVELS = 6

# x of the r-th point of a cell: the first entry up to which there are that many.
_NTH = "element_at(filter(entries, (e, i) -> i >= c.a AND upto[i] - c.n0 >= {rank}), 1).x"
_MEDIAN = f"""
transform(cells, c -> named_struct('a', c.a, 'b', c.b, 'n0', c.n0, 'n', c.n, 'cut',
  if(c.n > room, ({_NTH.format(rank="floor((c.n + 1) / 2)")} + {_NTH.format(rank="floor(c.n / 2) + 1")}) / 2, NULL)))
"""
# Entries a to b of a cell, and the points before them (n0) and in them (n).
_HALVES = """
flatten(transform(cut, c -> if(
  c.cut IS NULL OR entries[c.b].x <= c.cut,
  array(named_struct('a', c.a, 'b', c.b, 'n0', c.n0, 'n', c.n)),
  transform(
    array(size(filter(entries, e -> e.x <= c.cut))),
    k -> array(
      named_struct('a', c.a, 'b', k - 1, 'n0', c.n0, 'n', upto[k - 1] - c.n0),
      named_struct('a', k, 'b', c.b, 'n0', upto[k - 1], 'n', c.n0 + c.n - upto[k - 1])))[0])))
"""
_CUTS = "transform(filter(cut, c -> c.cut IS NOT NULL AND entries[c.b].x > c.cut), c -> c.cut)"


def vertices(series: DataFrame, span: float, cell: float = CELL, levels: int = LEVELS) -> DataFrame:
    """Series rows with ``vertices``, ascending: both ends of the first cell and every cut."""
    last = "entries[size(entries) - 1].x"
    margin = f"({last} - entries[0].x) * {MARGIN!r}D"
    found = _steps(
        series,
        {
            "room": f"floor(n * {span!r}D * {cell!r}D + 1e-5D)",
            "cells": "array(named_struct('a', 0, 'b', size(entries) - 1, 'n0', 0D, 'n', n))",
            "vertices": f"array(entries[0].x - {margin}, {last} + {margin})",
        },
    )
    for _ in range(levels):
        found = _steps(found, {"cut": _MEDIAN, "cells": _HALVES, "vertices": f"concat(vertices, {_CUTS})"})
    return found.withColumn("vertices", F.sort_array("vertices")).drop("cells", "cut", "room")


# Values of the cubic with given values and slopes at both ends, at t of its way.
_CUBIC = """
(2 * t * t * t - 3 * t * t + 1) * v.fit + (t * t * t - 2 * t * t + t) * width * v.slope
+ (3 * t * t - 2 * t * t * t) * u.fit + (t * t * t - t * t) * width * u.slope
"""


def blended_trend(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    points: int = SMOOTH_POINTS,
    cell: float = CELL,
    tasks: int | None = None,
) -> DataFrame:
    """Blended curve per series on an even grid: ``step`` from 0, ``x``, ``fit``.

    The columns are those of `trend.smoothed_trend`. Null beside a vertex at which fewer than three
    distinct x carry weight. Series with one distinct x are left out. Regressions are as many as
    vertices, about eight for a series, whatever the number of places.
    """
    series = vertices(_series(df, by, x, y, span, tasks), span, cell)
    places = series.selectExpr("series", "entries", "spans", "posexplode(vertices) AS (step, x0)")
    fitted = _fits_at(places, ["series"]).groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("x0", "fit", "slope"))).alias("at")
    )
    last = points - 1
    # The first cell is wider than the range of the points by the same part on both sides.
    ends = _steps(
        fitted,
        {
            "low": "at[0].x0",
            "high": "at[size(at) - 1].x0",
            "inset": f"(high - low) * {MARGIN / (1 + 2 * MARGIN)!r}D",
        },
    )
    grid = ends.selectExpr(
        "series",
        "at",
        f"posexplode(transform(sequence(0, {last}), "
        f"i -> low + inset + i * ((high - low - 2 * inset) / {last}))) AS (step, x0)",
    )
    made = _steps(
        grid,
        {
            "left": "size(filter(at, p -> p.x0 <= x0))",
            "v": "at[left - 1]",
            "u": "at[left]",
            "width": "u.x0 - v.x0",
            "t": "(x0 - v.x0) / width",
            "blend": _CUBIC,
        },
    )
    return made.select(*_series_columns(by), "step", F.col("x0").alias("x"), F.col("blend").alias("fit"))
