"""Local quadratic regression (LOESS) per series, with a 95% band.

A series is first reduced to one entry per distinct x: number of points, sum of y and squared
deviations of y. These combine map-side, so a series with a third of all points shuffles no more
than any other. The entries of one series (as many as there are seasons) then form one row. Every
entry meets the fixed number of grid places, and the sums per place need no further shuffle,
because rows are still partitioned by series.

The fit at x0 is linear in y. With tricube weights w inside the distance h of the q-th nearest
point, dx = x - x0, A_k = sum(w dx^k), B_k = sum(w dx^k y) and C_k = sum(w^2 dx^k), a point at x
has the weight

    l(x) = w (k0 - k1 dx + k2 dx^2) / det
    k0 = A2 A4 - A3^2,  k1 = A1 A4 - A2 A3,  k2 = A1 A3 - A2^2,  det = A0 k0 - A1 k1 + A2 k2

and the fitted value is sum(l y) = (B0 k0 - B1 k1 + B2 k2) / det; sum(l^2) follows from C_k alike.

For the band, L holds the weights at the points themselves and M = I - L; then d1 = tr(M M'),
d2 = tr((M M')^2), s^2 = RSS / d1, se = s sqrt(sum(l^2)) and the degrees of freedom are
d1^2 / d2. Points at the same x have the same weights, so these sums run over distinct x with
multiplicities, within the row of the series.

Expressions over arrays are written as SQL text, one column per step, so that no step is worked
out twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.fixed_values import SMOOTH_POINTS, SMOOTH_SPAN
from fieldtally.functions.student import t_quantile_975

#: Distinct x with positive weight that a quadratic needs.
MIN_SUPPORT = 3
#: A fit whose residuals have less freedom than this per point runs through its points: what is
#: left of d1 is rounding, and the residuals tell nothing about their scale.
SATURATED = 1e-9

# One element per distinct x, in ascending order: x, points c, sum of y sy, squared deviations ss.
# Points without x go here and not by a filter on the points: that would slip below the totals that
# a plan shares between a ranking and its series, and their scan would run twice.
_ENTRIES = "sort_array(filter(collect_list(struct(x, c, sy, ss)), e -> e.x IS NOT NULL))"

# Shortest runs of entries that hold at least q points, by their first and last x. The q nearest
# points of any place lie in one of them.
_SPANS = """
filter(
  transform(entries, (e, i) -> named_struct('lo', e.x, 'hi',
    try_element_at(filter(entries, (f, j) -> j >= i AND upto[j] - upto[i] + e.c >= q), 1).x)),
  s -> s.hi IS NOT NULL)
"""
_UPTO = """
transform(entries, (e, i) -> aggregate(slice(entries, 1, i + 1), 0D, (t, f) -> t + f.c))
"""


def _reach(place: str) -> str:
    """Distance of the q-th nearest point, points at the same x counted one by one."""
    return f"array_min(transform(spans, s -> greatest({place} - s.lo, s.hi - {place})))"


# Weights of the entries at the entries themselves, for all places of one series.
_KERNEL = """
transform(entries, e -> if(abs(e.x - p.x0) < p.h, pow(1 - pow(abs(e.x - p.x0) / p.h, 3), 3), 0D))
"""
_MOMENTS = """
aggregate(
  zip_with(entries, p.w, (e, w) -> named_struct('cw', e.c * w, 'dx', e.x - p.x0)),
  named_struct('a0', 0D, 'a1', 0D, 'a2', 0D, 'a3', 0D, 'a4', 0D),
  (a, t) -> named_struct(
    'a0', a.a0 + t.cw,
    'a1', a.a1 + t.cw * t.dx,
    'a2', a.a2 + t.cw * t.dx * t.dx,
    'a3', a.a3 + t.cw * t.dx * t.dx * t.dx,
    'a4', a.a4 + t.cw * t.dx * t.dx * t.dx * t.dx))
"""
_COFACTORS = """
named_struct(
  'k0', p.a.a2 * p.a.a4 - p.a.a3 * p.a.a3,
  'k1', p.a.a1 * p.a.a4 - p.a.a2 * p.a.a3,
  'k2', p.a.a1 * p.a.a3 - p.a.a2 * p.a.a2)
"""
_FIT_WEIGHTS = f"""
if(size(filter(p.w, w -> w > 0)) >= {MIN_SUPPORT},
   zip_with(entries, p.w, (e, w) ->
     try_divide(
       w * (p.k.k0 - p.k.k1 * (e.x - p.x0) + p.k.k2 * (e.x - p.x0) * (e.x - p.x0)),
       p.a.a0 * p.k.k0 - p.a.a1 * p.k.k1 + p.a.a2 * p.k.k2)),
   NULL)
"""


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (total, v) -> total + v)"


def _fitted(weights: str) -> str:
    """Fitted value from the weights of the entries at one place."""
    return _sum(f"zip_with(entries, {weights}, (e, l) -> e.sy * l)")


def _squares(weights: str) -> str:
    """Sum of squared weights over all points."""
    return _sum(f"zip_with(entries, {weights}, (e, l) -> e.c * l * l)")


def _over_entries(term: str) -> str:
    """Sum of a term over the entry numbers ``j``."""
    return _sum(f"transform(numbers, j -> {term})")


def censor(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Values outside the closed range become null, as axis limits do before a fit."""
    return df.withColumn(value, F.when(F.col(value).between(low, high), F.col(value)))


def target_gap(df: DataFrame, value: str, target: float) -> DataFrame:
    """Add the target level and how far the value is above it."""
    return df.withColumn("target", F.lit(target)).withColumn("gap", F.col(value) - F.lit(target))


def _steps(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns one after another; each may use those before it."""
    for name, text in columns.items():
        df = df.withColumn(name, F.expr(text))
    return df


def _series_key(by: Sequence[str]) -> Column:
    parts = [F.col(c) for c in by] or [F.lit(0).alias("all")]
    return F.struct(*parts).alias("series")


def _series_columns(by: Sequence[str]) -> list[Column]:
    return [F.col("series").getField(c).alias(c) for c in by]


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _gathered(
    df: DataFrame, by: Sequence[str], x: str, y: str, tasks: int | None
) -> DataFrame:
    """One row per series of two or more distinct x: its entries.

    The columns that name a series travel as the struct ``series``, so they may have any name.
    Series are spread over ``tasks``, by default all shuffle partitions: their rows are few but
    costly, and would otherwise be merged into a handful of tasks for being small.
    """
    points = (
        df.select(
            _series_key(by), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
        )
        .filter("y IS NOT NULL")
        .groupBy("series", "x")
        .agg(
            F.expr("cast(count(1) AS double) AS c"),
            F.expr("sum(y) AS sy"),
            F.expr("var_pop(y) * count(1) AS ss"),
        )
    )
    return (
        points.repartition(tasks or shuffle_partitions(df), "series")
        .groupBy("series")
        .agg(F.expr(_ENTRIES).alias("entries"))
        .filter("size(entries) > 1")
    )


def _series(
    df: DataFrame, by: Sequence[str], x: str, y: str, span: float, tasks: int | None
) -> DataFrame:
    """One row per series: entries, number of points n, q, and the shortest spans of q points."""
    return _steps(
        _gathered(df, by, x, y, tasks),
        {
            "n": _sum("transform(entries, e -> e.c)"),
            "q": f"floor(n * {span!r}D + 1e-5D)",
            "upto": _UPTO,
            "spans": _SPANS,
        },
    )


def _fits(series: DataFrame, points: int, carried: Sequence[str] = ()) -> DataFrame:
    """Fitted value and sum of squared weights of each series at the places of its grid.

    ``carried`` columns of the series stay with its places.
    """
    key = ["series", *carried]
    last = points - 1
    places = series.withColumns(
        {"lo": F.expr("entries[0].x"), "hi": F.expr("entries[size(entries) - 1].x")}
    ).selectExpr(
        *key,
        "entries",
        "spans",
        f"posexplode(transform(sequence(0, {last}), i -> lo + i * ((hi - lo) / {last}))) "
        "AS (step, x0)",
    )
    return _fits_at(places, key)


def _fits_at(places: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fitted value, slope and sum of squared weights at places (key, entries, spans, step, x0)."""
    met = _steps(
        places.withColumn("h", F.expr(_reach("x0"))).selectExpr(
            *key, "step", "x0", "h", "inline(entries)"
        ),
        {
            "dx": "x - x0",
            "t": "try_divide(abs(dx), h)",
            "u": "1 - t * t * t",
            "w": "if(abs(dx) < h, u * u * u, 0D)",
            "dx2": "dx * dx",
        },
    )
    sums = {
        "a0": "c * w",
        "a1": "c * w * dx",
        "a2": "c * w * dx2",
        "a3": "c * w * dx2 * dx",
        "a4": "c * w * dx2 * dx2",
        "b0": "w * sy",
        "b1": "w * sy * dx",
        "b2": "w * sy * dx2",
        "c0": "c * w * w",
        "c1": "c * w * w * dx",
        "c2": "c * w * w * dx2",
        "c3": "c * w * w * dx2 * dx",
        "c4": "c * w * w * dx2 * dx2",
    }
    added = met.groupBy(*key, "step", "x0").agg(
        F.expr("count_if(w > 0) AS support"),
        *[F.expr(f"sum({term}) AS {name}") for name, term in sums.items()],
    )
    return _steps(
        added,
        {
            "k0": "a2 * a4 - a3 * a3",
            "k1": "a1 * a4 - a2 * a3",
            "k2": "a1 * a3 - a2 * a2",
            "det": f"if(support >= {MIN_SUPPORT}, a0 * k0 - a1 * k1 + a2 * k2, NULL)",
            "fit": "try_divide(b0 * k0 - b1 * k1 + b2 * k2, det)",
            "slope": "try_divide(b1 * (a0 * a4 - a2 * a2) - b0 * k1 - b2 * (a0 * a3 - a1 * a2), det)",
            "squares": "try_divide(k0 * k0 * c0 - 2 * k0 * k1 * c1 "
            "+ (k1 * k1 + 2 * k0 * k2) * c2 - 2 * k1 * k2 * c3 + k2 * k2 * c4, det * det)",
        },
    )


def smoothed_trend(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    points: int = SMOOTH_POINTS,
    tasks: int | None = None,
) -> DataFrame:
    """Fitted curve per series on an even grid: ``step`` from 0, ``x``, ``fit``.

    ``x`` has few distinct values, such as seasons: those of a series form one row.
    Null where fewer than three distinct x carry weight. Series with one distinct x are left out.
    """
    return _fits(_series(df, by, x, y, span, tasks), points).select(
        *_series_columns(by), "step", F.col("x0").alias("x"), "fit"
    )


def _residual_scale(series: DataFrame) -> DataFrame:
    """Series with the weights ``hat`` at their own points and the scale of their residuals."""
    places = _reach("p.x")
    # overlap is L + L' - LL', of which M M' = I - overlap: symmetric, so one half is enough.
    product = "aggregate(zip_with(cl, other, (a, b) -> a * b), 0D, (t, v) -> t + v)"
    pairs = _sum(
        "transform(overlap[j], (v, k) -> if(k < j, 2, 1) * entries[j].c * entries[k].c * v * v)"
    )
    return _steps(
        series,
        {
            "numbers": "sequence(0, size(entries) - 1)",
            "reached": f"transform(entries, p -> named_struct('x0', p.x, 'h', {places}))",
            "weighed": f"transform(reached, p -> named_struct('x0', p.x0, 'w', {_KERNEL}))",
            "summed": f"transform(weighed, p -> "
            f"named_struct('x0', p.x0, 'w', p.w, 'a', {_MOMENTS}))",
            "solved": f"transform(summed, p -> "
            f"named_struct('x0', p.x0, 'w', p.w, 'a', p.a, 'k', {_COFACTORS}))",
            "hat": f"transform(solved, p -> {_FIT_WEIGHTS})",
            "scaled": "transform(hat, row -> zip_with(entries, row, (e, l) -> e.c * l))",
            "overlap": f"""transform(scaled, (cl, j) -> transform(slice(hat, 1, j + 1),
                (other, k) -> hat[j][k] + other[j] - {product}))""",
            "d1": f"n - 2 * {_over_entries('scaled[j][j]')} "
            f"+ {_over_entries('entries[j].c * ' + _squares('hat[j]'))}",
            "d2": f"n - 2 * {_over_entries('entries[j].c * overlap[j][j]')} "
            f"+ {_over_entries(pairs)}",
            "misfit": f"transform(numbers, j -> entries[j].sy / entries[j].c "
            f"- {_fitted('hat[j]')})",
            "rss": _over_entries("entries[j].ss + entries[j].c * misfit[j] * misfit[j]"),
            "free": f"d1 > n * {SATURATED!r}D",
            "s": "if(free, sqrt(rss / d1), NULL)",
            "df": "if(free, d1 * d1 / d2, NULL)",
        },
    )


def residual_scale(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    tasks: int | None = None,
) -> DataFrame:
    """Per series of two or more x: ``n_points``, ``d1``, ``d2``, ``rss``, ``s`` and ``df``.

    ``x`` has few distinct values, such as seasons, as in `smoothed_band`. A fit that runs through
    all points leaves ``s`` and ``df`` empty.
    """
    return _residual_scale(_series(df, by, x, y, span, tasks)).select(
        *_series_columns(by),
        F.col("n").cast("bigint").alias("n_points"),
        "d1",
        "d2",
        "rss",
        "s",
        "df",
    )


def smoothed_band(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    points: int = SMOOTH_POINTS,
    tasks: int | None = None,
) -> DataFrame:
    """Fitted curve with standard error and 95% band; both null where a fit runs through its points.

    ``x`` has few distinct values, such as seasons: those of a series meet in one row, each with
    each. Points may be any number. `wide_band.wide_band` is the same for many distinct x.
    """
    scaled = _residual_scale(_series(df, by, x, y, span, tasks)).withColumn(
        "half", t_quantile_975("df") * F.col("s")
    )
    return (
        _fits(scaled, points, ("s", "half"))
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
