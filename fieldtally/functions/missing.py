"""Column functions in which a missing value stays missing.

Spark's ``sum``/``avg``/``max`` skip nulls. The count analyses need the other rule: a group that
holds one missing value has a missing total, mean and maximum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _if_complete(c: Column, result: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), result)


def strict_sum(c: Column | str) -> Column:
    c = as_column(c)
    return _if_complete(c, F.sum(c))


def strict_mean(c: Column | str) -> Column:
    c = as_column(c)
    return _if_complete(c, F.avg(c))


def strict_max(c: Column | str) -> Column:
    c = as_column(c)
    return _if_complete(c, F.max(c))


def strict_sum_where(scope: Column, c: Column | str) -> Column:
    """Strict sum over the rows in ``scope``; null when the group has no row in scope."""
    c = as_column(c)
    return F.when(F.count_if(scope & c.isNull()) == 0, F.sum(F.when(scope, c)))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; null (not an error, not Inf) when the denominator is zero."""
    return F.try_divide(
        as_column(numerator).cast("double"), as_column(denominator).cast("double")
    )


def blank_to_null(c: Column | str) -> Column:
    """Text with outer blanks removed; empty text and the marker ``NA`` become null."""
    text = F.trim(as_column(c))
    return F.when(~text.isin("", "NA"), text)
