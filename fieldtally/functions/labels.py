"""Column functions for seasons, code-to-label maps and ordered levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.missing import as_column

#: A winter season runs from 1 April to 31 March and is named after the year it starts in.
SEASON_FIRST_MONTH = 4


def season_start(label: Column | str) -> Column:
    """First four characters of a season label as a number; null if they are no number."""
    return F.substring(as_column(label), 1, 4).try_cast("int")


def season_of_date(day: Column | str, rule: str = "calendar_year") -> Column:
    """Season number of a date.

    ``calendar_year`` is the year of the date, so January to March fall one season later than in
    season-labelled counts; ``winter_start`` puts them in the winter that began the year before.
    """
    day = as_column(day)
    if rule == "calendar_year":
        return F.year(day)
    if rule == "winter_start":
        return F.year(day) - F.when(F.month(day) < SEASON_FIRST_MONTH, 1).otherwise(0)
    raise ValueError(f"unknown season rule {rule!r}")


def within_winters(day: Column | str, after: int, before: int) -> Column:
    """``after < winter season < before`` as a plain date range.

    The same rows as a filter on ``season_of_date(day, "winter_start")``, but a comparison with
    literals, so it reaches the Parquet scan as a pushed filter.
    """
    day = as_column(day)
    return (day >= F.lit(date(after + 1, SEASON_FIRST_MONTH, 1))) & (
        day < F.lit(date(before, SEASON_FIRST_MONTH, 1))
    )


def season_label(start: Column | str) -> Column:
    """Season label such as ``1999/00`` from the year the season starts in."""
    start = as_column(start)
    following = F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    return F.concat(start.cast("string"), F.lit("/"), following)


def relabel(c: Column | str, labels: Mapping, keep_unlisted: bool = False) -> Column:
    """Replace listed values; others become null, or stay as they are."""
    c = as_column(c)
    listed = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    found = F.try_element_at(listed, c)
    return F.coalesce(found, c) if keep_unlisted else found


def shorten(c: Column | str, pattern: str, short: str) -> Column:
    """``short`` where the text contains ``pattern``, else the text itself."""
    c = as_column(c)
    return F.when(c.contains(pattern), F.lit(short)).otherwise(c)


def listed_level(c: Column | str, levels: Sequence[str]) -> Column:
    """The value if it is one of the levels, else null."""
    c = as_column(c)
    return F.when(c.isin(*levels), c)


def level_order(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in the level list; null for unlisted values."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), as_column(c))
    return F.nullif(position, F.lit(0)).cast("int")
