"""Snapshots as files: exported CSV in, dated snapshots and season-partitioned counts out.

The CSV dialect is that of the exports: text in quotes, a quote inside it doubled, backslashes
without meaning. Text in quotes may hold line breaks: `line_breaks` says how such files are read,
"none" (there are none; one pass), "split" (two passes, every split of a file by its own task), or
"file" (one task per file).
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed
from fieldtally.functions.labels import season_start
from fieldtally.functions.missing import blank_to_null
from fieldtally.sources import quoted


def _typed(text: Column, kind: str) -> Column:
    """Text as the declared type; whole numbers may be written as 12, 12.0 or 1e+05."""
    if kind != "bigint":
        return text.try_cast(kind)
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), whole)


def _text(
    spark: SparkSession, path: str, header: Mapping[str, tuple[str, str]], line_breaks: str
) -> DataFrame:
    """Listed columns as they are written."""
    if line_breaks not in ("none", "split", "file"):
        raise ValueError(f"no way of reading line breaks: {line_breaks}")
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=line_breaks == "file")
    raw = quoted.read_text(spark, path) if line_breaks == "split" else reader.csv(path)
    absent = [name for name in header if name not in raw.columns]
    if absent:
        raise ValueError(f"columns not in {path}: {absent}")
    return raw.select(*[blank_to_null(F.col(f"`{source}`")).alias(source) for source in header])


def _read_csv(
    spark: SparkSession,
    path: str,
    header: Mapping[str, tuple[str, str]],
    line_breaks: str = "none",
) -> DataFrame:
    """Listed columns by header name, each with its declared type.

    Types are not inferred, which would read the files twice. Row-number columns without a name
    and columns not listed are left out. Empty text and ``NA`` become null, as does text that is
    not of the declared type; `unparsed_cells` counts such text.
    """
    return _text(spark, path, header, line_breaks).select(
        *[
            _typed(F.col(f"`{source}`"), kind).alias(name)
            for source, (name, kind) in header.items()
        ]
    )


def unparsed_cells(
    spark: SparkSession,
    path: str,
    header: Mapping[str, tuple[str, str]],
    multiline: bool = False,
    line_breaks: str = "none",
) -> DataFrame:
    """Per column: cells with text, and those of them that are not of the declared type. One pass."""
    text = _text(spark, path, header, "file" if multiline else line_breaks)
    counted = text.agg(
        *[
            F.struct(
                F.count(f"`{source}`").alias("n_cells"),
                F.count_if(
                    F.col(f"`{source}`").isNotNull() & _typed(F.col(f"`{source}`"), kind).isNull()
                ).alias("n_unparsed"),
            ).alias(name)
            for source, (name, kind) in header.items()
        ]
    )
    rows = [
        F.struct(F.lit(name).alias("column"), F.col(f"{name}.n_cells"), F.col(f"{name}.n_unparsed"))
        for name, _ in header.values()
    ]
    return counted.select(F.inline(F.array(*rows)))


def read_counts(spark: SparkSession, path: str, line_breaks: str = "split") -> DataFrame:
    """Counts are large: their files stay splittable, also with line breaks inside quoted text."""
    return _read_csv(spark, path, fixed.COUNTS_HEADER, line_breaks)


def read_membership(
    spark: SparkSession, path: str, multiline: bool = False, line_breaks: str = "split"
) -> DataFrame:
    """``multiline`` says the same as line breaks read by file."""
    return _read_csv(spark, path, fixed.MEMBERSHIP_HEADER, "file" if multiline else line_breaks)


def read_second_source(
    spark: SparkSession, path: str, multiline: bool = False, line_breaks: str = "split"
) -> DataFrame:
    """``multiline`` says the same as line breaks read by file."""
    return _read_csv(spark, path, fixed.SECOND_SOURCE_HEADER, "file" if multiline else line_breaks)


def write_csv_snapshot(df: DataFrame, base: str, name: str, day: date) -> str:
    """CSV export into the folder of its date, nulls written as ``NA``; returns its path."""
    path = f"{base}/{name}/snapshot={day.isoformat()}"
    writer = df.write.mode("overwrite")
    # Blanks at the ends of a text are kept; a backslash is a sign like any other.
    writer = writer.options(header=True, nullValue="NA", quote='"', escape='"')
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def with_exported_names(df: DataFrame, header: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Columns renamed back to the headers of the exported files."""
    return df.select(*[F.col(name).alias(source) for source, (name, _) in header.items()])


def write_counts(counts: DataFrame, base: str, day: date, name: str = "counts") -> str:
    """Counts as Parquet partitioned by season, so that a period filter skips whole seasons.

    Rows are rebalanced on the season first: adaptive execution splits a hot season over several
    tasks and files and merges small ones.
    """
    path = f"{base}/{name}/snapshot={day.isoformat()}"
    if "season_start" not in counts.columns:
        counts = counts.withColumn("season_start", season_start("season"))
    (
        counts.hint("rebalance", "season_start")
        .write.mode("overwrite")
        .partitionBy("season_start")
        .parquet(path)
    )
    return path


def write_chart_data(
    df: DataFrame, base: str, day: date, chart: str, by: tuple[str, ...] = ()
) -> str:
    """The table behind a chart of a day, with one folder per value of ``by`` (such as taxon).

    The chart's folder of that day is replaced whole: a value that is gone leaves nothing behind.
    """
    path = f"{base}/snapshot={day.isoformat()}/chart={chart}"
    writer = df.hint("rebalance", *by) if by else df
    writer = writer.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path
