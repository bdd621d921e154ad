"""Tables written in order: files in the order of their names, rows in order within each file.

A range sort: each task gets a range of the keys, so no task sees more than its share. Rows with equal
keys are ordered by all their other columns and then by a number of their own, so a key with very many
rows, or a row with very many copies, fills several files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Equal rows are spread over this many sort keys.
_COPIES = 1 << 16


def _key(name: str) -> Column:
    """Ascending, missing values last; a name after a minus sign: descending, missing values last."""
    if name.startswith("-"):
        return F.col(f"`{name[1:]}`").desc_nulls_last()
    return F.col(f"`{name}`").asc_nulls_last()


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], parts: int | None = None) -> str:
    """Write the frame as Parquet in the order of the keys; returns the path.

    ``parts`` fixes the number of files; otherwise adaptive execution merges neighbouring small ranges.
    """
    named = {k.removeprefix("-") for k in keys}
    salt = "__salt"
    while salt in df.columns:
        salt += "_"
    salted = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(_COPIES)))
    order = [_key(k) for k in keys] + [_key(c) for c in df.columns if c not in named] + [F.col(salt)]
    ranged = salted.repartitionByRange(parts, *order) if parts else salted.repartitionByRange(*order)
    # Sorted for the writer alone; the file says nothing of the salt.
    sorted_rows = ranged.sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in df.columns])
    sorted_rows.write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(path)
    return path


def read_ordered(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """The rows with their place in the order, from 1.

    The place is the row's number in its file and the rows of the files before; that is one row per file.
    """
    rows = spark.read.parquet(path)
    if place in rows.columns:
        raise ValueError(f"the table has a column {place}")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.select(
        *columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    sizes = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(sizes, "__file").select(*columns, (F.col("__before") + F.col("__row") + 1).alias(place))
