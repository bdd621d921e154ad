"""CSV records with line breaks inside quotes, read split by split.

Whether a line of a file begins inside a quoted text depends on the number of quotes before it, from
the start of the file on. Only its parity counts, and parities add up: each split counts its own, a
running sum over the splits of a file gives the parity at which each one begins, and then every split
finds its records alone. So a large file keeps all its splits, where Spark's `multiLine` reads it in one
task.

1. Each split is reduced to one row: parity of its quotes, and whether a record begins in it, for either
   parity at its start.
2. One row per split comes to the driver: about 60 bytes for each `spark.sql.files.maxPartitionBytes` of
   text, whatever is in the files.
3. Each split joins the lines of its own records. A record that goes on in the next splits leaves a
   piece in each; only those pieces are shuffled, by the split that the record began in.

In this dialect a quote inside a quoted text is doubled, so it does not change the parity. A quote in a
text without quotes around it is not of the dialect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIELDS = "file bigint, block bigint, size bigint"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, value): lines with the split that they are read from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("size"),
        "value",
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Rows of one split after another."""
    keys = [batch.column(i).to_numpy() for i in range(3)]
    change = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield tuple(int(k[a]) for k in keys), batch.slice(a, b - a)


def _before(lines: pa.Array) -> tuple[np.ndarray, int]:
    """(quotes before each line, quotes of all lines)."""
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(quotes)
    return total - quotes, int(total[-1])


def split_parities(spark: SparkSession, path: str) -> DataFrame:
    """One row per split: file, block, size, odd (parity of its quotes), begins (for an even and an odd start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for key, rows in _runs(batch):
                odd, *begins = made.get(key, [0, 0, 0])
                before, total = _before(rows.column(3))
                inside = (before + odd) % 2
                made[key] = [(odd + total) % 2, begins[0] | int((inside == 0).any()), begins[1] | int((inside == 1).any())]
        columns = [list(c) for c in zip(*[(*k, *v) for k, v in made.items()], strict=True)] or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["file", "block", "size", "odd", "even_start", "odd_start"]
        )

    schema = f"{_FIELDS}, odd bigint, even_start bigint, odd_start bigint"
    return _lines(spark, path).mapInArrow(run, schema)


def _starts(parities: DataFrame) -> DataFrame:
    """Per split: whether it begins inside quotes, and the split that the record at its start began in."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parities.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begins = F.when(F.col("inside") == 0, F.col("even_start")).otherwise(F.col("odd_start")) == 1
    owner = F.last(F.when(begins, F.col("block")), ignorenulls=True).over(before)
    return starts.select("file", "block", "size", "inside", owner.alias("owner"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(is_header, record): the records of CSV files, line breaks inside quotes kept; blank lines left out.

    is_header: the first record of a file. A record without its closing quote ends with the file.
    """
    starts = {
        (r["file"], r["block"], r["size"]): (r["inside"], r["owner"])
        for r in _starts(split_parities(spark, path)).toLocalIterator()
    }
    names = ["file", "owner", "block", "is_header", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int, int] | None = None
        odd, owner, pending, continued, first = 0, 0, [], False, False

        def made(texts: pa.Array | list[str], is_header: bool = False, piece: bool = False) -> pa.RecordBatch:
            n = len(texts)
            columns = [
                pa.array([key[0]] * n, pa.int64()),
                pa.array([owner] * n, pa.int64()),
                pa.array([key[1] if piece else None] * n, pa.int64()),
                pa.array([is_header] * n, pa.bool_()),
                pa.array(texts, pa.string()) if isinstance(texts, list) else texts,
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def last() -> Iterator[pa.RecordBatch]:
            """The record at the end of a split: a piece, where it began before or goes on behind."""
            if pending:
                yield made(["\n".join(pending)], first, piece=continued or bool(odd))

        for batch in batches:
            for own, rows in _runs(batch):
                if own != key:
                    yield from last()
                    key = own
                    # Splits are cut alike in both passes; a file that changed in between is an error.
                    odd, owner = starts[own]
                    pending, continued, first = [], bool(odd), own[1] == 0
                lines = rows.column(3)
                before, total = _before(lines)
                begins = np.flatnonzero((before + odd) % 2 == 0)
                odd = (odd + total) % 2
                if not len(begins):
                    pending += lines.to_pylist()
                    continue
                pending += lines.slice(0, begins[0]).to_pylist()
                if pending:
                    # What was open ends here: in this split, or as the last piece of an earlier record.
                    yield made(["\n".join(pending)], first, piece=continued)
                    first = False
                continued, owner = False, key[1]
                whole = begins[:-1]
                if len(whole) and first:
                    yield made(["\n".join(lines.slice(0, begins[1]).to_pylist())], True)
                    whole, first = whole[1:], False
                ends = pa.array(np.r_[whole, begins[-1]].astype(np.int32))
                yield made(pc.binary_join(pa.ListArray.from_arrays(ends, lines.cast(pa.string())), "\n"))
                pending = lines.slice(begins[-1]).to_pylist()
        if key is not None:
            yield from last()

    # block: null for a whole record, else the place of a piece.
    found = _lines(spark, path).mapInArrow(run, "file bigint, owner bigint, block bigint, is_header boolean, record string")
    whole = found.where(F.col("block").isNull()).select("is_header", "record")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
    joined = (
        found.where(F.col("block").isNotNull())
        .groupBy("file", "owner")
        .agg(F.bool_or("is_header").alias("is_header"), F.array_join(pieces, "\n").alias("record"))
    )
    # Where line breaks have two characters, the first one is left at the end. Inside quotes they become one.
    both = whole.unionByName(joined.select("is_header", "record"))
    two = F.col("record").endswith("\r")
    one = F.replace(F.rtrim(F.col("record"), F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
    return both.withColumn("record", F.when(two, one).otherwise(F.col("record"))).where("record <> ''")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files as text, by the names in their header."""
    options = {"quote": '"', "escape": '"', "multiLine": True}
    names = spark.read.options(header=True, **options).csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {k: str(v) for k, v in options.items()}
    rows = records(spark, path).where("NOT is_header")
    return rows.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
