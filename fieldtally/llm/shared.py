"""What the operators of this folder have in common: the shared folder, ids of workers, text batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of text worked on at a time inside a task; one longer text is still taken whole.
CHUNK = 1 << 19


#: Bytes of rows that go to a Python worker, or come back, at a time; one longer row still goes whole.
BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package by the driver's own path, where they share it.

    Rows go to them by BATCH bytes where the session has Spark's own 64 MB, which both sides hold several times.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{64 << 20}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, or one like it, that none of the columns has (names differ by more than case)."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def named(columns: Iterable[str]) -> list[Column]:
    """The columns, whatever signs are in their names."""
    return [F.col(f"`{c}`") for c in columns]


def with_text(docs: DataFrame, text: str, kept: list[str]) -> tuple[DataFrame, list[T.StructField]]:
    """(the text, then the kept columns, under plain names; the fields of the kept columns)."""
    columns = [c.alias(f"c{i}") for i, c in enumerate(named([text, *kept]))]
    return docs.select(*columns), [docs.select(*named(kept)).schema[i] for i in range(len(kept))]


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share (`spark.checkpoint.dir`).

    Where the session names none, as in tests, a folder beside the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: its lineage ends there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, end, texts) of consecutive runs of about `size` bytes, one text at least.

    Only the run at hand is turned into Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes), column.slice(start).to_pylist()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every bit of x over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists over one flat array."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
