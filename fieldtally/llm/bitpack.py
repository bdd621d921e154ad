"""Token ids as bit-packed files.

A dataset is a folder of Parquet files that Spark writes and commits, so lost executors cost their
tasks only and any store that Spark reads will do. A row is a segment:

    shard, segment   its place: shards hold ascending ranges of documents, segments follow each other
    first_id         ids of the shard before it
    n_ids            ids in it
    doc_ids, counts  its documents and the ids of each, in ascending order
    payload          the ids

A payload is self-contained: a header (mark, bits per id, ids per block, number of ids), the byte
offset of each block and of the end, and the blocks. In a block each id takes the fewest bits that
hold the vocabulary, lowest bit first, 64 ids in as many 64-bit little-endian words as an id has
bits. An id is found by its block's offset; blocks unpack in numpy without a loop over ids.

Defined cases: a null text counts as empty, that is only the end id; documents come in ascending
doc_id, null first, equal ids by a hash of the text; a repeated row is a further document; an empty
table gives a dataset without segments. A document lies whole in one segment, so a task's memory
follows the segment size or the longest document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm import vocabulary
from fieldtally.llm.shared import chunks, lists, ship

HEADER = struct.Struct("<4sBxxxIIQ")  # mark, bits, ids per block, blocks, ids
MARK = b"IDS1"
BLOCK = 4096
#: A segment is closed when it holds this many ids.
SEGMENT = 1 << 20
#: Up to so many shards, their starts (two numbers each) are broadcast on reading.
MOST_SHARDS = 100_000


def width_of(vocabulary_size: int) -> int:
    """Fewest bits that hold all ids below that number."""
    if not 0 < vocabulary_size <= 1 << 32:
        raise ValueError("a vocabulary has 1 to 2**32 ids")
    return max(1, (vocabulary_size - 1).bit_length())


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        yield lane, word, shift


def pack(ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    if block % 64:
        raise ValueError("ids per block must be a multiple of 64")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    n_blocks = -(-len(ids) // block)
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, dtype=np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 64)
    words = np.zeros((groups, width), dtype="<u8")
    for lane, word, shift in _lanes(width):
        words[:, word] |= padded[:, lane] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= padded[:, lane] >> np.uint64(64 - shift)
    body = words.tobytes()
    step = block // 64 * width * 8
    offsets = np.minimum(np.arange(n_blocks + 1) * step, len(body)).astype("<u8")
    return HEADER.pack(MARK, width, block, n_blocks, len(ids)) + offsets.tobytes() + body


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop; only the blocks that hold them are touched."""
    mark, width, block, n_blocks, n = HEADER.unpack_from(payload)
    if mark != MARK:
        raise ValueError("not a payload of packed ids")
    stop = n if stop is None else min(stop, n)
    start = min(start, stop)
    if start == stop:
        return np.zeros(0, dtype="<u4")
    offsets = np.frombuffer(payload, dtype="<u8", count=n_blocks + 1, offset=HEADER.size)
    first, last = start // block, -(-stop // block)
    body = HEADER.size + offsets.nbytes
    a, b = body + int(offsets[first]), body + int(offsets[last])
    words = np.frombuffer(payload, dtype="<u8", count=(b - a) // 8, offset=a).reshape(-1, width)
    ids = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << width) - 1)
    for lane, word, shift in _lanes(width):
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        ids[:, lane] = value & mask
    return ids.ravel()[start - first * block : stop - first * block]


def write(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
    segment_ids: int = SEGMENT,
    block: int = BLOCK,
) -> None:
    """Encode the documents and write them in ascending order of id_col.

    One shuffle of the texts by range; encoding and packing happen after it, in one pass, so that
    Spark's sampling of ranges does not encode. shards: `spark.sql.shuffle.partitions` by default.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = width_of(max(vocabulary.size(vocabulary_path), end_id + 1))
    frame = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")
    )
    ordered = frame.repartitionByRange(shards, "_id", "_hash").sortWithinPartitions("_id", "_hash")
    id_type = frame.schema["_id"].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.LongType()),
            T.StructField("first_id", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.document_encoder(vocabulary_path)
        shard = TaskContext.get().partitionId()
        names, counts, parts, held = [], [], [], 0
        segment = first = 0

        def close() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(names)
            n = np.concatenate(counts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([segment], pa.int64()),
                    pa.array([first], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    lists(n, np.array([len(n)]), pa.int64()),
                    pa.array([pack(np.concatenate(parts), width, block)], pa.binary()),
                ],
                names=schema.names,
            )

        for batch in batches:
            for a, b, texts in chunks(batch.column(2)):
                ids, n = encode(texts)
                ids, bounds = vocabulary.with_end(ids, n, end_id)
                names.append(batch.column(0).slice(a, b - a))
                counts.append(n + 1)
                parts.append(ids)
                held += len(ids)
                if held >= segment_ids:
                    yield close()
                    names, counts, parts = [], [], []
                    segment, first, held = segment + 1, first + held, 0
        if names:
            yield close()

    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a dataset, with `start`: the ids of all documents before each segment."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start")
    )
    # One row per shard: few, whatever the size of the dataset. Where that holds they are sent to
    # all tasks, since a join by shuffle would move the payloads.
    few = len(totals.limit(MOST_SHARDS + 1).collect()) <= MOST_SHARDS
    joined = rows.join(F.broadcast(totals) if few else totals, "shard")
    return joined.withColumn("start", F.col("shard_start") + F.col("first_id"))


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a dataset: its id, start, n_tokens and ids (unsigned 32 bits each)."""
    ship(spark)
    rows = segments(spark, path).select("start", "doc_ids", "counts", "payload")
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["doc_ids"].dataType.elementType),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                ids = unpack(batch.column(3)[i].as_buffer())
                stops = np.cumsum(counts)
                ends = np.append(0, stops * 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[i].values,
                        pa.array(batch.column(0)[i].as_py() + stops - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.Array.from_buffers(
                            pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())]
                        ),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
