"""Packing documents into token sequences of fixed size, online, in bounded space.

Each task packs the rows of its own partition in one pass and shuffles nothing. It keeps a fixed
number of open windows. A document first fills whole sequences; its rest goes into the open window
that it leaves fullest. When none fits and no further window may be opened, the fullest is topped
up with a piece cut from the rest and emitted. What stays open at the end of a partition is merged
afterwards, partitions in groups of fixed size, by cutting: a group leaves one partial sequence.

Defined cases: a null text counts as empty, that is only the end id; repeated rows are packed again;
a null doc_id stays null, and ids of any type are passed on unchanged; an empty table gives no piece.
A document longer than a window is cut. Of a document only the slices in open windows are kept, so a
task holds its open windows and one chunk of texts, or the longest single text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm import vocabulary
from fieldtally.llm.shared import chunks, ship, written

#: Ids per sequence.
WINDOW = 2048
#: Open windows per partition.
OPEN = 64
#: A window with fewer free places is emitted as it is, rather than filled with a smaller cut.
LEAST_CUT = 8
#: Partitions whose leftovers are merged together.
GROUP = 8

Piece = tuple[int, int, int, int]  # document, start in it, length, offset in the window


class Windows:
    """The open windows of one partition, by free places."""

    def __init__(self, window: int, most: int, least_cut: int):
        self.window, self.most, self.least_cut = window, most, least_cut
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.content: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, document: int, length: int) -> Iterator[tuple[int, list[Piece]]]:
        """Place a document; yields the windows that are done."""
        start = 0
        while length - start >= self.window:
            yield self._new(), [(document, start, self.window, 0)]
            start += self.window
        while start < length:
            rest = length - start
            at = bisect_left(self.free, (rest, -1))
            if at == len(self.free) and len(self.free) < self.most:
                number = self._new()
                self.content[number] = []
                self.free.append((self.window, number))
                insort(self.free, self.free.pop())
                continue
            if at == len(self.free):  # none fits: the fullest goes
                at = 0
                if self.free[0][0] < self.least_cut:
                    yield self._take(0)
                    continue
            free, number = self.free.pop(at)
            n = min(rest, free)
            self.content[number].append((document, start, n, self.window - free))
            start += n
            if n == free:
                yield number, self.content.pop(number)
            else:
                insort(self.free, (free - n, number))

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _take(self, at: int) -> tuple[int, list[Piece]]:
        _, number = self.free.pop(at)
        return number, self.content.pop(number)

    def left(self) -> Iterator[tuple[int, list[Piece]]]:
        while self.free:
            yield self._take(0)


def _schema(id_col: str, id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN,
    least_cut: int = LEAST_CUT,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: document, start and length in it, sequence_id, offset there, and ids.

    ids: little-endian unsigned 32-bit integers. Sequences are numbered by partition in the upper
    bits, those made of leftovers from 2**62 on. The first pass is written to the shared folder.
    """
    ship(docs.sparkSession)
    frame = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    schema = _schema(id_col, frame.schema["_id"].dataType)
    first = T.StructType([*schema.fields, T.StructField("open_group", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.document_encoder(vocabulary_path)
        part = TaskContext.get().partitionId()
        windows = Windows(window, open_windows, least_cut)
        chunk: dict[int, tuple] = {}  # documents of the chunk at hand: id, ids
        kept: dict[tuple[int, int], tuple] = {}  # slices in open windows: id, ids of the document, slice
        number = 0

        def rows(done, group_of) -> Iterator[tuple]:
            for sequence, pieces in done:
                for document, start, length, offset in pieces:
                    if (document, start) in kept:
                        name, total, ids = kept.pop((document, start))
                    else:
                        name, whole = chunk[document]
                        total, ids = len(whole), whole[start : start + length]
                    yield name, start, length, total, part << 32 | sequence, offset, ids.tobytes(), group_of

        def batch_of(made: list[tuple], names: pa.DataType) -> pa.RecordBatch:
            kinds = [names, *[pa.int64()] * 5, pa.binary(), pa.int32()]
            columns = list(zip(*made, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=first.names
            )

        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            names = batch.column(0).to_pylist()
            for a, b, texts in chunks(batch.column(1)):
                ids, n = encode(texts)
                ids, bounds = vocabulary.with_end(ids, n, end_id)
                made: list[tuple] = []
                for i in range(b - a):
                    chunk[number] = names[a + i], ids[bounds[i] : bounds[i + 1]]
                    made += rows(windows.add(number, len(chunk[number][1])), None)
                    number += 1
                yield batch_of(made, id_kind)
                # Slices in open windows are copied, once; the chunk is let go.
                for pieces in windows.content.values():
                    for document, start, length, _ in pieces:
                        if (document, start) not in kept:
                            name, whole = chunk[document]
                            kept[document, start] = name, len(whole), whole[start : start + length].copy()
                chunk.clear()
        if id_kind is not None:
            yield batch_of(list(rows(windows.left(), part // group)), id_kind)

    packed = written(frame.mapInArrow(run, first), "packing", compression="zstd")

    def merge(left: pa.Table) -> pa.Table:
        """Leftover pieces end to end, cut wherever a window is full. Ids stay in Arrow, as they are."""
        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        base = 1 << 62 | left["open_group"][0].as_py() << 32
        starts, lengths, totals = (left[c].to_pylist() for c in ("start", "length", "doc_tokens"))
        at, made = 0, []
        for i, (start, length, total) in enumerate(zip(starts, lengths, totals, strict=True)):
            done, content = 0, left["ids"][i].as_py()
            while done < length:
                n = min(length - done, window - at % window)
                cut = content[4 * done : 4 * (done + n)]
                made.append((i, start + done, n, total, base + at // window, at % window, cut))
                done, at = done + n, at + n
        of, *columns = zip(*made, strict=True)
        names = left[id_col].take(pa.array(of))
        arrays = [pa.array(c, k) for c, k in zip(columns, [*[pa.int64()] * 5, pa.binary()], strict=True)]
        return pa.Table.from_arrays([names, *arrays], names=schema.names)

    finished = packed.where(F.col("open_group").isNull()).drop("open_group")
    leftover = packed.where(F.col("open_group").isNotNull())
    return finished.unionByName(leftover.groupBy("open_group").applyInArrow(merge, schema))
