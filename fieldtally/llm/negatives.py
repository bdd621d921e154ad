"""Hard negatives by Hilbert-ordered blocks of candidates with zone maps.

For each anchor and each of its best positives, the best rows of another label whose score lies in a
window below that of the positive. Vectors become whole numbers, floor(256 * x); a score is their inner
product.

1. Rows get the place of their vector on a Hilbert curve through all dimensions and are written as
   Parquet blocks in the order of label, curve and id. A block carries the smallest and largest value
   of every dimension, of the label and of the id: its zone map.
2. Anchors, in the same order, form groups. Zone maps alone (the blocks' columns of vectors are not
   read) give, by interval arithmetic, the least and the largest score of each anchor with each block.
   A block is read for an anchor if its interval meets what the anchor looks for, and reaches the
   least score of some block that is sure to hold enough rows. A block that can only tie with it, by
   larger ids, is not read; so of very many copies of a vector only the first few blocks are.
3. The chosen blocks meet the groups that need them in tiles of bounded size. A tile multiplies each
   anchor with its own blocks alone and keeps the best few; heaps of tiles are merged by rank.
4. This runs twice: for the positives (blocks that hold the anchor's label), then for the windows, whose
   bounds follow from the positives (blocks that hold another label).

Pruning by intervals loses nothing; the result is exact. Work that grows with anchors times blocks is
done on zone maps; vectors are sent to the groups that need them.

Defined cases: rows whose label, id or vector is null, or whose vector is empty or holds a null or
non-finite component, take no part; nor do those whose score with themselves is 2^53 or more, since
their scores would not be exact. Vectors of different lengths never meet. A positive is a row with
another id than the anchor; repeated rows are repeated candidates; an anchor that is repeated with the
same vector and label counts once, with another one it is one more anchor. Ties go to the smaller id.
Texts play no part; other columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.runs import array_of, firsts, flat, whole_groups
from fieldtally.llm.shared import ship, written

#: Rows of a block.
BLOCK = 256
#: Blocks of a partition of the table of blocks.
PARTITION = 64
#: Blocks of a tile, as a power of two, and zone maps compared at a time.
TILE = 5
ZONES = 2048
#: Anchors of a group.
GROUP = 1024
#: Bits per dimension of the place on the curve.
BITS = 4
#: Anchors multiplied at a time.
STRIP = 64
#: Square of a vector's length from which on scores are not exact in double precision.
LONGEST = float(1 << 53)
_LAST = np.iinfo(np.int64).max

ROWS = "block long, n int, size int, n_ids int, low array<int>, high array<int>, labels array<long>, names array<long>"
PACKED = "vec_ids binary, own binary, codes binary"


def usable(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): rows that can take part, vectors as whole numbers."""
    rows = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("x"),
    )

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0))
    rows = rows.where(F.forall("x", finite))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + (256 * x) * (256 * x))
    # One more than the product can gain by rounding down, then the exact test.
    rows = rows.where(square < 4 * LONGEST + 4 * F.size("x"))
    rows = rows.withColumn("v", F.transform("x", lambda x: F.floor(256 * x).cast("int"))).drop("x")
    exact = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    return rows.where(exact < int(LONGEST))


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative numbers below 2**bits, as bytes."""
    x = x.astype(np.uint32).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(n):
            turned = (x[i] >> level & 1).astype(bool)
            swapped = np.where(turned, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros(x.shape[1], dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[n - 1] >> level & 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= carry
    planes = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((x[None] >> planes[:, None, None]) & 1).astype(np.uint8).reshape(bits * n, -1).T, axis=1)


def _placed(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(vec_id, label, v, n, place): rows with their place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = flat(batch.column(2))
            level = ((v - low) * ((1 << BITS) - 1e-9) / max(1, high - low + 1)).astype(np.int64)
            level = np.clip(level, 0, (1 << BITS) - 1)
            start = np.cumsum(n) - n
            place: list[bytes] = [b""] * len(n)
            for width in np.unique(n).tolist():
                own = np.flatnonzero(n == width)
                found = hilbert(level[start[own, None] + np.arange(width)], BITS)
                for i, row in zip(own.tolist(), found, strict=True):
                    place[i] = row.tobytes()
            columns = [batch.column(i) for i in range(3)]
            columns += [pa.array(n.astype(np.int32)), pa.array(place, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "n", "place"])

    return rows.mapInArrow(run, "vec_id long, label long, v array<int>, n int, place binary")


def _packed(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Rows in the order of dimension, label and curve, in runs of `size` as one packed row with a zone map."""
    # Copies of one row are spread as well.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).alias("salt")
    order = ["n", "label", "place", "vec_id", "salt"]
    ordered = rows.select("*", salt).repartitionByRange(max(parts, 1), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0

        def packed(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made
            vec_ids, label = part.column(0).to_numpy(), part.column(1).to_numpy()
            n = part.column(3)[0].as_py()
            codes = flat(part.column(2))[0].astype(np.int32).reshape(-1, n)
            row = {
                "block": base + made,
                "n": n,
                "size": len(codes),
                "n_ids": len(np.unique(vec_ids)),
                "low": codes.min(axis=0),
                "high": codes.max(axis=0),
                "labels": [int(label.min()), int(label.max())],
                "names": [int(vec_ids.min()), int(vec_ids.max())],
                "vec_ids": vec_ids.astype(np.int64).tobytes(),
                "own": label.astype(np.int64).tobytes(),
                "codes": codes.tobytes(),
            }
            made += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 2]
            kinds += [*[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]
            arrays = [pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=list(row))

        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            n = held.column(3).to_numpy()
            start = 0
            while start < len(n):
                # A run ends where it is full or the dimension changes; the last one waits for more rows.
                stop = min(start + size, int(np.searchsorted(n, n[start], side="right")))
                if stop == len(n) and stop - start < size:
                    break
                yield packed(held.slice(start, stop - start))
                start = stop
            held = held.slice(start) if start < len(n) else None
        if held is not None:
            yield packed(held)

    return written(ordered.mapInArrow(run, f"{ROWS}, {PACKED}"), "blocks")


class Group:
    """Anchors that are looked after together, with what they look for: targets (anchor, low, high, k)."""

    def __init__(self, n: int, vec_ids: bytes, own: bytes, codes: bytes, wants: list[list[int]] | None, k: int):
        self.ids, self.own = array_of(vec_ids, np.int64), array_of(own, np.int64)
        self.codes = array_of(codes, np.int32, n).astype(np.float64)
        self.k, self.positive = k, wants is None
        if wants is None:
            self.of = np.arange(len(self.ids))
            self.low = np.full(len(self.ids), -np.inf)
            self.high = np.full(len(self.ids), np.inf)
            self.wants = np.zeros((len(self.ids), 3), dtype=np.int64)
        else:
            # (anchor, id and score of the positive)
            self.wants = np.array(wants, dtype=np.int64).reshape(-1, 3)
            score = self.wants[:, 2]
            self.of = self.wants[:, 0]
            self.low = -((-3 * score) // 10).astype(np.float64)
            self.high = (9 * score // 10).astype(np.float64)

    def needs(self, low, high, labels, names, size, n_ids) -> np.ndarray:
        """Which anchor (row) must read which of the blocks (column) with these zone maps."""
        up, down = np.maximum(self.codes, 0), np.minimum(self.codes, 0)
        most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
        # Sums of whole numbers are exact below 2^53, whatever their order.
        sums = np.abs(self.codes) @ np.maximum(np.abs(low), np.abs(high)).T
        slack = np.where(sums < LONGEST / 2, 0.0, 1 + 1e-9 * sums)
        most, least = (most + slack)[self.of], (least - slack)[self.of]
        own = self.own[self.of][:, None]
        # Zone map of the label: blocks of the anchor's label alone, and blocks without it.
        only = (labels[:, 0] == own) & (labels[:, 1] == own)
        without = (own < labels[:, 0]) | (own > labels[:, 1])
        if self.positive:
            may, sure = ~without, only & (n_ids > self.k)
        else:
            may, sure = ~only, without & (size >= self.k)
        sure &= (most <= self.high[:, None]) & (least >= self.low[:, None])
        reached = np.where(sure, least, -np.inf).max(axis=1, initial=-np.inf)[:, None]
        # Enough rows have that score at least, and ids up to `last`.
        last = np.where(sure & (least == reached), names[:, 1], _LAST).min(axis=1, initial=_LAST)[:, None]
        beaten = (most < reached) | ((most == reached) & (names[:, 0] > last))
        chosen = may & ~beaten & (most >= self.low[:, None]) & (least <= self.high[:, None])
        needed = np.zeros((len(self.ids), len(size)), dtype=bool)
        np.logical_or.at(needed, self.of, chosen)
        return needed

    def best(self, anchors: np.ndarray, ids, own, codes) -> Iterator[tuple[np.ndarray, ...]]:
        """(want, score, id) of the best candidates, sorted by id, for the wants of these anchors."""
        score = self.codes[anchors] @ codes.T
        same = self.own[anchors][:, None] == own
        right = same & (self.ids[anchors][:, None] != ids) if self.positive else ~same
        at = np.full(len(self.ids), -1)
        at[anchors] = np.arange(len(anchors))
        for wants in np.array_split(np.flatnonzero(at[self.of] >= 0), -(-len(self.of) // STRIP)):
            rows = at[self.of[wants]]
            s = np.where(right[rows], score[rows], -np.inf)
            s[(s < self.low[wants, None]) | (s > self.high[wants, None])] = -np.inf
            floor = np.partition(s, -self.k, axis=1)[:, -self.k] if s.shape[1] > self.k else np.full(len(s), -np.inf)
            r, c = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
            keep = firsts(r, -s[r, c], ids[c], k=self.k)
            yield wants[r[keep]], s[r, c][keep].astype(np.int64), ids[c[keep]]


MET = "home long, tile long, kind int, block long, n int, vec_ids binary, own binary, codes binary, wants array<array<long>>"
ZONED = f"{MET}, size int, n_ids int, low array<int>, high array<int>, labels array<long>, names array<long>"


def _group_of(tile: pa.RecordBatch, k: int) -> tuple[Group, pa.RecordBatch] | None:
    """The group in front of a tile, and the rows behind it."""
    if tile.num_rows < 2 or tile.column(2)[0].as_py() or not tile.column(2)[1].as_py():
        return None
    n, vec_ids, own, codes, wants = (tile.column(i)[0].as_py() for i in range(4, 9))
    return Group(n, vec_ids, own, codes, wants, k), tile.slice(1)


def _chosen(blocks: DataFrame, groups: DataFrame, k: int, counts: tuple[int, int]) -> DataFrame:
    """(home, block, anchors): which anchors of a group read a block, by zone maps alone; anchors as bits."""
    n_groups, n_blocks = counts
    across = max(1, -(-n_blocks // ZONES))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    zones = blocks.select(
        numbers(n_groups).alias("home"), F.pmod(F.xxhash64("block"), F.lit(across)).alias("tile"), F.lit(1).alias("kind"),
        "block", "n", "size", "n_ids", "low", "high", "labels", "names",
    )
    fronts = groups.select(
        "home", numbers(across).alias("tile"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"),
        "n", "vec_ids", "own", "codes", "wants",
    )
    fields = [f.split(" ")[0] for f in ZONED.split(", ")]
    met = fronts.unionByName(zones, allowMissingColumns=True).select(*fields)
    met = met.repartition("home", "tile").sortWithinPartitions("home", "tile", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_groups(batches):
            found = _group_of(tile, k)
            if found is None:
                continue
            group, rows = found
            dimension = group.codes.shape[1]
            rows = rows.filter(pa.array(rows.column(4).to_numpy() == dimension))
            if not rows.num_rows:
                continue
            column = {name: rows.column(i) for i, name in enumerate(fields)}
            low, high = (flat(column[c])[0].reshape(-1, dimension).astype(np.float64) for c in ("low", "high"))
            labels, names = (flat(column[c])[0].reshape(-1, 2) for c in ("labels", "names"))
            needed = group.needs(low, high, labels, names, column["size"].to_numpy(), column["n_ids"].to_numpy())
            some = np.flatnonzero(needed.any(axis=0))
            bits = np.packbits(needed[:, some].T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), tile.column(0)[0].as_py())),
                    column["block"].take(pa.array(some)),
                    pa.array([b.tobytes() for b in bits], pa.binary()),
                ],
                names=["home", "block", "anchors"],
            )

    return met.mapInArrow(run, "home long, block long, anchors binary")


FOUND = "home long, want_of long, anchor_id long, positive_id long, positive_score long, score long, vec_id long"


def _read(blocks: DataFrame, groups: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Best candidates of every want in each tile of chosen blocks."""
    chosen = written(chosen.withColumn("tile", F.shiftright("block", TILE)), "chosen")
    rows = blocks.select("block", "n", "vec_ids", "own", "codes").join(chosen, "block")
    rows = rows.select("home", "tile", F.lit(1).alias("kind"), "block", "n", "vec_ids", "own", "codes", "anchors")
    fronts = groups.join(chosen.select("home", "tile").distinct(), "home").select(
        "home", "tile", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "n", "vec_ids", "own", "codes", "wants"
    )
    fields = [*[f.split(" ")[0] for f in MET.split(", ")], "anchors"]
    met = fronts.unionByName(rows, allowMissingColumns=True).select(*fields)
    met = met.repartition("home", "tile").sortWithinPartitions("home", "tile", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_groups(batches):
            found = _group_of(tile, k)
            if found is None:
                continue
            group, rows = found
            n = group.codes.shape[1]
            ids = [array_of(b, np.int64) for b in rows.column(5).to_pylist()]
            own = np.concatenate([array_of(b, np.int64) for b in rows.column(6).to_pylist()])
            codes = np.concatenate([array_of(b, np.int32, n) for b in rows.column(7).to_pylist()])
            of = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            ids = np.concatenate(ids)
            by_id = np.argsort(ids, kind="stable")
            ids, own, of, codes = ids[by_id], own[by_id], of[by_id], codes[by_id].astype(np.float64)
            bits = array_of(b"".join(rows.column(9).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            needed = np.unpackbits(bits, axis=1, count=len(group.ids)).astype(bool)
            made: list[tuple[np.ndarray, ...]] = []
            # Neighbours on the curve mostly need the same blocks; those are multiplied together.
            for start in range(0, len(group.ids), STRIP):
                anchors = np.arange(start, min(start + STRIP, len(group.ids)))
                anchors = anchors[needed[:, anchors].any(axis=0)]
                if not len(anchors):
                    continue
                columns = needed[:, anchors].any(axis=1)[of]
                made += group.best(anchors, ids[columns], own[columns], codes[columns])
            if not made:
                continue
            want, score, name = (np.concatenate(c) for c in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(want), tile.column(0)[0].as_py())),
                    pa.array(want.astype(np.int64)),
                    pa.array(group.ids[group.of[want]]),
                    pa.array(group.wants[want, 1]),
                    pa.array(group.wants[want, 2]),
                    pa.array(score),
                    pa.array(name),
                ],
                names=[c.split(" ")[0] for c in FOUND.split(", ")],
            )

    best = Window.partitionBy("home", "want_of").orderBy(F.desc("score"), "vec_id")
    found = met.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column | None = None,
    relabel: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    is_anchor, relabel: a condition and a label made of vec_id and label (ids divisible by 100; labels as
    they are). Of the rows with 30 * positive_score <= 100 * negative_score <= 90 * positive_score and
    another label than the anchor, the first `negatives` are returned for each of the first `positives`.
    """
    ship(vectors.sparkSession)
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    rows = usable(vectors, id_col, vector, label)
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("long")).where(F.col("label").isNotNull())
    asked = rows.where(is_anchor).dropDuplicates(["vec_id", "label", "v"])
    range_ = rows.agg(
        F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")
    ).collect()[0]
    low, high = range_["low"] or 0, range_["high"] or 0
    blocks = _packed(_placed(rows, low, high), -(-range_["n"] // (block * PARTITION)), block)
    groups = _packed(_placed(asked, low, high), -(-asked.count() // group), group)
    counted = groups.select("block").withColumn("part", F.shiftright("block", 32))
    # Groups are numbered without gaps, so that zone maps can be sent to each: a row per partition.
    sizes = counted.groupBy("part").agg(F.count("*").alias("size"))
    begin = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("begin", F.coalesce(F.sum("size").over(begin), F.lit(0)))
    home = F.col("begin") + F.col("block") - F.shiftleft(F.col("part"), 32)
    groups = groups.withColumn("part", F.shiftright("block", 32)).join(F.broadcast(sizes), "part")
    groups = written(groups.select(home.alias("home"), "n", "vec_ids", "own", "codes"), "groups")
    counts = groups.count(), blocks.count()
    if not all(counts):
        none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], none)

    no_wants = F.lit(None).cast("array<array<long>>").alias("wants")
    first = groups.select("*", no_wants)
    good = _read(blocks, first, _chosen(blocks, first, positives, counts), positives)
    # At most `positives` for each anchor of a group.
    wants = good.groupBy("home").agg(
        F.sort_array(F.collect_list(F.array("want_of", "vec_id", "score"))).alias("wants")
    )
    second = written(groups.join(wants, "home"), "groups")
    bad = _read(blocks, second, _chosen(blocks, second, negatives, counts), negatives)
    return bad.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
