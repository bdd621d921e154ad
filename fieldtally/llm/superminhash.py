"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

Words are runs of code points other than blank, tab and line breaks, A-Z in lower case; a document is its
set of shingles of five words in a row (all its words, if fewer). Two documents are linked where
100 * intersection >= 85 * union.

1. Documents with the same set are one class from here on. A class gets a SuperMinHash signature: round
   j deals every shingle one more place of a random permutation of its own, with a rank in [j, j + 1);
   a place keeps its smallest rank. A text stops as soon as no rank of the next round could still be
   kept, after a few rounds where it has some hundred shingles. Since a shingle's ranks are a
   permutation, the estimate varies less than that of independent hashes.
2. Candidates share one of 32 bands of 5 ranks. At the threshold a pair misses all with probability
   7e-9; that is all that the search may lose.
3. Classes of a band meet in tiles of bounded size (a large band is cut into blocks, every two blocks
   meet) and are tied where as many of 256 ranks agree as any linked pair has but for 1e-9; a pair at
   0.6 does so one time in 10,000. A tile emits a forest by union-find, never the pairs.
4. Classes tied over any number of steps meet in tiles again. Where there are several tiles, signatures
   go first, and a whole set is sent only to tiles in which its class is tied to one of the other block;
   a common template with less similarity therefore moves no sets. There, union-find runs over the ties
   of trees not yet joined, and each tie is confirmed on the whole sets.
5. Components of the confirmed links are the groups.

Defined cases: a text that is null or has no word has no shingle and is linked with nothing; repeated
rows are copies of each other, each with a row of its own; doc_ids may have any type with an order; a
null doc_id takes part, is never the smallest, and component_id is null only where no member has an
id; kept compares null with null as equal; very long texts are read whole, in pieces of bounded size;
an empty table gives an empty result; further columns are ignored, whatever their names. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.components import components
from fieldtally.llm.jaccard import shingles_of
from fieldtally.llm.runs import array_of, whole_groups
from fieldtally.llm.shared import chunks, mixed, ship, written

LEAST, OF = 85, 100
BANDS, RANKS = 32, 5
#: Ranks of a signature. All are compared, the first BANDS * RANKS make the bands.
PLACES = 256
#: Chance that the ranks of a linked pair agree too seldom.
LOST = 1e-9
#: Shingles whose permutations are held at a time.
PIECE = 1 << 15
#: Classes per block of a band, and of a tied group under verification.
BLOCK = 1024
VERIFIED = 512
_NONE = np.uint64((1 << 64) - 1)


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks (texts, PLACES): round in the upper 32 bits, a random number in the lower ones."""
    made = np.full((len(counts), PLACES), _NONE, dtype=np.uint64)
    flat = made.ravel()
    text_of = np.repeat(np.arange(len(counts)), counts)
    for start in range(0, len(shingles), PIECE):
        own, text = shingles[start : start + PIECE], text_of[start : start + PIECE]
        place = np.tile(np.arange(PLACES, dtype=np.uint8), (len(own), 1))
        live = np.arange(len(own))
        for j in range(PLACES):
            # Ranks of round j are at least j: texts whose largest rank is below that are done.
            texts = np.unique(text[live])
            open_ = np.zeros(len(counts), dtype=bool)
            open_[texts[made[texts].max(axis=1) >> np.uint64(32) >= j]] = True
            live = live[open_[text[live]]]
            if not len(live):
                break
            drawn = mixed(own[live] + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            other = j + ((drawn >> np.uint64(32)) * np.uint64(PLACES - j) >> np.uint64(32)).astype(np.int64)
            got = place[live, other]
            place[live, other] = place[live, j]
            rank = np.uint64(j << 32) | (drawn & np.uint64(0xFFFFFFFF))
            np.minimum.at(flat, text[live] * PLACES + got, rank)
    return made


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    parts = signature[:, : BANDS * RANKS].reshape(len(signature), BANDS, RANKS)
    for i in range(RANKS):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key


@cache
def least_equal(least: int = LEAST, lost: float = LOST) -> int:
    """Ranks that agree in all but `lost` of the pairs at the threshold, by the binomial (an upper bound)."""
    p, n, below = least / OF, PLACES, 0.0
    if p >= 1:
        return n
    for m in range(n + 1):
        log = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(p) + (n - m) * np.log1p(-p)
        below += np.exp(log)
        if below > lost:
            return m
    return n


def _tied(sig: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, least: int) -> np.ndarray:
    """Those of the other rows that may be linked to row i: by size first, then by ranks."""
    small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    others = others[OF * small >= least * large]
    return others[(sig[others] == sig[i]).sum(axis=1) >= least_equal(least)]


def _forest(sig: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Search over ties: (row, rows first reached from it)."""
    new, waiting = np.arange(len(n)), []
    while len(new):
        if not waiting:
            waiting, new = [int(new[0])], new[1:]
        i = waiting.pop()
        reached = _tied(sig, n, i, new, least)
        if len(reached):
            yield i, reached
            waiting += reached.tolist()
            new = np.setdiff1d(new, reached, assume_unique=True)


def _prepared(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, hash of the folded text, class of equal sets (null without words), set size, bands, ranks."""
    folded = F.translate(F.col(f"`{text}`"), string.ascii_uppercase, string.ascii_lowercase)
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(folded).alias("t"), folded.alias("x"))
    schema = T.StructType(
        [
            frame.schema["doc_id"],
            T.StructField("t", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("sig", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column(2)):
                sets = _sets_of(texts)
                sizes = np.array([len(s) for s in sets])
                full = sizes > 0
                bands = np.zeros((b - a, BANDS), dtype=np.int64)
                short = np.zeros((b - a, PLACES), dtype=np.uint8)
                if full.any():
                    ranks = signatures(np.concatenate(sets), sizes[full])
                    bands[full] = band_keys(ranks).view(np.int64)
                    short[full] = (mixed(ranks) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())
                        ),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    names=schema.names,
                )

    return frame.mapInArrow(run, schema)


def _sets_of(texts: list[str | None]) -> list[np.ndarray]:
    made, counts = shingles_of(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return [np.unique(made[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _node(own: np.ndarray) -> int:
    """Name of a class: a hash of its sorted shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def _tiled(rows: DataFrame, size: Column, block: int) -> DataFrame:
    """Rows with `part` and `tile`, once for every two blocks of their group that include theirs."""
    rows = rows.withColumn("parts", F.ceil(size / block).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(12)), "parts").cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tile = F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other")
    return rows.withColumn("tile", tile).drop("other")


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "tile").sortWithinPartitions(key, "tile", "node")


def _columns(tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, n, ranks by 8 bits) of a tile whose columns 2 to 4 these are."""
    ranks = array_of(b"".join(tile.column(4).to_pylist()), np.uint8, PLACES)
    return tile.column(2).to_numpy(), tile.column(3).to_numpy().astype(np.int64), ranks


def _ties(buckets: DataFrame, least: int) -> DataFrame:
    """(a, b): a forest of the ties of each tile of (key, tile, node, n, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0

        def made() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *side])) for side in (left, right)]
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

        for tile in whole_groups(batches):
            node, n, sig = _columns(tile)
            for i, others in _forest(sig, n, least):
                left.append(np.full(len(others), node[i]))
                right.append(node[others])
                held += len(others)
            if held > 1 << 16:
                yield made()
                left, right, held = [], [], 0
        yield made()

    return buckets.mapInArrow(run, "a long, b long")


def _wanted(tiles: DataFrame, least: int) -> DataFrame:
    """(comp, tile, node) of (comp, tile, node, n, sig, part): classes tied to one of the tile's other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_groups(batches):
            node, n, sig = _columns(tile)
            part = tile.column(5).to_numpy()
            one = (part == part[0]).all()
            tied = np.zeros(len(node), dtype=bool)
            for i in range(len(node) - 1):
                later = np.arange(i + 1, len(node))
                found = _tied(sig, n, i, later if one else later[part[later] != part[i]], least)
                tied[found] = True
                tied[i] |= len(found) > 0
            keep = np.flatnonzero(tied)
            yield tile.select(["comp", "tile", "node"]).take(pa.array(keep))

    return tiles.mapInArrow(run, "comp long, tile long, node long")


def _confirmed(tiles: DataFrame, least: int) -> DataFrame:
    """(a, b): a forest of the links of each tile of (comp, tile, node, n, sig, part, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_groups(batches):
            node, n, sig = _columns(tile)
            part = tile.column(5).to_numpy()
            one = (part == part[0]).all()
            sets = [array_of(tile.column(6)[i].as_py(), np.uint64) for i in range(len(node))]
            tree = np.arange(len(node))
            a, b = [], []
            for i in range(len(node) - 1):
                later = np.arange(i + 1, len(node))
                later = later[tree[later] != tree[i]]
                if not one:
                    later = later[part[later] != part[i]]
                for j in _tied(sig, n, i, later, least).tolist():
                    if tree[j] == tree[i]:
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if OF * common >= least * (int(n[i]) + int(n[j]) - common):
                        tree[tree == tree[j]] = tree[i]
                        a.append(node[i])
                        b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def _with_sets(rows: DataFrame) -> DataFrame:
    """(node, text) to (node, shingles); a text that is not of the class is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in chunks(batch.column(1)):
                sets = _sets_of(texts)
                right = [i for i, s in enumerate(sets) if len(s) and _node(s) == names[a + i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[a + i] for i in right], pa.int64()),
                        pa.array([sets[i].tobytes() for i in right], pa.binary()),
                    ],
                    names=["node", "shingles"],
                )

    return rows.mapInArrow(run, "node long, shingles binary")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    block: int = BLOCK,
    verified: int = VERIFIED,
) -> DataFrame:
    """One row per document: its id, n_shingles, component_id, kept.

    least: least similarity in hundredths. component_id: the smallest id reachable over links.
    """
    ship(docs.sparkSession)
    known = written(_prepared(docs, id_col, text), "ranks")
    # The rows of a class agree but for id and text; the first of them stands for it.
    members = (
        known.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first"),
            F.any_value("n").alias("n"),
            F.any_value("bands").alias("bands"),
            F.any_value("sig").alias("sig"),
        )
    )
    members = written(members, "classes")

    keys = members.select("node", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keys.join(sizes, "key").join(members.select("node", "n", "sig"), "node")
    buckets = _grouped(_tiled(met, F.col("size"), block).select("key", "tile", "node", "n", "sig"), "key")
    ties = components(_ties(buckets, least)).withColumnRenamed("label", "comp")
    ties = written(ties, "ties")

    counts = ties.groupBy("comp").agg(F.count("*").alias("size"))
    tied = ties.join(counts, "comp").join(members.select("node", "n", "sig"), "node")
    tied = _tiled(tied, F.col("size"), verified).select("comp", "tile", "node", "n", "sig", "part", "parts")
    tied = written(tied, "tied")
    alone = tied.where("parts = 1").select("comp", "tile", "node")
    several = tied.where("parts > 1").select("comp", "tile", "node", "n", "sig", "part")
    wanted = written(alone.unionByName(_wanted(_grouped(several, "comp"), least)), "wanted")

    first = members.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.t").alias("first_t"))
    called = wanted.select("node").distinct().join(first, "node")
    texts = docs.select(
        F.col(f"`{id_col}`").alias("first_id"),
        F.translate(F.col(f"`{text}`"), string.ascii_uppercase, string.ascii_lowercase).alias("x"),
    ).withColumn("first_t", F.xxhash64("x"))
    found = texts.join(
        called,
        texts["first_id"].eqNullSafe(called["first_id"]) & (texts["first_t"] == called["first_t"]),
    ).select("node", "x")
    sets = written(_with_sets(found).dropDuplicates(["node"]), "sets")
    tiles = tied.drop("parts").join(wanted, ["comp", "tile", "node"]).join(sets, "node")
    tiles = tiles.select("comp", "tile", "node", "n", "sig", "part", "shingles")
    groups = components(written(_confirmed(_grouped(tiles, "comp"), least), "links"))

    named = members.select("node", F.col("first.doc_id").alias("doc_id")).join(groups, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.select("node", "label").join(least_id, "label").drop("label")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select("doc_id", "n", "node").join(named, "node", "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        own.alias("component_id"),
        F.col("doc_id").eqNullSafe(own).alias("kept"),
    )
