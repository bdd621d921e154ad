"""The trie of shared conversation beginnings, from padded matrices of turn ids.

A node is a distinct sequence of first turns (role and text). Its members are the conversations that
begin with it; the root is the empty beginning.

1. Turns get their place in their conversation from one range sort: a row's place is its rank, less
   the rank at which its conversation begins, which is summed per (conversation, sort partition). So
   the turns of one very long conversation stay spread over partitions.
2. Every conversation is rebuilt: it takes its first turns from the first conversation of its family.
3. A turn becomes a 64-bit id, mixed with its place. Conversations are cut into slabs of 32 turns; a
   slab knows the key of all turns before it (128 bits: the ids of a beginning, combined by xor), so
   slabs of any depth are handled alike, side by side.
4. Slabs are range-sharded by (depth, key before, ids, conversation). In a task the ids form a padded
   matrix, which numpy sorts lexicographically. Where a row differs from the one above, or-ed along the
   columns, a node starts; reduceat sums every depth over the node's rows.
5. Only nodes at the first or the last row of a shard may go on in another one; those are recombined
   by key. The digest of a node that spans shards is made in order from ready pieces of its list.
6. Sums over subtrees: each node's amounts are booked on its smallest member, at the node's depth.
   Per conversation they are added from the end, and step 4 sums them over the members of every node.

Nothing is gathered per node or per conversation but slabs. Texts are never shuffled, only ids.

Defined cases: a null role or text is empty; rows with a null conv_id belong to no conversation and are
left out; turns are ordered by turn, nulls first, and turns of one number by a hash of role and text;
repeated rows are turns of their own; a conversation left without turns is a member of the root alone;
texts of any length are read whole, as hash and number of words; other columns are ignored, whatever
their names; an empty table gives no node, not even a root. Negative conv_ids: c - c % 20 rounds
towards zero, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.runs import flat
from fieldtally.llm.shared import named, ship, written

#: Conversations of a family: c, and the 19 after it, where c % 20 = 0.
FAMILY = 20
#: A conversation takes fewer than this many turns from the first of its family.
TAKEN = 4
#: Turns of a slab.
SLAB = 32
#: Slabs of a shard.
SHARD = 16384
#: Equal rows are spread over this many sort keys.
SALTS = 1 << 16

EMPTY = hashlib.sha256(b"").hexdigest()
NODES = (
    "k1 long, k2 long, p1 long, p2 long, depth long, n_convs long, conv_id long, words long, edge boolean, "
    "ends string, ends_first long, ends_piece string"
)
SUMS = "k1 long, k2 long, n_leaves long, saved_tokens long"


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, tid, words): turns in their conversations, counted from 0; and spans per partition."""
    spark = conversations.sparkSession
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(F.coalesce(F.col(f"`{role}`"), F.lit("")), content).alias("tid"),
        F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
    ).where(F.col("conv").isNotNull())
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "tid", "salt")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id counts the rows of a partition from its own base; so it is the rank in the sort.
    ordered = ordered.select("conv", "tid", "words", F.monotonically_increasing_id().alias("at"))
    return written(ordered, "turns").withColumn("part", F.shiftright("at", 33))


def _before(by: str, *order: Column) -> Window:
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, total, pos, tid, words): rebuilt conversations behind a root turn at place 0."""
    spans = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = written(spans, "spans")
    # One row per partition that a conversation touches.
    spans = spans.withColumn("shift", F.coalesce(F.sum("n").over(_before("conv", F.col("part"))), F.lit(0)))
    sizes = spans.groupBy("conv").agg(F.sum("n").alias("n"))
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    own = sizes.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    cut = F.crc32(F.col("conv").cast("string")) % TAKEN
    convs = own.join(heads, "base", "left").select(
        "conv",
        "base",
        cut.alias("cut"),
        F.least(cut, F.coalesce("n_base", F.lit(0))).alias("taken"),
        (F.least(cut, F.coalesce("n_base", F.lit(0))) + F.greatest(F.col("n") - cut, F.lit(0)) + 1).alias("total"),
    )
    convs = written(convs, "convs")
    places = spans.join(convs.select("conv", "cut", "taken", "total"), "conv")
    placed = turns.join(places.drop("n"), ["conv", "part"]).withColumn(
        "own", F.col("at") - F.col("first") + F.col("shift")
    )
    kept = placed.where(F.col("own") >= F.col("cut")).select(
        "conv", "total", (F.col("own") - F.col("cut") + F.col("taken") + 1).alias("pos"), "tid", "words"
    )
    # At most three turns of a conversation are repeated, in its own family.
    opening = placed.where((F.col("conv") % FAMILY == 0) & (F.col("own") < TAKEN - 1)).select(
        F.col("conv").alias("base"), F.col("own").alias("at"), "tid", "words"
    )
    given = convs.where("taken > 0").join(opening, "base").where(F.col("at") < F.col("taken"))
    given = given.select("conv", "total", (F.col("at") + 1).alias("pos"), "tid", "words")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", "total", zero.alias("pos"), zero.alias("tid"), zero.alias("words"))
    return kept.unionByName(given).unionByName(roots)


def _slabs(rebuilt: DataFrame, slab: int) -> DataFrame:
    """(conv, slab, total, b1, b2, ids, seconds, words): up to `slab` turns, and the key before them."""
    turn = F.struct(
        "pos",
        F.xxhash64(F.lit(1), "tid", "pos").alias("h1"),
        F.xxhash64(F.lit(2), "tid", "pos").alias("h2"),
        "words",
    )
    made = (
        rebuilt.withColumn("slab", F.floor(F.col("pos") / slab))
        .withColumn("turn", turn)
        .groupBy("conv", "slab")
        .agg(
            F.any_value("total").alias("total"),
            F.bit_xor("turn.h1").alias("x1"),
            F.bit_xor("turn.h2").alias("x2"),
            F.sort_array(F.collect_list("turn")).alias("turns"),
        )
    )
    made = made.select(
        "conv", "slab", "total", "x1", "x2",
        F.col("turns.h1").alias("ids"), F.col("turns.h2").alias("seconds"), F.col("turns.words").alias("words"),
    )
    made = written(made, "slabs")
    zero = F.lit(0).cast("long")
    short = made.where(F.col("total") <= slab).withColumns({"b1": zero, "b2": zero})
    window = _before("conv", F.col("slab"))
    long = made.where(F.col("total") > slab).withColumns(
        {f"b{i}": F.coalesce(F.bit_xor(f"x{i}").over(window), zero) for i in (1, 2)}
    )
    return written(short.unionByName(long).drop("x1", "x2"), "slabs")


class Shard:
    """Slabs of one task as a padded matrix in lexicographic order, and where nodes start in it."""

    def __init__(self, batch: pa.RecordBatch):
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ids, length = flat(column["ids"])
        width = int(length.max())
        alive = np.arange(width) < length[:, None]
        # Dense ids keep the order and leave 0 for padding, which sorts before every turn.
        turn = np.zeros(alive.shape, dtype=np.int32)
        turn[alive] = np.unique(ids, return_inverse=True)[1] + 1
        plain = [column[n].to_numpy() for n in ("slab", "b1", "b2", "conv")]
        order = np.lexsort((plain[3], *turn.T[::-1], plain[2], plain[1], plain[0]))
        self.order, self.alive, self.width = order, alive[order], width
        self.slab, self.b1, self.b2, self.conv = (p[order] for p in plain)
        self.length, turn = length[order], turn[order]
        self.h1, self.h2 = (self.matrix(flat(column[n])[0], alive) for n in ("ids", "seconds"))
        change = turn[1:] != turn[:-1]
        for p in (self.slab, self.b1, self.b2):
            change[:, 0] |= p[1:] != p[:-1]
        starts = np.ones(alive.shape, dtype=bool)
        np.logical_or.accumulate(change, axis=1, out=starts[1:])
        self.starts = starts & self.alive
        # Key of the beginning that ends in each cell, and of the one before it.
        self.key = [
            before[:, None] ^ np.bitwise_xor.accumulate(h, axis=1)
            for before, h in ((self.b1, self.h1), (self.b2, self.h2))
        ]

    def matrix(self, values: np.ndarray, alive: np.ndarray) -> np.ndarray:
        made = np.zeros(alive.shape, dtype=np.int64)
        made[alive] = values
        return made[self.order]

    def depths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, rows that reach it, places among these rows at which a node starts)."""
        for j in range(self.width):
            rows = np.flatnonzero(self.alive[:, j])
            if len(rows):
                yield j, rows, np.flatnonzero(self.starts[rows, j])


def _shards(slabs: DataFrame, run, schema: str, size: int) -> DataFrame:
    parts = max(1, -(-slabs.count() // size))
    return slabs.repartitionByRange(parts, "slab", "b1", "b2", "ids", "conv").mapInArrow(run, schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    held = [b for b in batches if b.num_rows]
    return pa.concat_batches(held) if held else None


def _nodes(slabs: DataFrame, slab: int, size: int) -> DataFrame:
    """Nodes as each shard sees them; `edge` marks those that may go on in another shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        s = Shard(whole)
        names = whole.schema.names
        total = whole.column(names.index("total")).to_numpy()[s.order]
        words = s.matrix(flat(whole.column(names.index("words")))[0], np.arange(s.width) < _lengths(whole)[:, None])
        last_slab = s.slab == (total - 1) // slab
        for j, rows, at in s.depths():
            first = rows[at]
            stop = np.r_[at[1:], len(rows)]
            edge = (first == 0) | (rows[stop - 1] == len(s.conv) - 1)
            members = s.conv[rows]
            ended = last_slab[rows] & (s.length[rows] == j + 1)
            ends: list[str | None] = []
            begin: list[int | None] = []
            pieces: list[str | None] = []
            for a, b, open_end in zip(at.tolist(), stop.tolist(), edge.tolist(), strict=True):
                own = members[a:b][ended[a:b]]
                piece = ",".join(map(str, own.tolist()))
                ends.append(None if open_end else hashlib.sha256(piece.encode()).hexdigest())
                begin.append(int(own[0]) if open_end and len(own) else None)
                pieces.append(piece if open_end and len(own) else None)
            depth = s.slab[first] * slab + j
            before = [(s.b1, s.b2)[i][first] if j == 0 else s.key[i][first, j - 1] for i in (0, 1)]
            top = depth == 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.key[0][first, j]),
                    pa.array(s.key[1][first, j]),
                    pa.array(before[0], mask=top),
                    pa.array(before[1], mask=top),
                    pa.array(depth),
                    pa.array((stop - at).astype(np.int64)),
                    pa.array(np.minimum.reduceat(members, at)),
                    pa.array(words[first, j]),
                    pa.array(edge),
                    pa.array(ends, pa.string()),
                    pa.array(begin, pa.int64()),
                    pa.array(pieces, pa.string()),
                ],
                names=[c.split()[0] for c in NODES.split(", ")],
            )

    return _shards(slabs, run, NODES, size)


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    return flat(batch.column(batch.schema.names.index("ids")))[1]


def _digests(pieces: DataFrame) -> DataFrame:
    """(k1, k2, ends): digest of each node's pieces, in order; they are read one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        made: list[tuple[int, int, str]] = []
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, own in enumerate(zip(k1, k2, strict=True)):
                if own != key:
                    if key is not None:
                        made.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(batch.column(3)[i].as_py().encode())
        if key is not None:
            made.append((*key, digest.hexdigest()))
        columns = list(zip(*made, strict=True)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "ends"]
        )

    sent = pieces.select("k1", "k2", "ends_first", "ends_piece").repartition("k1", "k2")
    return sent.sortWithinPartitions("k1", "k2", "ends_first").mapInArrow(run, "k1 long, k2 long, ends string")


def _sums(slabs: DataFrame, size: int) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens): what the members of each node bring, per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        s = Shard(whole)
        column = {n: whole.column(i) for i, n in enumerate(whole.schema.names)}
        leaves = column["leaves"].to_numpy()[s.order]
        booked = np.zeros(s.alive.shape, dtype=np.int64)
        places, n = flat(column["places"])
        amounts, _ = flat(column["amounts"])
        booked[np.repeat(np.arange(len(n)), n), places] = amounts
        booked = booked[s.order]
        after = np.cumsum(booked[:, ::-1], axis=1)[:, ::-1] + column["later"].to_numpy()[s.order][:, None]
        for j, rows, at in s.depths():
            first = rows[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.key[0][first, j]),
                    pa.array(s.key[1][first, j]),
                    pa.array(np.add.reduceat(leaves[rows], at)),
                    pa.array(np.add.reduceat(after[rows, j], at)),
                ],
                names=["k1", "k2", "n_leaves", "saved_tokens"],
            )

    return _shards(slabs, run, SUMS, size).groupBy("k1", "k2").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )


def _booked(slabs: DataFrame, nodes: DataFrame, slab: int) -> DataFrame:
    """Slabs whose conversation is the smallest member of a node that counts, with what it brings.

    places, amounts: tokens saved at turns of the slab; later: those of the conversation's later slabs;
    leaves: leaves of this slab and of later ones.
    """
    amount = (F.col("n_convs") - 1) * F.col("words")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    counting = nodes.select("conv_id", "depth", amount.alias("amount"), leaf.alias("leaf"))
    counting = counting.where("amount > 0 OR leaf > 0")
    own = counting.groupBy(F.col("conv_id").alias("conv"), F.floor(F.col("depth") / slab).alias("slab")).agg(
        F.collect_list(F.struct((F.col("depth") % slab).alias("place"), "amount")).alias("booked"),
        F.sum("amount").alias("amount"),
        F.sum("leaf").alias("leaf"),
    )
    zero = F.lit(0).cast("long")
    own = own.select("conv", "slab", "booked.place", F.col("booked.amount").alias("amounts"), "amount", "leaf")
    own = own.withColumnRenamed("place", "places")
    joined = slabs.join(own, ["conv", "slab"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("amount", "leaf")}
        | {c: F.coalesce(c, F.array().cast("array<long>")) for c in ("places", "amounts")}
    )
    short = joined.where(F.col("total") <= slab).withColumns({"later": zero, "later_leaf": zero})
    window = _before("conv", F.desc("slab"))
    long = joined.where(F.col("total") > slab).withColumns(
        {
            "later": F.coalesce(F.sum("amount").over(window), zero),
            "later_leaf": F.coalesce(F.sum("leaf").over(window), zero),
        }
    )
    both = short.unionByName(long).withColumn("leaves", F.col("leaf") + F.col("later_leaf"))
    return both.where("amount > 0 OR later > 0 OR leaves > 0").select(
        "conv", "slab", "b1", "b2", "ids", "seconds", "places", "amounts", "later", "leaves"
    )


def trie(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    slab: int = SLAB,
    shard: int = SHARD,
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    ship(spark)
    own = conversations.select(*named(dict.fromkeys([conv, turn, role, text])))
    slabs = _slabs(_rebuilt(_turns(own, conv, turn, role, text)), slab)
    parts = written(_nodes(slabs, slab, shard), "trie-nodes")
    keys = ["k1", "k2", "p1", "p2", "depth"]
    inner = parts.where("NOT edge").select(*keys, "n_convs", "conv_id", "words", "ends")
    edges = parts.where("edge")
    pieces = _digests(edges.where(F.col("ends_piece").isNotNull()))
    joined = edges.groupBy(*keys).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words")
    )
    joined = joined.join(pieces, ["k1", "k2"], "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY)))
    nodes = written(inner.unionByName(joined), "trie-nodes")
    # The parent's id comes down to the children, their number goes up; both joins keep whole rows of a
    # parent with very many children apart.
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), ["k1", "k2"], "left")
    nodes = written(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    sums = _sums(written(_booked(slabs, nodes, slab), "booked"), shard)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, ["k1", "k2"], "left")
        .join(parents, ["p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.col("ends").alias("ends_sha256"),
        )
    )
