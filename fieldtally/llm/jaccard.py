"""Jaccard join of documents on word shingles, with Bayesian pruning of candidates.

Words are runs of code points other than blank, tab and line breaks; a document is its set of
shingles of five words in a row (all its words, if fewer). Two documents are linked at a similarity
of 0.8 or more.

1. Documents with the same set are one class from here on. A class has a MinHash signature.
2. Candidates share a band of the signature. At the threshold a pair of sets shares none of the 32
   bands of 4 values with probability 5e-8; that is all that candidate search may miss.
3. Classes that share a band meet in tiles of bounded size: a large bucket is cut into blocks and
   every two blocks meet. In a tile, the values of two signatures are compared a few at a time. The
   matches so far give a posterior of the similarity (uniform prior); a pair is dropped as soon as
   the posterior probability of reaching the threshold falls below the tolerance (1e-9). A tile
   emits a spanning forest of the pairs that pass, as stars, never the pairs.
4. The forests' components hold all pairs that are left. Texts on a common template, of which no two
   are linked, can make one large component there. So classes of a component get 384 more values and
   meet once more in tiles, by signatures alone; the same posterior over 512 values drops pairs up to
   a similarity of about 0.69. The components of what stays are finer.
5. Classes of a finer component meet in tiles of bounded size with their whole shingle sets. Pairs
   pass the signatures again and are verified exactly. A tile emits, per class, how many classes and
   documents it is linked to, and a forest of links. Components of the links are the near-duplicate
   classes.

So no join ever makes a row per pair, and a group of copies, or of near copies, of any size is
spread over tiles. Texts are shuffled once, sets of candidates three times. Tables between steps are
written to the shared folder.

Defined cases: a text that is null or has no word is linked to nothing; repeated rows are copies
of each other; doc_id may have any type with an order; a null doc_id takes part, is never the
smallest, and class_id is null where no member has an id; very long texts are read whole, and their
sets compared whole; an empty table gives an empty result; further columns are ignored, whatever
their names. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.components import components
from fieldtally.llm.shared import chunks, code_points, fresh, mixed, named, ship, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values of a class whose first HASHES values agree with another's.
LONG = 512
#: Values compared at a time.
STEP = 16
TOLERANCE = 1e-9
#: Classes per block of a bucket, and of a component under verification.
BLOCK = 1024
VERIFIED = 512

_SEPARATORS = np.zeros(0x110000, dtype=bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
    up[1:], down[1:] = _BASE, _INVERSE
    return np.cumprod(up), np.cumprod(down)


@cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    """(value of each code point, multiplier of each hash function)."""
    values = mixed(np.arange(1, 0x110001, dtype=np.uint64))
    return values, mixed(np.arange(1, LONG + 1, dtype=np.uint64) << np.uint64(32)) | np.uint64(1)


def shingles_of(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in order, repeats included; shingles per text)."""
    points = code_points("".join([(t or "") + "\n" for t in texts]))
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    value, _ = _constants()
    up, down = _powers(1 << max(10, int(len(points) + 1).bit_length()))
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(value[points] * up[: len(points)], out=total[1:])
    inside = ~_SEPARATORS[points]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = mixed((total[stops] - total[starts]) * down[starts])
    text_of = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(text_of, minlength=len(texts))
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    first_word = np.cumsum(n_words) - n_words
    first = np.cumsum(n) - n
    at = np.repeat(first_word - first, n) + np.arange(int(n.sum()))
    size = np.repeat(np.minimum(n_words, words), n)
    padded = np.concatenate([word, np.zeros(words, dtype=np.uint64)])
    made = size.astype(np.uint64)
    for i in range(words):
        made = mixed(made * np.uint64(_BASE) + np.where(i < size, padded[at + i], np.uint64(0)))
    return made, n


def signatures(shingles: np.ndarray, counts: np.ndarray, first: int = 0, last: int = HASHES) -> np.ndarray:
    """MinHash values of the hash functions from `first` to before `last` (texts with shingles, values)."""
    _, factors = _constants()
    starts = (np.cumsum(counts) - counts)[counts > 0]
    made = np.empty((len(starts), last - first), dtype=np.uint64)
    for k, factor in enumerate(factors[first:last]):
        made[:, k] = np.minimum.reduceat(shingles * factor, starts)
    return made


def short(signature: np.ndarray) -> np.ndarray:
    """The values by 8 bits."""
    return (mixed(signature) >> np.uint64(56)).astype(np.uint8)


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    parts = signature.reshape(len(signature), BANDS, ROWS)
    for i in range(ROWS):
        key = mixed(key * np.uint64(_BASE) + parts[:, :, i])
    return key


@cache
def least_matches(threshold: float, tolerance: float, values: int = HASHES) -> np.ndarray:
    """[k]: matches needed among the first (k + 1) * STEP values for a pair to stay.

    Values are compared by 8 bits, so two differing ones match with probability 1/256. The
    posterior of the similarity is integrated on a grid.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    needed = []
    for n in range(STEP, values + 1, STEP):
        least = n
        for m in range(n, -1, -1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() < tolerance * weight.sum():
                break
            least = m
        needed.append(least)
    return np.array(needed)


def _stays(a: np.ndarray, b: np.ndarray, n_a, n_b, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (row i of a, row i of b) pass: sizes first, then signatures step by step."""
    least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    left = np.flatnonzero(least >= threshold * most - 1e-9)
    matches = np.zeros(len(left), dtype=np.int64)
    for k, needed in enumerate(least_matches(threshold, tolerance, a.shape[1])):
        if not len(left):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (a[left, part] == b[left, part]).sum(axis=1)
        keep = matches >= needed
        left, matches = left[keep], matches[keep]
    stays = np.zeros(len(a), dtype=bool)
    stays[left] = True
    return stays


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, bounds) of a binary column without nulls."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return content[bounds[0] : bounds[-1]], bounds - bounds[0]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first two columns, as whole groups with the bounds of each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
        if held:
            last = held[-1]
            if any(last.column(i)[-1].as_py() != keys[i][0] for i in (0, 1)):
                cuts = np.insert(cuts, 0, 0)
        if len(cuts):
            whole = pa.concat_batches([*held, batch.slice(0, cuts[-1])])
            shift = whole.num_rows - cuts[-1]
            if whole.num_rows:
                yield whole, np.concatenate([[0], cuts + shift])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        whole = pa.concat_batches(held)
        yield whole, np.array([0, whole.num_rows])


def _tiled(rows: DataFrame, key: str, size: Column, block: int) -> DataFrame:
    """Rows with `tile` and `part`, once for every two blocks of their group that include theirs."""
    parts = F.ceil(size / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("*", other)
    tile = F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other")
    return rows.withColumn("tile", tile).drop("parts", "other")


def _prepared(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, text hash, node (class of equal shingle sets, null without words), set size, bands, signature."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
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
                made, counts = shingles_of(texts)
                full = counts > 0
                node = np.zeros(b - a, dtype=np.int64)
                size = np.zeros(b - a, dtype=np.int32)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                for i in np.flatnonzero(full):
                    own = np.unique(made[bounds[i] : bounds[i + 1]])
                    size[i], node[i] = len(own), _node(own)
                bands = np.zeros((b - a, BANDS), dtype=np.int64)
                sig = np.zeros((b - a, HASHES), dtype=np.uint8)
                if full.any():
                    signature = signatures(made, counts)
                    bands[full] = band_keys(signature).view(np.int64)
                    sig[full] = short(signature)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(node, mask=~full),
                        pa.array(size),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())
                        ),
                        pa.array([row.tobytes() for row in sig], pa.binary()),
                    ],
                    names=["doc_id", "t", "node", "n", "bands", "sig"],
                )

    return frame.mapInArrow(run, schema)


def _node(own: np.ndarray) -> int:
    """Name of a class: a hash of its sorted shingles."""
    value = xxhash.xxh64_intdigest(own.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _star(node: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of their tree), for all but the smallest; tree: number of each node's tree."""
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, tree, node)
    rest = np.flatnonzero(node != least[tree])
    return node[rest], least[tree[rest]]


def _forests(buckets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): per tile of (key, tile, node, n, sig), a spanning forest of the pairs that pass, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _groups(batches):
            node = rows.column(2).to_numpy()
            n = rows.column(3).to_numpy()
            sig = _binary(rows.column(4))[0].reshape(len(node), -1)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            passed = two[_stays(sig[two], sig[two + 1], n[two], n[two + 1], threshold, tolerance)]
            left, right = [node[passed]], [node[passed + 1]]
            for at in np.flatnonzero(sizes > 2):
                a, b = bounds[at], bounds[at + 1]
                tree = np.arange(b - a)
                for i, others in _reached(sig[a:b], n[a:b], threshold, tolerance):
                    tree[others] = tree[i]
                nodes, least = _star(node[a:b], tree)
                left.append(nodes)
                right.append(least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"]
            )

    return buckets.mapInArrow(run, "a long, b long")


def _reached(sig, n, threshold: float, tolerance: float) -> Iterator[tuple[int, np.ndarray]]:
    """Search from row to row: (row, rows first reached from it)."""
    new = np.arange(len(n))
    waiting: list[int] = []
    while len(new):
        if not waiting:
            waiting, new = [int(new[0])], new[1:]
        i = waiting.pop()
        if not len(new):
            break
        to = np.broadcast_to(sig[i], (len(new), sig.shape[1]))
        stays = _stays(to, sig[new], n[i], n[new], threshold, tolerance)
        if stays.any():
            yield i, new[stays]
            waiting += new[stays].tolist()
            new = new[~stays]


def _verified(tiles: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Per tile of (comp, tile, node, part, n, docs, sig, set): rows (node, classes, docs) of what a
    class is linked to in this tile, and rows (node, other) of a forest of the links, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _groups(batches):
            node, part = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            n, docs = rows.column(4).to_numpy().astype(np.int64), rows.column(5).to_numpy()
            sig = _binary(rows.column(6))[0].reshape(len(node), -1)
            content, places = _binary(rows.column(7))
            sets, places = content.view(np.uint64), places // 8
            columns: list[list[np.ndarray]] = [[], [], [], []]

            def put(*parts: np.ndarray) -> None:
                for column, values in zip(columns, parts, strict=True):
                    column.append(values)

            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                own = slice(a, b)
                linked = _links(
                    part[own], n[own], sig[own], sets[places[a] : places[b]], places[a : b + 1] - places[a],
                    threshold, tolerance,
                )
                classes = np.zeros(b - a, dtype=np.int64)
                others = np.zeros(b - a, dtype=np.int64)
                label = np.arange(b - a)
                for i, j in linked:
                    classes[i] += len(j)
                    others[i] += docs[own][j].sum()
                    classes[j] += 1
                    others[j] += docs[own][i]
                    label[np.isin(label, label[j])] = label[i]
                nodes, least = _star(node[own], label)
                put(nodes, least, np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64))
                some = classes > 0
                put(node[own][some], node[own][some], classes[some], others[some])
            if columns[0]:
                made = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays(made, names=["a", "b", "classes", "docs"])

    return tiles.mapInArrow(run, "a long, b long, classes long, docs long")


def _links(part, n, sig, sets, places, threshold, tolerance) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows linked to it): pruned by signatures, the rest by whole sets. Rows of one part
    are compared in the tile of that part alone."""
    shared = None
    mark = None
    one = (part == part[0]).all()
    for i in range(len(n) - 1):
        later = np.arange(i + 1, len(n))
        if not one:
            later = later[part[later] != part[i]]
        to = np.broadcast_to(sig[i], (len(later), sig.shape[1]))
        later = later[_stays(to, sig[later], n[i], n[later], threshold, tolerance)]
        if not len(later):
            continue
        if shared is None:
            _, shared = np.unique(sets, return_inverse=True)
            mark = np.zeros(int(shared.max()) + 1, dtype=np.int32)
        own = shared[places[i] : places[i + 1]]
        mark[own] = 1
        sizes = n[later]
        before = np.cumsum(sizes) - sizes
        index = np.repeat(places[later] - before, sizes) + np.arange(int(sizes.sum()))
        common = np.add.reduceat(mark[shared[index]], before)
        mark[own] = 0
        later = later[common >= threshold * (n[i] + sizes - common) - 1e-9]
        if len(later):
            yield i, later


def _sets(rows: DataFrame) -> DataFrame:
    """(comp, node, size, n, docs, sig, text) to the same with LONG values and, for the text, its sorted
    shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for a, b, texts in chunks(batch.column(6)):
                made, counts = shingles_of(texts)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                own = [np.unique(made[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
                # A repeated doc_id may come with another text of the same hash; that is not the class.
                right = pa.array([_node(s) == w for s, w in zip(own, wanted[a:b], strict=True)])
                more = np.zeros((b - a, LONG - HASHES), dtype=np.uint8)
                sizes = np.array([len(s) for s in own])
                if sizes.any():
                    more[sizes > 0] = short(signatures(np.concatenate(own), sizes, HASHES, LONG))
                first = batch.column(5).slice(a, b - a).to_pylist()
                part = pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, b - a) for i in range(5)),
                        pa.array([f + m.tobytes() for f, m in zip(first, more, strict=True)], pa.binary()),
                        pa.array([s.tobytes() for s in own], pa.binary()),
                    ],
                    names=["comp", "node", "size", "n", "docs", "sig", "shingles"],
                )
                yield part.filter(right)

    return rows.mapInArrow(
        run, "comp long, node long, size long, n int, docs long, sig binary, shingles binary"
    )


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    verified: int = VERIFIED,
) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, n_texts, t, stays.

    class_id: smallest doc_id of all documents it is linked to, over any number of links, its own
    included. copy_id: smallest doc_id with the same shingle set. n_links: other documents linked
    to it, copies included. n_texts: other sets linked to it. t: a hash of the text. stays: whether
    it is the first of its class, by doc_id, then by t (null, if it has no words).
    """
    spark = docs.sparkSession
    ship(spark)
    known = written(_prepared(docs, id_col, text), "signatures")
    classes = (
        known.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.count("*").alias("docs"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("first"),
        )
    )
    members = known.select("node", "n", "bands", "sig").where(F.col("node").isNotNull()).dropDuplicates(["node"])
    members = written(members, "classes")

    # Buckets of two classes at least.
    keys = members.select("node", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keys.join(sizes, "key").join(members.select("node", "n", "sig"), "node")
    tiles = _tiled(met, "key", F.col("size"), block).select("key", "tile", "node", "n", "sig")
    tiles = tiles.repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
    candidates = components(_forests(tiles, threshold, tolerance)).withColumnRenamed("label", "comp")

    # Their texts, as sets.
    candidates = written(candidates, "candidates")
    counts = candidates.groupBy("comp").agg(F.count("*").alias("size"))
    wanted = (
        candidates.join(counts, "comp")
        .join(members.select("node", "n", "sig"), "node")
        .join(classes, "node")
        .select(
            "comp", "node", "size", "n", "docs", "sig",
            F.col("first.doc_id").alias("_id"), F.col("first.t").alias("_t"),
        )
    )
    texts = docs.select(F.col(id_col).alias("_d"), F.xxhash64(text).alias("_h"), F.col(text).alias("x"))
    found = texts.join(wanted, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")))
    sets = _sets(found.select("comp", "node", "size", "n", "docs", "sig", "x")).dropDuplicates(["node"])
    sets = written(sets, "sets")

    # Finer components, by signatures alone.
    tiles = _tiled(sets.select("comp", "node", "size", "n", "sig"), "comp", F.col("size"), block)
    tiles = tiles.select("comp", "tile", "node", "n", "sig")
    tiles = tiles.repartition("comp", "tile").sortWithinPartitions("comp", "tile", "node")
    finer = written(components(_forests(tiles, threshold, tolerance)).withColumnRenamed("label", "comp"), "finer")
    counts = finer.groupBy("comp").agg(F.count("*").alias("size"))
    sets = sets.drop("comp", "size").join(finer.join(counts, "comp"), "node")

    tiles = _tiled(sets, "comp", F.col("size"), verified)
    tiles = tiles.select("comp", "tile", "node", "part", "n", "docs", "sig", "shingles")
    tiles = tiles.repartition("comp", "tile").sortWithinPartitions("comp", "tile", "node")
    links = written(_verified(tiles, threshold, tolerance), "links")

    # Classes, counts and names.
    totals = (
        links.where("a = b").groupBy(F.col("a").alias("node"))
        .agg(F.sum("classes").alias("n_texts"), F.sum("docs").alias("linked"))
    )
    labels = components(links.where("a <> b").select("a", "b"))
    totalled = (
        classes.select("node", "docs", "first", F.col("first.doc_id").alias("copy_id"))
        .join(labels, "node", "left")
        .join(totals, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    least = totalled.groupBy("label").agg(F.min("first").alias("least"))
    totalled = totalled.join(least, "label").select(
        "node",
        F.col("least.doc_id").alias("class_id"),
        F.col("least.t").alias("class_t"),
        "copy_id",
        (F.coalesce("linked", F.lit(0)) + F.col("docs") - 1).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )
    none = F.col("node").isNull()
    return known.select("doc_id", "t", "node").join(totalled, "node", "left").select(
        F.col("doc_id").alias(id_col),
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        "t",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("class_t"))).alias("stays"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The first document of each class, with the same columns; documents without words all stay.

    One of several rows with the same doc_id and text stays.
    """
    id_name, hash_name = fresh("id", docs.columns), fresh("t", docs.columns)
    keyed = docs.withColumn(id_name, F.col(id_col)).withColumn(hash_name, F.xxhash64(text))
    blank = F.length(F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\f\r", "")) == 0
    first_id, first_hash = fresh("first_id", docs.columns), fresh("first_t", docs.columns)
    first = (
        join(docs, id_col, text, **limits)
        .where("stays")
        .select(F.col(id_col).alias(first_id), F.col("t").alias(first_hash))
        .distinct()
    )
    same = F.col(id_name).eqNullSafe(F.col(first_id)) & (F.col(hash_name) == F.col(first_hash))
    kept = keyed.where(~blank).join(first, same).dropDuplicates([id_name, hash_name])
    return kept.select(*named(docs.columns)).union(keyed.where(blank).select(*named(docs.columns)))
