"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of a hash of the key. It starts as one bucket; a bucket
over the byte limit, and only such a bucket, is split on one more bit, until all fit. A bucket is
named by its bits ('' is the undivided one).

The splits are not carried out one by one: bytes are summed once per cell of some more bits than
the directory should need, and rolled up to every shorter prefix. Buckets shrink as bits are added,
so a row's shard is its shortest prefix that fits. Cells that are still too large are summed again
with more bits, over their rows alone.

When all bits are used, rows share one key (or one hash). They are split on by a hash of the text,
and when that is used too, the rows are equal; they are dealt into numbered pages that fit.

Shards are written with their texts: each row finds its shard by its own hashes in the directory of
shards, never by its key, so null and repeated keys are written like any other. Texts are shuffled
once, and a row that has no shard stops the writing. What was written can be read back as an assignment.

Defined cases: a null text has no bytes; a null key counts as a key of its own; a single row over
the limit is a shard alone, since no split can help; repeated rows go to one shard, or to pages if
they exceed it; an empty table gives no row. Shards without rows do not exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.shared import fresh, named, written

#: Bits of one hash.
BITS = 60
#: Bits summed beyond those that even buckets would need, and added in every further round.
MORE = 3
#: Equal rows are numbered in blocks of 2 to this power.
BLOCK_BITS = 16


def hashed(value: Column) -> Column:
    """The first 60 bits of the value's MD5, a number that other engines can work out too."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def _hashes(key: str, text: str) -> list[Column]:
    """h1 of the key and h2 of key and text."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    whole = F.concat(name, F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    return [hashed(name).alias("h1"), hashed(whole).alias("h2")]


def _bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")


def _bits(prefix: Column, depth: Column) -> Column:
    name = F.lpad(F.bin(prefix), BITS, "0")
    return F.substring(name, F.lit(BITS + 1) - depth, depth)


def _directory(rows: DataFrame, hash_col: str, bits: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes, shard_docs) of each cell of `bits` bits; depth null if none fits."""
    cell = F.shiftrightunsigned(hash_col, BITS - bits).alias("cell")
    cells = rows.groupBy(cell).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
    whole = levels.select("cell", "depth", "prefix").join(sums.where(fits), ["depth", "prefix"])
    shortest = whole.groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("shard")
    )
    return cells.select("cell").join(shortest, "cell", "left").select("cell", "shard.*")


def _by_bits(rows: DataFrame, hash_col: str, limit: int, before: Column) -> tuple[list[DataFrame], DataFrame | None]:
    """(frames of rows with shard, depth, shard_bytes, shard_docs; rows that all bits do not part)."""
    total = rows.agg(F.sum("n_bytes").alias("b")).collect()[0]["b"] or 0
    bits = min(BITS, max(0, -(-total // limit) - 1).bit_length() + MORE)
    done = []
    while True:
        found = _directory(rows, hash_col, bits, limit)
        marked = rows.withColumn("cell", F.shiftrightunsigned(hash_col, BITS - bits)).join(found, "cell")
        done.append(
            marked.where(F.col("depth").isNotNull()).select(
                *rows.columns,
                F.concat(before, _bits(F.col("prefix"), F.col("depth"))).alias("shard"),
                "depth", "shard_bytes", "shard_docs",
            )
        )
        rest = written(marked.where(F.col("depth").isNull()).select(*rows.columns), "shards-rest")
        if rest.isEmpty():
            return done, None
        if bits == BITS:
            return done, rest
        rows, bits = rest, min(BITS, bits + 4 * MORE)


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, shard, depth, shard_bytes, shard_docs for each row.

    What the rows need (ids, sizes and hashes, no texts) is written to the shared folder first.
    """
    if limit < 1:
        raise ValueError("a shard holds one byte at least")
    rows = written(docs.select(F.col(key).alias("_key"), _bytes(text), *_hashes(key, text)), "shards")
    done, rest = _by_bits(rows, "h1", limit, F.lit(""))
    if rest is not None:
        # One key over the limit: its rows by their texts, key by key.
        name = F.concat(_bits(F.col("h1"), F.lit(BITS)), F.lit("/"))
        per_key = rest.withColumn("h0", F.col("h2"))
        more, equal = _by_bits(per_key, "h0", limit, name)
        done += [_within_key(m, limit) for m in more]
        if equal is not None:
            done.append(_pages(equal, limit))
    columns = ["_key", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    assigned = reduce(DataFrame.unionByName, [d.select(columns) for d in done])
    return assigned.withColumnRenamed("_key", key)


def _within_key(rows: DataFrame, limit: int) -> DataFrame:
    """Sizes of shards below one key: prefixes were summed over all such keys, so no more than limit."""
    sizes = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return rows.drop("shard_bytes", "shard_docs").join(sizes, "shard").withColumn("depth", F.col("depth") + BITS)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with `nth`, from 0 in each group of equal h1 and h2. A task numbers blocks of a group.

    The rows are written first, so that their numbers stay.
    """
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "shards-equal")
    rows = rows.withColumn("_block", F.shiftright("_row", BLOCK_BITS))
    block = ["h1", "h2", "_block"]
    earlier = Window.partitionBy("h1", "h2").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*block).orderBy("_row")) - 1
    return rows.join(blocks, block).withColumn("nth", F.col("_before") + own).drop("_row", "_block", "_before")


def _page(each: Column) -> Column:
    """Name of the page of a numbered row, `each` rows a page."""
    page = F.floor(F.col("nth") / each)
    return F.concat_ws("/", _bits(F.col("h1"), F.lit(BITS)), _bits(F.col("h2"), F.lit(BITS)), page)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows, dealt into pages that are full but for the last."""
    groups = rows.groupBy("h1", "h2").agg(F.max("n_bytes").alias("_most"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("_most"), F.lit(1))))
    paged = _numbered(rows).join(groups, ["h1", "h2"]).withColumn("shard", _page(each))
    sizes = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return paged.join(sizes, "shard").withColumn("depth", F.lit(2 * BITS))


def _number(bits: Column) -> Column:
    """The smallest hash that begins with these bits."""
    return F.conv(F.rpad(bits, BITS, "0"), 2, 10).cast("long")


def _found(rows: DataFrame, hash_col: str, names: DataFrame, least: int, out: str) -> DataFrame:
    """Rows with the bits in `names`, none shorter than `least`, that their hash begins with, or null.

    One look-up: names are gathered by their first `least` bits, a few each.
    """
    ranges = names.select(
        _number(F.col("name")).alias("first"),
        (_number(F.col("name")) + F.expr(f"shiftleft(1L, {BITS} - length(name))")).alias("end"),
        "name",
    )
    cell = F.shiftrightunsigned("first", BITS - least).alias("_cell")
    cells = written(ranges.groupBy(cell).agg(F.collect_list(F.struct("first", "end", "name")).alias("_names")), "shards-cells")
    h = F.col(hash_col)
    own = F.filter("_names", lambda x: (x["first"] <= h) & (h < x["end"]))
    joined = rows.withColumn("_cell", F.shiftrightunsigned(hash_col, BITS - least)).join(cells, "_cell", "left")
    return joined.withColumn(out, F.get(own, 0)["name"]).drop("_cell", "_names")


def write(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """All rows of docs, with all columns, as one Parquet folder per shard: `b` and its name.

    assigned: what assign() gives for the same documents, key and text. The folders' column is
    `shard`, or a name like it that the documents do not have.
    """
    part = fresh("shard", docs.columns)
    directory = written(assigned.groupBy("shard").agg(F.count("*").alias("n")), "shards-directory")
    directory = directory.withColumn("names", F.split("shard", "/"))
    levels = {
        r["level"]: r["least"]
        for r in directory.groupBy(F.size("names").alias("level"))
        .agg(F.min(F.length(F.element_at("names", -1))).alias("least"))
        .collect()
    }
    rows = docs.select(F.struct(*named(docs.columns)).alias("_doc"), *_hashes(key, text))
    rows = rows.withColumn("_shard", F.lit(None).cast("string"))
    if 1 in levels:
        rows = _found(rows, "h1", directory.where(F.size("names") == 1).select(F.col("shard").alias("name")), levels[1], "_own")
        rows = rows.withColumn("_shard", F.col("_own")).drop("_own")
    if 2 in levels:
        names = directory.where(F.size("names") == 2).select(F.col("names")[1].alias("name")).distinct()
        rows = _found(rows, "h2", names, levels[2], "_own")
        below = F.concat(_bits(F.col("h1"), F.lit(BITS)), F.lit("/"), F.col("_own"))
        rows = rows.withColumn("_shard", F.coalesce("_shard", below)).drop("_own")
    if 3 in levels:
        equal = directory.where(F.size("names") == 3)
        groups = equal.groupBy(*(_number(F.col("names")[i]).alias(h) for i, h in enumerate(("h1", "h2"))))
        paged = _numbered(rows.where(F.col("_shard").isNull()).drop("_shard"))
        paged = paged.join(groups.agg(F.max("n").alias("_each")), ["h1", "h2"], "left")
        paged = paged.withColumn("_shard", F.when(F.col("_each").isNotNull(), _page(F.col("_each"))))
        rows = rows.where(F.col("_shard").isNotNull()).unionByName(paged.select(*rows.columns))
    shard = F.coalesce("_shard", F.raise_error(F.lit("a document is in no shard of the assignment")))
    whole = rows.select(
        *(F.col("_doc").getField(c).alias(c) for c in docs.columns), F.concat(F.lit("b"), shard).alias(part)
    )
    whole.repartition(f"`{part}`").write.partitionBy(part).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The documents of all shards, with their shard's name; schema: that of the documents."""
    part = fresh("shard", schema.names)
    rows = spark.read.schema(T.StructType([*schema, T.StructField(part, T.StringType())])).parquet(path)
    return rows.withColumn(part, F.expr(f"substring(`{part}`, 2)"))


def contents(spark: SparkSession, path: str, schema: T.StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of assign(), counted from the shards as they were written."""
    part = fresh("shard", schema.names)
    rows = read(spark, path, schema).select(F.col(key).alias("_key"), _bytes(text), F.col(part).alias("shard"))
    rows = written(rows, "shards-contents")
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    names = F.split("shard", "/")
    depth = (F.least(F.size(names) - 1, F.lit(1)) * BITS + F.length(F.get(names, F.least(F.size(names) - 1, F.lit(1))))).cast("int")
    sums = written(sums.withColumn("depth", depth), "shards-sums")
    columns = ["_key", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    return rows.join(sums, "shard").select(columns).withColumnRenamed("_key", key)
