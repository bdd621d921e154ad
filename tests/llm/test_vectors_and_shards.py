"""Nearest neighbours and shards: SQL, brute force and odd inputs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from fieldtally.llm import oracle, queries, shards, vectors
from fieldtally.llm.shared import folder


@pytest.fixture(scope="module")
def con(testdata):
    return compare.connect(testdata)


@pytest.mark.parametrize("name", ["op8_neighbours", "op9_sharding"])
def test_queries_equal_their_sql(spark, testdata, con, name):
    assert compare.differences(queries.queries()[name](spark, testdata), con, oracle.SQL[name]) is None


def product(v, w):
    total = 0.0
    for a, b in zip(v, w):  # sum() would compensate
        total += a * b
    return total


def brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = {}
    for i, v in ok:
        if i % 20 == 0:
            scored = sorted((-product(v, w), j) for j, w in ok if j != i)[:k]
            found[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return {i: f for i, f in found.items() if f}


def test_blocks_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).astype("float32").astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(90)]  # one very common vector
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [math.nan] * 8), (2080, [None] + [1.0] * 7),
             (2100, [math.inf] * 8), (2120, [1.0] * 3), (None, [1.0] * 8), (2140, [1e30] * 8), (2160, [1e-30] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    for sizes in ({}, {"candidates": 50, "queries": 7}):
        found = defaultdict(list)
        for r in vectors.nearest(frame, F.col("vec_id") % 20 == 0, k=5, **sizes).collect():
            found[r.query_id].append((r.rank, r.vec_id, r.score))
        assert {i: sorted(f) for i, f in found.items()} == brute(rows, 5)


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    rows = vectors.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 11.0)]
    assert vectors.nearest(frame.where("vec_id > 9"), F.col("vec_id") % 20 == 0).count() == 0
    assert vectors.nearest(frame.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_are_repeated_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 3, 2.0), (0, 2, 3, 2.0)]


def test_vectors_of_one_id_are_spread_over_blocks(spark, monkeypatch):
    """All queries had one id's block; a tile then held all of its vectors."""
    rnd = np.random.default_rng(6)
    rows = [(20, rnd.normal(size=4).tolist()) for _ in range(400)] + [(i, rnd.normal(size=4).tolist()) for i in range(1, 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = spark.sparkContext.accumulator(0)
    whole = vectors.tile

    def tile(q_ids, q, c_ids, c, k):
        seen.add(int(len(q) > 100))
        return whole(q_ids, q, c_ids, c, k)

    monkeypatch.setattr(vectors, "tile", tile)
    found = vectors.nearest(frame, F.col("vec_id") % 20 == 0, k=3, queries=50).collect()
    assert len(found) == 400 * 3 and {r.vec_id for r in found} <= set(range(1, 9))
    assert seen.value == 0


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    for scale in (1e-12, 1.0, 1e12):
        v = rnd.normal(size=(200, 33)) * scale
        codes, s, norm, lost = vectors._quantised(v)
        near = vectors._product(codes, codes) * s[:, None] * s
        bound = lost[:, None] * norm + (norm + lost)[:, None] * lost
        assert (np.abs(near - v @ v.T) <= bound * (1 + 1e-9) + 1e-12 * norm[:, None] * norm).all()


def check_shards(rows, limit):
    size, number = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.shard] += r.n_bytes
        number[r.shard] += 1
    for r in rows:
        assert (r.shard_bytes, r.shard_docs) == (size[r.shard], number[r.shard])
        assert size[r.shard] <= limit or number[r.shard] == 1
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]) if "/" not in a + b)
    return size


@pytest.mark.parametrize("limit", [1, 20_000, 200_000, 10**9])
def test_only_oversized_buckets_split(spark, testdata, con, limit):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    found = shards.assign(docs, limit)
    assert len(check_shards(found.collect(), limit)) >= 1
    if limit > 1:
        sql = oracle.SHARDING.replace(str(queries.SHARD_BYTES), str(limit))
        assert compare.differences(found, con, sql) is None


def test_one_hot_key_and_equal_rows(spark):
    rows = [(7, f"text {i:04}") for i in range(300)] + [(8, "same text")] * 200 + [(9, "x" * 500)]
    rows += [(None, None), (None, "n"), (10, ""), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("s"))
    found = shards.assign(docs, 100).collect()
    assert len(found) == len(rows)
    check_shards(found, 100)
    assert shards.assign(docs.where("doc_id > 99"), 100).count() == 0
    with pytest.raises(ValueError, match="one byte"):
        shards.assign(docs, 0)


def test_written_shards(spark, testdata, tmp_path):
    docs = spark.read.parquet(f"{testdata}/documents.parquet").select("doc_id", "text")
    shards.write(docs, shards.assign(docs, 300_000), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    assert len(sizes) > 4 and all(r.b <= 300_000 for r in sizes)


@pytest.mark.parametrize("limit", [60, 100, 700, 10**6])
def test_null_and_repeated_keys_are_written_once_each(spark, tmp_path, limit):
    rows = [(7, f"text {i:04}") for i in range(300)] + [(8, "same text")] * 200 + [(9, "x" * 500)] * 2
    rows += [(None, None), (None, "n"), (None, "n" * 40), (None, "n" * 41), (10, ""), (11, None)] * 3
    rows = [(k, t, i) for i, (k, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    assigned = shards.assign(docs, limit)
    shards.write(docs, assigned, str(tmp_path / "out"))
    back = shards.read(spark, str(tmp_path / "out"), docs.schema)
    assert sorted(back.drop("shard_").collect(), key=lambda r: r.shard) == rows
    found = shards.contents(spark, str(tmp_path / "out"), docs.schema)
    check_shards(found.collect(), limit)
    assert found.columns == assigned.columns
    order = dict(key=lambda r: [str(x) for x in r])
    assert sorted(found.collect(), **order) == sorted(assigned.collect(), **order)


def test_the_sharding_query_writes_every_document(spark, testdata, monkeypatch):
    paths = []
    monkeypatch.setattr(queries, "folder", lambda spark, name: paths.append(folder(spark, name)) or paths[-1])
    rows = queries.queries()["op9_sharding"](spark, testdata).count()
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    back = shards.read(spark, paths[0], docs.schema).drop("shard")
    assert rows == docs.count() and back.exceptAll(docs).isEmpty() and docs.exceptAll(back).isEmpty()


def test_a_document_without_a_shard_is_no_silent_loss(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(64)], "doc_id long, text string")
    assigned = shards.assign(docs, 100)
    other = assigned.where(F.col("shard") != assigned.agg(F.max("shard")).first()[0])
    with pytest.raises(Exception, match="in no shard"):
        shards.write(docs, other, str(tmp_path / "out"))
