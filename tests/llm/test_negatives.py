"""Hard negatives against brute force and SQL; the curve and the bounds on made vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from fieldtally.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, best=10):
    """Set of result rows; labels as given."""
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if sum(x * x for x in w) < 1 << 53:
            usable.append((i, tuple(w), label))
    found = []
    for i, v, label in set(usable):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, w, m in usable if len(w) == len(v)]
        scored.sort()
        good = [(j, -s) for s, j, m in scored if m == label and j != i][:positives]
        for j, ps in good:
            bad = [(k, -s) for s, k, m in scored if m != label and 30 * ps <= -100 * s <= 90 * ps][:best]
            found += [(i, j, r + 1, k, ps, ns) for r, (k, ns) in enumerate(bad)]
    return sorted(found)


def mined(df, **options):
    order = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in negatives.mine(df, **options).select(*order).collect())


def cloud(n, dimension, seed, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dimension))
    of = rng.integers(0, centres, n)
    v = (centre[of] + spread * rng.normal(size=(n, dimension))).astype(np.float32)
    return [(i, v[i].tolist(), int(of[i] % 3)) for i in range(n)]


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dimension, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimension, indexing="ij"), -1).reshape(-1, dimension)
        keys = [k.tobytes() for k in negatives.hilbert(grid, bits)]
        assert len(set(keys)) == len(keys)
        path = grid[np.argsort(np.array(keys, dtype=object))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "group": 8}])
def test_rows_are_those_of_brute_force(spark, sizes):
    rows = cloud(1500, 6, 1) + [(5000 + 100 * i, [1.0, 2.0, 3.0], i % 2) for i in range(4)]
    rows += [(7000 + i, [0.5 * i, 1.0, 2.0], i % 2) for i in range(30)]
    assert mined(spark.createDataFrame(rows, SCHEMA), **sizes) == brute(rows)


def looked_up(frame, **options):
    """(rows, part of all blocks that an anchor reads, for positives and for negatives)."""
    seen = []
    plain = negatives._chosen

    def counted(blocks, groups, k, counts):
        made = plain(blocks, groups, k, counts)
        bits = sum(int.from_bytes(r.anchors).bit_count() for r in made.collect())
        anchors = groups.select(F.sum(F.length("vec_ids") / 8)).collect()[0][0]
        seen.append(bits / (blocks.count() * anchors))
        return made

    negatives._chosen = counted
    try:
        return mined(frame, **options), *seen
    finally:
        negatives._chosen = plain


def test_zone_maps_leave_blocks_out(spark):
    rows = cloud(3000, 3, 2, centres=40, spread=0.01)
    found, good, bad = looked_up(spark.createDataFrame(rows, SCHEMA), block=32)
    assert found == brute(rows) and good < 0.3 and bad < 0.7


def test_of_many_copies_the_first_blocks_are_read(spark):
    rows = cloud(1000, 4, 5) + [(1000 + i, [1.0, 0.5, 0.25, 0.0], i % 3) for i in range(4000)]
    found, good, bad = looked_up(spark.createDataFrame(rows, SCHEMA), block=32)
    assert found == brute(rows) and good < 0.1 and bad < 0.2


def test_registered_query(spark, oracle, testdata):
    from fieldtally.llm import oracle as sql

    df = queries.queries()["op11_hard_negatives"](spark, testdata)
    assert compare.differences(df, oracle, sql.SQL["op11_hard_negatives"]) is None


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(200, 4, 3)
    rows += [(300, None, 1), (400, [1.0, None, 0.0, 0.0], 1), (500, [nan] * 4, 1), (600, [inf, 0.0, 0.0, 0.0], 0)]
    rows += [(700, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1), (800, [], 1), (900, [3e38] * 4, 1)]
    rows += [(1000, [0.0] * 4, 1), (1001, [0.0] * 4, 2), (1100, [1e6, 0.0, 0.0, 0.0], 1)]
    # Repeated rows, an anchor with two vectors, ties.
    rows += [rows[0]] * 2 + [rows[100], (100, rows[7][1], 0), (100, rows[7][1], 1)] + [(2000 + i, rows[3][1], i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = frame.withColumns({"block": F.lit(1), "a.b": F.lit("x"), "home": F.lit(2)})
    assert mined(extra, block=16) == brute(rows)
    assert mined(frame.limit(0)) == [] and mined(frame.where("vec_id % 100 > 0")) == []
    assert mined(frame.where("vec_id = 100 AND label = 1")) == brute([r for r in rows if r[0] == 100 and r[2] == 1])
