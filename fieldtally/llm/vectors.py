"""Nearest neighbours of a query set by a block matrix join.

Vectors are cut into blocks. Each block of queries meets each block of candidates in one task: the
blocks that a query block needs are sent by key, so a task holds two blocks and no more. In a tile,
vectors are quantised to int8; one matrix product of the codes gives all inner products with a bound
on each one's error, computed from the parts that quantisation lost. Pairs whose upper bound stays
below the k-th best found so far for their query are dropped; the rest are computed in double
precision and kept in a heap per query. Heaps of tiles are merged, at most k rows of a query and
tile. Pruning by bounds loses nothing: the result is exact.

Nearness is the inner product, largest first, ties to the smaller id. It is summed in the order of
the components, in double precision, so equal vectors get equal scores.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component take
no part, nor do rows without id or vectors of another dimension than the most frequent one (the
smaller, if two are equally frequent); a query is not its own candidate (rows with its id are not);
repeated rows are repeated candidates; a query repeated under one id with several vectors is one
query per distinct vector; fewer than k candidates are all returned; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.shared import ship

#: Candidates and queries of a block.
CANDIDATES = 8192
QUERIES = 4096
#: Candidates of a tile that are multiplied at a time.
STRIP = 1024
#: Components whose products of int8 codes a float32 sum holds exactly.
EXACT = (1 << 24) // (127 * 127)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that can take part, as doubles."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["n"] if size else 0))


def _quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the vector, length of what the codes lose), by row."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1.0
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
    lost = v - codes * scale[:, None]
    return codes, scale, np.linalg.norm(v, axis=1), np.linalg.norm(lost, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes, exactly: sums of `EXACT` products fit a float32."""
    total = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        total += a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T
    return total


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def tile(q_ids, q, c_ids, c, k: int) -> Iterator[tuple[int, float, int]]:
    """(query row, score, candidate id): the k nearest candidates in this tile of each query."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
    worst = np.full(len(q), -np.inf)  # score to reach, once a heap is full
    q_codes, q_scale, q_norm, q_lost = _quantised(q)
    for at in range(0, len(c), STRIP):
        strip, ids = c[at : at + STRIP], c_ids[at : at + STRIP]
        codes, scale, norm, lost = _quantised(strip)
        near = _product(q_codes, codes) * q_scale[:, None] * scale
        # x.y - x'.y' = (x - x').y + x'.(y - y'), and |x'| <= |x| + |x - x'|
        bound = q_lost[:, None] * norm + (q_norm + q_lost)[:, None] * lost
        bound = bound * (1 + 1e-9) + 1e-12 * (q_norm[:, None] * norm)
        # The k-th best lower bound of a strip is reached by k candidates; so is the heap's worst.
        same = q_ids[:, None] == ids
        low = np.where(same, -np.inf, near - bound)
        floor = worst
        if low.shape[1] > k:
            floor = np.maximum(worst, np.partition(low, -k, axis=1)[:, -k])
        rows, columns = np.nonzero((near + bound >= floor[:, None]) & ~same)
        for a in range(0, len(rows), 1 << 18):
            r, n = rows[a : a + (1 << 18)], columns[a : a + (1 << 18)]
            for i, score, name in zip(r.tolist(), _exact(q[r], strip[n]).tolist(), ids[n].tolist()):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -name))
                elif (score, -name) > heap[0]:
                    heapq.heapreplace(heap, (score, -name))
        worst = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    for i, heap in enumerate(heaps):
        for score, name in heap:
            yield i, score, -name


def _up_to(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each row for which is_query holds.

    is_query: a condition on vec_id. Blocks hold about `candidates` and `queries` rows; each query is
    sent to every candidate block and each candidate to every query block, so what is shuffled grows
    with rows x blocks, never with pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector)
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()[0]
    across, down = -(-counts["n"] // candidates) or 1, -(-counts["q"] // queries) or 1
    # Equal ids and equal vectors are spread as well: nothing needs them together.
    spread = F.xxhash64("vec_id", F.monotonically_increasing_id())
    own = rows.withColumn("spread", spread)
    as_candidate = own.select(
        F.pmod("spread", F.lit(across)).alias("column"),
        _up_to(down).alias("row"),
        "vec_id", "v", F.lit(0).cast("long").alias("tag"), F.lit(False).alias("is_query"),
    )
    asked = rows.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("spread", F.xxhash64("vec_id", "v"))
    as_query = asked.select(
        _up_to(across).alias("column"),
        F.pmod("spread", F.lit(down)).alias("row"),
        "vec_id", "v", F.xxhash64("v").alias("tag"), F.lit(True).alias("is_query"),
    )

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "tag", "vec_id", "score"]
        own = part["is_query"].to_numpy(dtype=bool)
        if own.all() or not own.any():
            return pd.DataFrame([], columns=names)
        v = np.array(part["v"].tolist(), dtype=np.float64)
        ids = part["vec_id"].to_numpy()
        q_ids, q = ids[own], v[own]
        tags = part["tag"].to_numpy()[own]
        found = tile(q_ids, q, ids[~own], v[~own], k)
        made = [(q_ids[i], tags[i], name, score) for i, score, name in found]
        return pd.DataFrame(made, columns=names)

    found = (
        as_candidate.unionByName(as_query)
        .groupBy("column", "row")
        .applyInPandas(multiply, "query_id long, tag long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
