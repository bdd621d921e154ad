"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round links every node's larger neighbours to its smallest one, then every node's smaller
neighbours to the smallest. A minimum per node is combined map-side, written, and joined back: both
sides of the join are then shuffled for it alone, so that adaptive execution can split a node with
very many neighbours over tasks. Rounds are written to the shared folder. They end as soon as every
component is a star around its smallest node, which one grouped count tells; edges that are stars from
the start, as those of a tile of near-duplicates, take no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.shared import written


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (a > b) are stars: no node has two smaller neighbours, or one and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return nodes.agg(F.count_if((F.col("up") > 0) & (F.col("n") > 1))).collect()[0][0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for every node of an edge (a, b).

    Edges may repeat, lead either way, or join a node to itself (such a node is its own label
    unless other edges say otherwise). Without edges there is no row. The edges are worked out once.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL")
    given = written(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops, now = given.where("a = b"), given.where("a <> b")
    while not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        down = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (
            large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).union(down.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
    if loops.isEmpty():
        return labels
    alone = loops.select(F.col("a").alias("node")).join(labels, "node", "left_anti")
    return labels.union(alone.select("node", F.col("node").alias("label")))
