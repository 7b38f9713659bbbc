"""Connected components of an edge table by alternating large-star and small-star rounds, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import checked_broadcast, discard, materialize

FEW = 400_000  # rows of a look-up that is broadcast


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the least node of its component.

    Each round writes the edges to the shared folder, so lineage stays short and lost executors cost one round. Neighbour
    lists are never gathered: a round needs each node's least neighbour, combined before it is shuffled, and joins with those nodes
    alone that move something; these are stored first, so that a node with very many edges can be split among tasks (or needs no
    shuffle). Ends when the edges stay the same.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        # large star: neighbours above a node go to its least neighbour, or stay where the node itself is the least
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = materialize(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.col("a").alias("u"), "m"), "moves")
        large = materialize(edges.join(checked_broadcast(moves, FEW), F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "large")
        # small star: a node and its lesser neighbours go to the least of them
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("u"), "m", "n"), "low")
        several = checked_broadcast(low.where("n > 1").select("u", "m"), FEW)
        small = large.join(several, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, edges = edges, materialize(small.where("a <> b").distinct(), "edges")
        discard(before, moves, large, low)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
