"""Connected components by alternating large-star and small-star rounds, all in DataFrame operations.

Each round keeps or shrinks the set of edges; the rounds needed grow with the logarithm of the
graph's diameter. A node with very many neighbours is never gathered in one place: minima are
partial aggregates, and they come back to the edges by broadcast: all of them if they are few, else those of
nodes of more than ``HEAVY`` edges, while the others are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, small

#: Edges of a node from which its minimum is broadcast.
HEAVY = 10_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges``: two columns of one orderable type. Returns (node, component): the smallest node reachable.

    Only nodes of an edge between two different nodes are returned; edges with a null are ignored.
    """
    a, b = edges.columns
    e = scratch.write(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        few = 2 * seen[0] <= BROADCAST_ROWS  # at most two nodes an edge
        new = scratch.write(_small_star(_large_star(e, few, scratch), few, scratch).distinct(), "edges")
        scratch.drop(e)
        e, now = new, _signature(new)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def _with_least(edges: DataFrame, least: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """``edges`` with ``m`` of their ``u``. ``least``: (u, m, n: edges of u), of few rows or not."""
    if few:
        return edges.join(F.broadcast(least.drop("n")), "u")
    least = scratch.write(least, "least")
    # at most a row for each HEAVY edges
    heavy = small(least.where(F.col("n") > HEAVY).drop("n"))
    rest = edges.join(heavy.select("u"), "u", "left_anti").join(least.where(F.col("n") <= HEAVY).drop("n"), "u")
    return edges.join(heavy, "u").unionByName(rest)


def _large_star(e: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """Every neighbour greater than a node is linked to the least of the node and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    linked = _with_least(both.where("v > u"), least, few, scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return linked if few else scratch.write(linked, "large")


def _small_star(e: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; the edge to the least one stays."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(e, least, few, scratch).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
