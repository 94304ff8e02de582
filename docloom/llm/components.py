"""Connected components of a graph given as a frame of edges, by alternating star steps.

A large step hangs every larger neighbour of a node on the node's smallest neighbour, a small
step the smaller ones; the two converge in a number of rounds logarithmic in the size of a
component, chains included. Both are partial aggregations and equi-joins: a hub's edges can
be split over tasks, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both).select("u", F.least("u", "m").alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _least(down)
    moved = down.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of one orderable type -> (node, root) for every node that has an edge, root
    being the smallest node of its component. Loops and repeated edges do no harm."""
    e = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = _mark(e)
    while seen[0]:
        after = materialize(_small(_large(e)), "edges")
        now = _mark(after)
        discard(e)
        e = after
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
