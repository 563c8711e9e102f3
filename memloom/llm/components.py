"""Connected components of an edge table by randomised contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``; component is its smallest node.

    In each round every node moves to the neighbour (or itself) with the smallest pseudo-random rank,
    so stars vanish at once and paths shrink geometrically. Rounds are written tables.
    Self loops, repeated edges and nulls are allowed; null ends are ignored. Of the tables it writes only the one that the
    result reads stays; ``edges`` isn't read after the call.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = stored = materialize(edges.distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    edges, salt = edges.where("a <> b"), 0
    while not edges.isEmpty():
        salt += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)), F.col(c).alias("id"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        moves = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("old"), F.least(F.col("m"), rank("a"))["id"].alias("new"))
        moves = materialize(moves, "moves")
        before = nodes
        nodes = nodes.join(moves, nodes.root == moves.old, "left").select("node", F.coalesce("new", "root").alias("root"))
        nodes = materialize(nodes, "nodes")
        to_a, to_b = moves.toDF("a", "x"), moves.toDF("b", "y")
        edges = edges.join(to_a, "a").select("x", "b").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = materialize(edges.distinct(), "edges")
        discard(stored, moves, *([before] if salt > 1 else []))  # the first nodes are read from the first edges
        stored = edges
    if salt:
        discard(stored)
    lowest = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(lowest, "root").select("node", "component")
