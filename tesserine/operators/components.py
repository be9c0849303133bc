"""Connected components of undirected links, by alternating rounds in which nodes move to their smallest neighbour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint


def components(links: DataFrame, a: str, b: str, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """``node, component`` for every node that has a link to another; the component is its smallest reachable node.

    A round looks up each node's smallest neighbour as a partial aggregate, so a
    hub's links are never gathered; rounds grow with the logarithm of the longest path.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x") != F.col("y"))
    now = cut(_ordered(pairs))
    known = None
    while True:
        after = cut(_moved(_moved(now, True), False))
        code = F.xxhash64("x", "y")
        state = tuple(after.agg(F.count("*"), F.bit_xor(code), F.sum(code % 1_000_003)).first())
        if state == known:
            break
        known, now = state, after
    return after.select(F.col("x").alias("node"), F.col("y").alias("component")).union(after.select("y", "y").distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct()


def _moved(pairs: DataFrame, large: bool) -> DataFrame:
    """Neighbours of every node, the larger ones or the smaller ones, point at its smallest neighbour instead."""
    around = pairs.union(pairs.select("y", "x")) if large else pairs
    least = around.groupBy("x").agg(F.min("y").alias("_m")).select("x", F.least("x", "_m").alias("_m"))
    told = around.join(least, "x")
    if large:
        return _ordered(told.filter("y > x").select(F.col("y").alias("x"), F.col("_m").alias("y")))
    return _ordered(told.select(F.col("y").alias("x"), F.col("_m").alias("y")).union(least))
