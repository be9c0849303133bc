"""Graph traversal operators over edge tables ``src, dst``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint


def reach(start: DataFrame, edges: DataFrame, most: int, least: int = 1, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """``start, node, depth``: what each start reaches in ``least`` to ``most`` hops, at its smallest such depth; never the start itself.

    ``start`` has a column ``node``.  A breadth-first loop of joins: each round
    expands only pairs that are new, so cycles end.  ``cut`` writes each round to the checkpoint folder, so plans stay short.
    """
    links = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct())  # read once, not in every round
    front = start.select(F.col("node").alias("start"), "node").distinct()
    seen = None
    for depth in range(1, most + 1):
        step = front.join(links, "node").select("start", F.col("_next").alias("node")).filter(F.col("node") != F.col("start")).distinct()
        fresh = step if seen is None else step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        fresh = cut(fresh.withColumn("depth", F.lit(depth)))
        seen = fresh if seen is None else seen.unionByName(fresh)
        front = fresh.select("start", "node")
    return seen.filter(F.col("depth") >= least)


def shortest_paths(start: DataFrame, targets: DataFrame, edges: DataFrame, most: int, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """``start, node, length, path``: one shortest path from each start to each target it reaches, the least of equal ones.

    Edges are followed in both directions.  The frontier keeps one path for each
    (start, node), the least in order of its ids, so ties are settled the same way
    on every run and the frontier never grows with the number of paths.
    """
    links = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).union(edges.select("dst", "src")).distinct())
    front = start.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    seen = front.select("start", "node", "path", F.lit(0).alias("length"))
    for length in range(1, most + 1):
        step = front.join(links, "node").select("start", F.col("_next").alias("node"), F.concat("path", F.array("_next")).alias("path"))
        fresh = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
        fresh = cut(fresh.withColumn("length", F.lit(length)))
        seen = seen.unionByName(fresh)
        front = fresh.select("start", "node", "path")
    return seen.join(targets.select("node").distinct(), "node", "left_semi").select("start", "node", "length", "path")


def levels(nodes: DataFrame, edges: DataFrame, most: int, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """Topological levels by peeling: ``node, level``; members of cycles and what hangs on them get a null level.

    Each round removes the nodes that nothing left points at; edges of removed
    nodes go with them, so rounds shrink.
    """
    left, links = nodes.select("node").distinct(), edges.select("src", "dst").filter("src <> dst").distinct()
    done = None
    for level in range(most):
        free = cut(left.join(links.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        done = free if done is None else done.unionByName(free)
        left = left.join(free.select("node"), "node", "left_anti")
        links = cut(links.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        left = cut(left)
        if left.isEmpty():
            return done
    return done.unionByName(left.withColumn("level", F.lit(None).cast("int")))
