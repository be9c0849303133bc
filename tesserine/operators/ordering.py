"""Orders that respect dependencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint
from .ranges import running


def suggest_order(functions: DataFrame, needs: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """``node, position, level``: the given functions (``node, place``) with what each needs before it.

    Only needs (``node, need``) inside the given set count.  The order is that of a
    queue that starts with the functions without needs, by ``place``, and takes up each
    other one when the last of its needs has been served: by level, then by the position of
    the last need, then by place.  Functions on cycles, and those behind them,
    come last by place, with a null level.

    A round serves a whole level; positions inside it come from a sort dealt by
    ranges, so no level is numbered in one task.
    """
    given = cut(functions.select("node", "place").filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("place").alias("place")))
    links = cut(needs.select("node", "need").distinct().join(given.select("node"), "node", "left_semi").join(given.select(F.col("node").alias("need")), "need", "left_semi"))
    left, done, served, level = given, None, 0, 0
    ready = given.join(links.select("node"), "node", "left_anti").withColumn("last", F.lit(-1).cast("long"))
    while True:
        ready = cut(ready.select("node", "place", "last"))
        n = ready.count()
        if not n:
            break
        placed = running(ready, [], [F.asc("last"), F.asc("place"), F.asc("node")], None, "ahead")
        placed = cut(placed.select("node", (F.col("ahead") + served).alias("position"), F.lit(level).alias("level")))
        done = placed if done is None else done.unionByName(placed)
        served, level = served + n, level + 1
        left = cut(left.join(placed.select("node"), "node", "left_anti"))
        waiting = links.join(done.select(F.col("node").alias("need"), "position"), "need", "left").groupBy("node").agg(F.bool_and(F.col("position").isNotNull()).alias("_free"), F.max("position").alias("last"))
        ready = left.join(waiting.filter("_free").select("node", "last"), "node")
    rest = running(left, [], [F.asc("place"), F.asc("node")], None, "ahead").select("node", (F.col("ahead") + served).alias("position"), F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.unionByName(rest)
