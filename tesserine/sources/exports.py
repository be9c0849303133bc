"""Exports: a graph or a part of it as JSON lines, tables in pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint
from ..operators.patterns import Graph
from ..operators.ranges import running


def graph_lines(g: Graph, node_props: tuple[str, ...] = (), edge_props: tuple[str, ...] = ()) -> DataFrame:
    """``line``: one JSON object for each node and each edge, properties without a value left out."""
    node = F.to_json(F.struct(F.lit("node").alias("type"), "id", "label", *node_props))
    edge = F.to_json(F.struct(F.lit("edge").alias("type"), "src", "rel", "dst", *edge_props))
    return g.nodes.select(node.alias("line")).unionByName(g.edges.select(edge.alias("line")))


def subgraph(g: Graph, starts: DataFrame, depth: int = 1, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> Graph:
    """The nodes within ``depth`` relationships of ``starts`` (``id``), whatever their direction, and all relationships among them; ends that are no nodes are left out."""
    links = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = g.nodes.select("id")
    seen = front = cut(starts.select("id").distinct().join(known, "id", "left_semi"))
    for _ in range(depth):
        step = both.join(front.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").join(known, "id", "left_semi"))
        seen = seen.unionByName(front)
    ends = lambda rows, end: rows.join(seen.withColumnRenamed("id", end), end, "left_semi")
    return Graph(g.nodes.join(seen, "id", "left_semi"), ends(ends(g.edges, "src"), "dst"))


def paged(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Adds ``page`` and ``place``: rows in ``order``, ``size`` to a page, both from 0; numbered by ranges, in no single task."""
    placed = running(rows, [], order, None, "_ahead")
    return placed.withColumn("page", F.floor(F.col("_ahead") / size)).withColumn("place", F.col("_ahead") % size).drop("_ahead")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files with a line for each row, written by the tasks that hold them."""
    lines.select("line").write.mode("overwrite").text(path)


def write_pages(rows: DataFrame, path: str, order: list[Column], size: int, pages_per_folder: int = 1000) -> None:
    """JSON files of pages in order, in folders of ``pages_per_folder`` pages."""
    out = paged(rows, order, size).withColumn("folder", F.floor(F.col("page") / pages_per_folder))
    out.repartitionByRange("folder", "page", "place").sortWithinPartitions("folder", "page", "place").write.mode("overwrite").partitionBy("folder").json(path)
