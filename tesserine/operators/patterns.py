"""Graph patterns as joins: scan nodes, follow relationships, gather neighbours, keep what has none.

A graph is two DataFrames, ``nodes`` (``id, label`` and any properties) and ``edges``
(``src, rel, dst`` and any properties).  Rows of a pattern hold one struct column for
each matched node or relationship.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def scan(self, alias: str, *labels: str, where: Column | None = None, **equal: object) -> DataFrame:
        """Nodes of any of ``labels`` whose properties equal ``equal``; filters reach the scans below."""
        rows = self.nodes.filter(F.col("label").isin(*labels)) if labels else self.nodes
        for name, value in equal.items():
            rows = rows.filter(F.col(name) == F.lit(value))
        if where is not None:
            rows = rows.filter(where)
        return rows.select(F.struct("*").alias(alias))

    def _links(self, rel: str | None, back: bool, alias: str | None, far: DataFrame | None, to: str) -> DataFrame:
        """``_near``, the relationship under ``alias``, and the node at its far end under ``to``."""
        near, end = ("dst", "src") if back else ("src", "dst")
        own = self.edges.filter(F.col("rel") == rel) if rel else self.edges
        kept = own.select(F.col(near).alias("_near"), F.col(end).alias("_far"), *([F.struct("*").alias(alias)] if alias else []))
        ends = self.scan(to) if far is None else far
        return kept.join(ends.withColumn("_far", F.col(f"{to}.id")), "_far").drop("_far")

    def hop(self, rows: DataFrame, start: str, rel: str | None, to: str, *labels: str, back: bool = False, optional: bool = False, edge: str | None = None, where: Column | None = None, **equal: object) -> DataFrame:
        """Each row once for every node that ``start`` reaches over ``rel`` (against its direction with ``back``)."""
        links = self._links(rel, back, edge, self.scan(to, *labels, where=where, **equal), to)
        return rows.withColumn("_near", F.col(f"{start}.id")).join(links, "_near", "left" if optional else "inner").drop("_near")

    def gather(self, rows: DataFrame, start: str, rel: str | None, value: str | Column, name: str, *labels: str, back: bool = False, **equal: object) -> DataFrame:
        """Adds ``name``: the sorted distinct values of the neighbours ``x`` over ``r``; empty if there is none.

        Neighbours are reduced to one array for each start before the join, so
        several of them never multiply rows.
        """
        value = F.col(f"x.{value}") if isinstance(value, str) else value
        lists = self._links(rel, back, "r", self.scan("x", *labels, **equal), "x").groupBy("_near").agg(F.array_sort(F.collect_set(value)).alias("_list"))
        joined = rows.withColumn("_near", F.col(f"{start}.id")).join(lists, "_near", "left").drop("_near")
        return joined.withColumn(name, F.coalesce("_list", F.array())).drop("_list")

    def tally(self, rows: DataFrame, start: str, rel: str, name: str, *labels: str, back: bool = False) -> DataFrame:
        """Adds ``name``: the number of distinct neighbours."""
        counts = self._links(rel, back, None, self.scan("x", *labels), "x").groupBy("_near").agg(F.count_distinct("x.id").alias("_n"))
        joined = rows.withColumn("_near", F.col(f"{start}.id")).join(counts, "_near", "left").drop("_near")
        return joined.withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n")

    def without(self, rows: DataFrame, start: str, rel: str, *labels: str, back: bool = False) -> DataFrame:
        """Rows whose ``start`` has no such neighbour."""
        links = self._links(rel, back, None, self.scan("x", *labels), "x").select("_near")
        return rows.withColumn("_near", F.col(f"{start}.id")).join(links, "_near", "left_anti").drop("_near")


def listed(column: str) -> Column:
    """An array of strings as one text."""
    return F.array_join(column, ", ")
