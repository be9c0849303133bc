"""Graph builders from a specification: project, deduplicate, merge nodes, join, merge edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import Graph


@dataclass(frozen=True)
class Node:
    """Rows of ``source`` (where ``where``: a column and its value) are nodes of ``label`` with ``key`` and ``props``; of several values that of the row with the greatest ``newest`` stays."""

    label: str
    source: str
    key: str
    props: tuple[str, ...] = ()
    where: tuple[str, str] | None = None
    newest: str | None = None


@dataclass(frozen=True)
class Edge:
    """Rows of ``source`` link ``src`` to ``dst``, each a label and the column of its key; an array column links to each of its elements."""

    rel: str
    source: str
    src: tuple[str, str]
    dst: tuple[str, str]
    props: tuple[str, ...] = ()
    where: tuple[str, str] | None = None


@dataclass(frozen=True)
class Spec:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...] = ()


def _chosen(sources: dict[str, DataFrame], rule: Node | Edge) -> DataFrame:
    rows = sources[rule.source]
    return rows if rule.where is None else rows.filter(F.col(rule.where[0]) == rule.where[1])


def build(spec: Spec, sources: dict[str, DataFrame]) -> Graph:
    """``nodes`` (``id, label, key, props``) and ``edges`` (``src, rel, dst, props``) of a specification.

    A node is merged from all rows with its label and key: a property has the
    newest non-null value (the greatest of equally new ones) of the last rule that gives one.  Rows without key are no
    nodes.  An edge counts once, and only if both its ends are nodes.  Both merges
    are partial aggregates, so a key that most rows name costs one row a task.
    """
    by_label: dict[str, list[Node]] = {}
    for rule in spec.nodes:
        by_label.setdefault(rule.label, []).append(rule)
    nodes = []
    for label, rules in by_label.items():
        props = list(dict.fromkeys(p for r in rules for p in r.props))
        parts = []
        for k, r in enumerate(rules):
            ranked = [F.when(F.col(p).isNotNull(), F.struct(F.lit(k).alias("k"), (F.col(r.newest) if r.newest else F.lit(None)).cast("timestamp").alias("t"), F.col(p).cast("string").alias("v"))) if p in r.props else F.lit(None).cast("struct<k:int,t:timestamp,v:string>") for p in props]
            parts.append(_chosen(sources, r).select(F.col(r.key).cast("string").alias("_key"), *(c.alias(f"_{p}") for c, p in zip(ranked, props, strict=True))).filter("_key is not null"))
        merged = reduce(DataFrame.unionByName, parts).groupBy("_key").agg(*([F.max(f"_{p}").alias(f"_{p}") for p in props] or [F.lit(1).alias("_")]))
        values = F.map_filter(F.create_map(*(x for p in props for x in (F.lit(p), F.col(f"_{p}.v")))), lambda _, v: v.isNotNull()) if props else F.create_map().cast("map<string,string>")
        nodes.append(merged.select(F.concat(F.lit(f"{label}:"), "_key").alias("id"), F.lit(label).alias("label"), F.col("_key").alias("key"), values.alias("props")))
    all_nodes = reduce(DataFrame.unionByName, nodes)

    edges = []
    for r in spec.edges:
        rows = _chosen(sources, r)
        far = F.col(r.dst[1])
        if rows.schema[r.dst[1]].dataType.typeName() == "array":
            far = F.explode(far)
        flat = rows.select(F.col(r.src[1]).cast("string").alias("_a"), far.alias("_b"), *r.props).filter("_a is not null and _b is not null")
        ends = flat.select(F.concat(F.lit(f"{r.src[0]}:"), "_a").alias("src"), F.lit(r.rel).alias("rel"), F.concat(F.lit(f"{r.dst[0]}:"), F.col("_b").cast("string")).alias("dst"), *(F.col(p).cast("string").alias(p) for p in r.props))
        merged = ends.groupBy("src", "rel", "dst").agg(*([F.max(p).alias(p) for p in r.props] or [F.lit(1).alias("_")]))
        values = F.map_filter(F.create_map(*(x for p in r.props for x in (F.lit(p), F.col(p)))), lambda _, v: v.isNotNull()) if r.props else F.create_map().cast("map<string,string>")
        edges.append(merged.select("src", "rel", "dst", values.alias("props")))
    ids = all_nodes.select("id")
    known = lambda rows, end: rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
    linked = known(known(reduce(DataFrame.unionByName, edges), "src"), "dst") if edges else all_nodes.select(F.col("id").alias("src"), F.lit("").alias("rel"), F.col("id").alias("dst"), "props").limit(0)
    return Graph(all_nodes, linked.select("src", "rel", "dst", "props"))
