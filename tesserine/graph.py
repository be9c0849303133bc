"""The input tables as a typed property graph: nodes, edges, and the requirement-code-test analogue.

Requirement = customer, Code = order of that customer, Test = returned line
(``l_returnflag = 'R'``) of that order.  A supplier serves the parts it shipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: label, table, key, name, module
NODE_KINDS = (
    ("Region", "region", "r_regionkey", "r_name", None),
    ("Nation", "nation", "n_nationkey", "n_name", None),
    ("Customer", "customer", "c_custkey", "c_name", "c_mktsegment"),
    ("Supplier", "supplier", "s_suppkey", "s_name", None),
    ("Part", "part", "p_partkey", "p_name", "p_brand"),
    ("Order", "orders", "o_orderkey", "o_orderpriority", None),
)
#: relationship, table, source label, source key, target label, target key, whether pairs may repeat
EDGE_KINDS = (
    ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey", False),
    ("IN_NATION", "customer", "Customer", "c_custkey", "Nation", "c_nationkey", False),
    ("IN_NATION", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", False),
    ("PLACED_BY", "orders", "Order", "o_orderkey", "Customer", "o_custkey", False),
    ("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey", True),
    ("SUPPLIED_BY", "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey", True),
)


def node_id(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """``node_id, label, name, module`` of all labels, or of those given."""
    parts = [
        table(spark, sf_dir, source).select(
            node_id(label, key).alias("node_id"), F.lit(label).alias("label"), F.col(name).alias("name"), (F.col(module) if module else F.lit(None).cast("string")).alias("module")
        )
        for label, source, key, name, module in NODE_KINDS
        if not labels or label in labels
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """``src, rel, dst``, each edge once; repeated foreign-key pairs are deduplicated on their integer keys before ids are built."""
    parts = []
    for rel, source, a, a_key, b, b_key, repeats in EDGE_KINDS:
        if not kinds or rel in kinds:
            pairs = table(spark, sf_dir, source).select(a_key, b_key)
            pairs = pairs.distinct() if repeats else pairs
            parts.append(pairs.select(node_id(a, a_key).alias("src"), F.lit(rel).alias("rel"), node_id(b, b_key).alias("dst")))
    return reduce(DataFrame.unionByName, parts)


def keys_of(ids: list[str], label: str) -> list[int]:
    """The keys of those ids that belong to ``label``."""
    return [int(x.split(":", 1)[1]) for x in ids if x.startswith(f"{label}:")]


def nodes_at(spark: SparkSession, sf_dir: str, ids: list[str]) -> DataFrame:
    """``nodes`` of these ids: only tables whose label occurs are read, with the keys pushed into their scans."""
    parts = [
        table(spark, sf_dir, source).filter(F.col(key).isin(keys_of(ids, label)))
        .select(node_id(label, key).alias("node_id"), F.lit(label).alias("label"), F.col(name).alias("name"), (F.col(module) if module else F.lit(None).cast("string")).alias("module"))
        for label, source, key, name, module in NODE_KINDS
        if keys_of(ids, label)
    ]
    return reduce(DataFrame.unionByName, parts)


def edges_at(spark: SparkSession, sf_dir: str, ids: list[str], back: bool = False) -> DataFrame:
    """``edges`` that leave (with ``back``: reach) these ids; the keys reach the Parquet scans, and only what they find is deduplicated."""
    parts = []
    for rel, source, a, a_key, b, b_key, repeats in EDGE_KINDS:
        keys = keys_of(ids, b if back else a)
        if keys:
            pairs = table(spark, sf_dir, source).filter(F.col(b_key if back else a_key).isin(keys)).select(a_key, b_key)
            pairs = pairs.distinct() if repeats else pairs
            parts.append(pairs.select(node_id(a, a_key).alias("src"), F.lit(rel).alias("rel"), node_id(b, b_key).alias("dst")))
    return reduce(DataFrame.unionByName, parts)


def both_ways_at(spark: SparkSession, sf_dir: str, ids: list[str]) -> DataFrame:
    """``both_ways`` of these ids."""
    out = edges_at(spark, sf_dir, ids).select(F.col("src").alias("node"), "rel", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges_at(spark, sf_dir, ids, back=True).select(F.col("dst").alias("node"), "rel", F.col("src").alias("other"), F.lit("in").alias("direction")))


def pairs(spark: SparkSession, sf_dir: str, kind: tuple) -> DataFrame:
    """``a, b``: an edge kind as its distinct integer keys."""
    _, source, _, a_key, _, b_key, repeats = kind
    out = table(spark, sf_dir, source).select(F.col(a_key).cast("long").alias("a"), F.col(b_key).cast("long").alias("b"))
    return out.distinct() if repeats else out


def edge_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rel, n``: the number of edges of each kind; a table whose pairs may repeat is read once for all kinds it holds, by grouping sets of its integer keys."""
    parts = []
    for source in dict.fromkeys(k[1] for k in EDGE_KINDS):
        kinds = [k for k in EDGE_KINDS if k[1] == source]
        rows = table(spark, sf_dir, source)
        if any(k[6] for k in kinds):
            keys = list(dict.fromkeys(c for k in kinds for c in (k[3], k[5])))
            sets = rows.groupingSets([(k[3], k[5]) for k in kinds], *keys).agg(F.grouping_id().alias("_g"))
            names = {sum(1 << i for i, c in enumerate(reversed(keys)) if c not in (k[3], k[5])): k[0] for k in kinds}  # a bit for each key that a set leaves out
            parts.append(sets.select(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("_g").cast("int")).alias("rel")))
        else:
            parts += [rows.select(F.lit(k[0]).alias("rel")) for k in kinds]
    return reduce(DataFrame.unionByName, parts).groupBy("rel").agg(F.count("*").alias("n"))


def both_ways(links: DataFrame) -> DataFrame:
    """``node, rel, other, direction``: every edge seen from either end; a self-loop counts at both."""
    out = links.select(F.col("src").alias("node"), "rel", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(links.select(F.col("dst").alias("node"), "rel", F.col("src").alias("other"), F.lit("in").alias("direction")))


#: The same projection as DuckDB common table expressions, for oracles.
SQL_NODES = "nodes as (" + " union all ".join(
    f"select '{label}:' || {key} as node_id, '{label}' as label, {name} as name, {module or 'null::varchar'} as module from {source}" for label, source, key, name, module in NODE_KINDS
) + ")"
SQL_EDGES = "edges as (" + " union all ".join(
    f"select {'distinct ' if repeats else ''}'{a}:' || {a_key} as src, '{rel}' as rel, '{b}:' || {b_key} as dst from {source}" for rel, source, a, a_key, b, b_key, repeats in EDGE_KINDS
) + ")"
SQL_GRAPH = f"with {SQL_NODES}, {SQL_EDGES} "
SQL_TRACE = """code as (select distinct o_custkey as c, o_orderkey as o from orders),
tests as (select distinct l_orderkey as o from lineitem where l_returnflag = 'R'),
matrix as (select c_custkey, c_mktsegment, count(code.o) as n_code, count(tests.o) as n_tests
 from customer left join code on c = c_custkey left join tests on tests.o = code.o group by all)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, c_mktsegment, n_code, n_tests`` for every requirement.

    The tested orders are one narrow semi-join side; lines aggregate on the order
    key, so no list of a requirement's lines is ever built.
    """
    tests = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_t", F.lit(1))
    code = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(tests, "o_orderkey", "left")
    per = code.groupBy("o_custkey").agg(F.count("*").alias("n_code"), F.count("_t").alias("n_tests"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    zero = {"n_code": 0, "n_tests": 0}
    return customers.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").fillna(zero)
