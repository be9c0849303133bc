"""Graph statistics: counts, degrees, fill rates, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import SQL_GRAPH, both_ways, edge_tallies, edges, nodes
from ..registry import register
from ..tables import table


@register("label_counts", SQL_GRAPH + "select label, count(*) as n from nodes group by 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@register("edge_counts", SQL_GRAPH + "select rel, count(*) as n from edges group by 1")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_tallies(spark, sf_dir)


@register(
    "module_label_pivot",
    SQL_GRAPH + """select module, count(*) filter (label = 'Customer') as "Customer", count(*) filter (label = 'Part') as "Part" from nodes where module is not null group by 1""",
)
def module_label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = nodes(spark, sf_dir, "Customer", "Part").filter(F.col("module").isNotNull())
    return owned.groupBy("module").pivot("label", ["Customer", "Part"]).count().fillna(0)


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, degree`` of the nodes that have an edge; partial sums make a hub one row a task."""
    return both_ways(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))


_DEGREES = SQL_GRAPH + ", d as (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by 1) "


@register("degree_top25", _DEGREES + "select node, degree from d order by degree desc, node limit 25")
def degree_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(spark, sf_dir).orderBy(F.desc("degree"), "node").limit(25)


@register(
    "degree_stats",
    _DEGREES + "select min(degree) as least, max(degree) as most, round(avg(degree), 6) as mean, quantile_cont(degree, 0.5) as median, round(quantile_cont(degree, 0.95), 6) as p95 from d",
)
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated percentiles, from the counts of equal degrees (few) instead of one row per node."""
    counted = degrees(spark, sf_dir).groupBy("degree").agg(F.count("*").alias("n"))
    return counted.agg(
        F.min("degree").alias("least"), F.max("degree").alias("most"), F.round(F.sum(F.col("degree") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        F.percentile("degree", F.lit(0.5), F.col("n")).alias("median"), F.round(F.percentile("degree", F.lit(0.95), F.col("n")), 6).alias("p95"),
    )


@register(
    "property_fill",
    SQL_GRAPH + """select label, property, count(*) as total, count(value) as filled, round(100.0 * count(value) / count(*), 1) as fill_rate
    from (select label, 'name' as property, name as value from nodes union all select label, 'module', module from nodes) group by all""",
)
def property_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("total"), F.count("name").alias("name"), F.count("module").alias("module"))
    long = wide.unpivot(["label", "total"], ["name", "module"], "property", "filled")
    return long.select("label", "property", "total", "filled", F.round(100.0 * F.col("filled") / F.col("total"), 1).alias("fill_rate"))


@register("density", SQL_GRAPH + ", c as (select (select count(*) from nodes) as n, (select count(*) from edges) as e) select n as n_nodes, e as n_edges, round(e / (n * (n - 1.0)), 12) as density from c")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = nodes(spark, sf_dir).select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges(spark, sf_dir).select(F.lit(0), F.lit(1)))
    total = both.agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"))
    return total.withColumn("density", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1.0)), 12))


@register(
    "connectivity_share",
    _DEGREES + "select label, count(*) as n, count(d.node) as connected, round(count(d.node) / count(*), 4) as share from nodes left join d on d.node = node_id group by 1",
)
def connectivity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of nodes with an edge, by label; zero-degree nodes count."""
    touched = both_ways(edges(spark, sf_dir)).select(F.col("node").alias("node_id")).distinct().withColumn("_c", F.lit(1))
    joined = nodes(spark, sf_dir).select("node_id", "label").join(touched, "node_id", "left")
    return joined.groupBy("label").agg(F.count("*").alias("n"), F.count("_c").alias("connected"), F.round(F.count("_c") / F.count("*"), 4).alias("share"))


@register("distribution_status", "select o_orderstatus as status, count(*) as n from orders where o_orderstatus is not null group by 1")
def distribution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isNotNull()).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


# Names of the order status codes.
STATUS_NAMES = {"O": "open", "F": "finished", "P": "partial"}


@register(
    "distribution_value_map",
    "select case o_orderstatus when 'O' then 'open' when 'F' then 'finished' when 'P' then 'partial' else 'N/A' end as status, count(*) as n from orders group by 1",
)
def distribution_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in STATUS_NAMES.items() for x in pair))
    counted = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counted.groupBy(F.coalesce(F.try_element_at(names, "o_orderstatus"), F.lit("N/A")).alias("status")).agg(F.sum("n").alias("n"))


@register(
    "module_list_conditional",
    """select upper(coalesce(c_mktsegment, 'unknown')) as module, count(*) as n, count(case when c_acctbal < 0 then 1 end) as n_debt, count(case when c_acctbal > 5000 then 1 end) as n_rich
    from customer group by 1""",
)
def module_list_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.upper(F.coalesce("c_mktsegment", F.lit("unknown"))).alias("module")
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy(module).agg(F.count("*").alias("n"), F.count_if(balance < 0).alias("n_debt"), F.count_if(balance > 5000).alias("n_rich"))


@register(
    "module_details",
    """select 'Customer' as kind, c_mktsegment as module, count(*) as n from customer group by 2 union all select 'Part', p_brand, count(*) from part group by 2
    union all select 'Supplier', n_name, count(*) from supplier join nation on n_nationkey = s_nationkey group by 2""",
)
def module_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, df, c: df.groupBy(F.col(c).alias("module")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "module", "n")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kinds = [of("Customer", table(spark, sf_dir, "customer"), "c_mktsegment"), of("Part", table(spark, sf_dir, "part"), "p_brand"), of("Supplier", suppliers, "n_name")]
    return reduce(DataFrame.unionByName, kinds)


@register("catalog_counts", "select c_mktsegment as module, (select count(*) from orders join customer x on x.c_custkey = o_custkey where x.c_mktsegment = c.c_mktsegment) as n from (select distinct c_mktsegment from customer) c")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every module of the catalogue with its count, absent ones 0."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("module"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return customers.join(counts, "c_custkey", "left").groupBy("module").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
