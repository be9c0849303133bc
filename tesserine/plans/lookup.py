"""Node lookups, keyword searches and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import SQL_GRAPH, nodes, nodes_at
from ..registry import register
from ..tables import table

#: Base score of a keyword hit by label.
LABEL_SCORES = {"Customer": 1.0, "Part": 0.9, "Supplier": 0.8, "Nation": 0.7, "Region": 0.6}


@register("node_lookup", SQL_GRAPH + "select * from nodes where node_id in ('Customer:7', 'Part:3', 'Order:1', 'Nation:4')")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookup by any id: the label prunes tables, the key is pushed into each scan."""
    return nodes_at(spark, sf_dir, ["Customer:7", "Part:3", "Order:1", "Nation:4"])


@register(
    "node_search_keyword",
    "select p_partkey, p_name, p_brand from part where contains(lower(p_name), 'a') and p_brand = 'Brand#13' order by p_partkey limit 50",
)
def node_search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").filter(F.lower("p_name").contains("a") & (F.col("p_brand") == "Brand#13"))
    return found.select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").limit(50)


@register("node_search_filters_nulltolerant", SQL_GRAPH + "select node_id, label, module from nodes where label in ('Supplier', 'Customer') and (module is null or module = 'BUILDING')")
def node_search_filters_nulltolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that rows without the property pass."""
    module = F.col("module")
    return nodes(spark, sf_dir, "Supplier", "Customer").filter(module.isNull() | (module == "BUILDING")).select("node_id", "label", "module")


@register("node_search_filters_strict", SQL_GRAPH + "select node_id, label, module from nodes where label in ('Supplier', 'Customer') and module = 'BUILDING'")
def node_search_filters_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict twin: rows without the property don't pass."""
    return nodes(spark, sf_dir, "Supplier", "Customer").filter(F.col("module") == "BUILDING").select("node_id", "label", "module")


def tier(name: Column, term: str) -> Column:
    """0 for an equal name, 1 for a prefix, 2 for a substring."""
    low = F.lower(name)
    return F.when(low == term, 0).when(low.startswith(term), 1).otherwise(2)


@register(
    "fuzzy_find_tiered",
    SQL_GRAPH + """, hits as (select *, case label when 'Region' then 0 when 'Nation' then 1 else 2 end as rank,
    case when lower(name) = 'asia' then 0 when starts_with(lower(name), 'asia') then 1 else 2 end as tier from nodes where label in ('Region', 'Nation', 'Customer') and contains(lower(name), 'asia'))
    select node_id, label, name, tier from hits where rank = (select min(rank) from hits) order by tier, node_id limit 25""",
)
def fuzzy_find_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contains, exact first, then prefix; the first label with hits wins.

    The winning rank is the least of a bounded top-25 of each label, so no window
    ever sees all hits.
    """
    ranks = {"Region": 0, "Nation": 1, "Customer": 2}
    found = nodes(spark, sf_dir, *ranks).filter(F.lower("name").contains("asia")).withColumn("tier", tier(F.col("name"), "asia"))
    rank = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    best = Window.partitionBy("label").orderBy("tier", "node_id")
    few = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= 25).withColumn("_rank", F.element_at(rank, F.col("label")))
    first = few.agg(F.min("_rank").alias("_rank"))
    return few.join(F.broadcast(first), "_rank").orderBy("tier", "node_id").limit(25).select("node_id", "label", "name", "tier")


@register(
    "fulltext_union",
    SQL_GRAPH + "select node_id, name from nodes where label = 'Customer' and contains(lower(name), '1') union select node_id, name from nodes where label in ('Supplier', 'Customer') and contains(lower(name), '0001')",
)
def fulltext_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION over labels: distinct rows."""
    hit = lambda df, t: df.filter(F.lower("name").contains(t)).select("node_id", "name")
    return hit(nodes(spark, sf_dir, "Customer"), "1").union(hit(nodes(spark, sf_dir, "Supplier", "Customer"), "0001")).distinct()


@register(
    "entity_lookup",
    SQL_GRAPH + """, e as (select unnest(['asia', 'brazil', 'customer#000000001', 'china']) as entity)
    select entity, node_id, label, 2.5 as score, true as must_include from (select *, row_number() over (partition by entity order by node_id) as r from nodes join e on lower(name) = entity) where r <= 5""",
)
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive equality with named entities, at most five nodes for each, always included."""
    entities = spark.range(1).select(F.explode(F.array(*map(F.lit, ("asia", "brazil", "customer#000000001", "china")))).alias("entity"))
    found = nodes(spark, sf_dir).withColumn("entity", F.lower("name")).join(F.broadcast(entities), "entity")
    few = found.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy("node_id"))).filter(F.col("_r") <= 5)
    return few.select("entity", "node_id", "label", F.lit(2.5).alias("score"), F.lit(True).alias("must_include"))


@register(
    "unified_keyword_search",
    SQL_GRAPH + """select node_id, label, name, score from (select *, case label when 'Customer' then 1.0 when 'Part' then 0.9 when 'Supplier' then 0.8 when 'Nation' then 0.7 when 'Region' then 0.6 end as score,
    row_number() over (partition by label order by node_id) as r from nodes where label <> 'Order' and contains(lower(name), 'an')) where r <= 10""",
)
def unified_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every label, at most ten each, scored by the label."""
    scores = F.create_map(*(F.lit(x) for pair in LABEL_SCORES.items() for x in pair))
    found = nodes(spark, sf_dir, *LABEL_SCORES).filter(F.lower("name").contains("an"))
    few = found.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("node_id"))).filter(F.col("_r") <= 10)
    return few.select("node_id", "label", "name", F.element_at(scores, F.col("label")).alias("score"))


@register("range_mask", "select o_orderkey, o_totalprice from orders where o_orderstatus in ('O', 'P') and o_totalprice between 1000 and 50000 and o_orderdate is not null")
def range_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter(F.col("o_orderstatus").isin("O", "P") & F.col("o_totalprice").between(1000, 50000) & F.col("o_orderdate").isNotNull()).select("o_orderkey", "o_totalprice")


@register("module_prefix", "select split_part(p_brand, '#', 1) as prefix, count(*) as n from part group by 1")
def module_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.regexp_extract("p_brand", "^([^#]*)", 1).alias("prefix")).agg(F.count("*").alias("n"))


@register("paginate", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@register("newest_first", "select o_orderkey, o_orderdate from orders where o_orderpriority = '1-URGENT' order by o_orderdate desc, o_orderkey limit 30")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_orderdate")
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30)


@register("union_priority", "select * from (select c_custkey as k, 'rich' as why from customer where c_acctbal > 5000 union all select c_custkey, 'building' from customer where c_mktsegment = 'BUILDING' and not c_acctbal > 5000)")
def union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second list adds only ids that the first doesn't have."""
    customers = table(spark, sf_dir, "customer")
    one = customers.filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("k"), F.lit("rich").alias("why"))
    two = customers.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("k"), F.lit("building").alias("why"))
    return one.unionByName(two.join(one.select("k"), "k", "left_anti"))
