"""Traceability, coverage, audits, impact and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import SQL_TRACE, nodes, trace
from ..registry import register
from ..tables import table

_TRACE = f"with {SQL_TRACE} "


@register(
    "trace_matrix",
    _TRACE + "select c_custkey, c_mktsegment, n_code, n_tests, n_code > 0 as has_code, n_tests > 0 as has_tests from matrix",
)
def trace_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).select("c_custkey", "c_mktsegment", "n_code", "n_tests", (F.col("n_code") > 0).alias("has_code"), (F.col("n_tests") > 0).alias("has_tests"))


def severity() -> Column:
    """No code is a high gap, code without tests a medium one."""
    return F.when(F.col("n_code") == 0, "high").when(F.col("n_tests") == 0, "medium")


@register(
    "coverage_gaps",
    _TRACE + """select c_custkey, c_mktsegment, case when n_code = 0 then 'missing_code' else 'missing_test' end as gap,
    case when n_code = 0 then 'high' else 'medium' end as severity from matrix where n_code = 0 or n_tests = 0""",
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = trace(spark, sf_dir).withColumn("severity", severity()).filter(F.col("severity").isNotNull())
    return gaps.select("c_custkey", "c_mktsegment", F.when(F.col("n_code") == 0, "missing_code").otherwise("missing_test").alias("gap"), "severity")


def _ratio(name: str) -> Column:
    return F.round(F.count_if(F.col(name) > 0) / F.count("*"), 3)


@register(
    "coverage_ratios",
    _TRACE + """select count(*) as total, count(*) filter (n_code > 0) as implemented, count(*) filter (n_tests > 0) as tested,
    round(count(*) filter (n_code > 0) / count(*), 3) as code_ratio, round(count(*) filter (n_tests > 0) / count(*), 3) as test_ratio from matrix""",
)
def coverage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(F.col("n_code") > 0).alias("implemented"), F.count_if(F.col("n_tests") > 0).alias("tested"),
        _ratio("n_code").alias("code_ratio"), _ratio("n_tests").alias("test_ratio"),
    )


@register(
    "coverage_by_module",
    _TRACE + """select c_mktsegment as module, count(*) as total,
    printf('%.1f%%', 100.0 * count(*) filter (n_code > 0) / count(*)) as code_coverage, printf('%.1f%%', 100.0 * count(*) filter (n_tests > 0) / count(*)) as test_coverage
    from matrix group by 1""",
)
def coverage_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.format_string("%.1f%%", 100.0 * F.count_if(F.col(c) > 0) / F.count("*"))
    return trace(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("module")).agg(F.count("*").alias("total"), share("n_code").alias("code_coverage"), share("n_tests").alias("test_coverage"))


@register("orphan_nodes", "select 'Customer:' || c_custkey as node_id, c_mktsegment as module from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without any edge of one kind (here: a partly filled order)."""
    placed = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(F.concat(F.lit("Customer:"), F.col("o_custkey")).alias("node_id")).distinct()
    return nodes(spark, sf_dir, "Customer").join(placed, "node_id", "left_anti").select("node_id", "module")


@register(
    "unverified_nodes",
    """select o_orderkey, o_orderpriority from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""",
)
def unverified_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(tested, "o_orderkey", "left_anti")


@register(
    "undocumented_pairs",
    """with open_ as (select distinct l_partkey p, l_suppkey s from lineitem where l_linestatus = 'O'),
    done as (select distinct l_partkey p, l_suppkey s from lineitem where l_linestatus = 'F'),
    missing as (select * from open_ anti join done using (p, s))
    select s as l_suppkey, count(*) as n_parts, array_to_string(list_sort(list(p))[1:5], ',') as sample from missing group by 1""",
)
def undocumented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs used in one way and never documented in the other: a two-column anti join, then a count and five examples.

    The examples come from a bounded window (its group limit runs before the
    shuffle), so a supplier with any number of parts costs five rows.
    """
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    pairs = lambda status: lines.filter(F.col("l_linestatus") == status).select("l_partkey", "l_suppkey").distinct()
    missing = pairs("O").join(pairs("F"), ["l_partkey", "l_suppkey"], "left_anti")
    first = missing.withColumn("_r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))).filter(F.col("_r") <= 5)
    sample = first.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")), ",").alias("sample"))
    return missing.groupBy("l_suppkey").agg(F.count("*").alias("n_parts")).join(sample, "l_suppkey")


@register(
    "writes_no_test",
    """select l_partkey, count(*) as n_writes from lineitem where l_linestatus = 'O' and l_partkey not in
    (select l_partkey from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' and o_orderpriority = '1-URGENT') group by 1""",
)
def writes_no_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    tested = lines.filter(F.col("l_returnflag") == "R").join(urgent, "l_orderkey", "left_semi").select("l_partkey").distinct()
    return lines.filter(F.col("l_linestatus") == "O").groupBy("l_partkey").agg(F.count("*").alias("n_writes")).join(tested, "l_partkey", "left_anti")


@register("untraced", "select p_partkey, p_brand from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 49)")
def untraced(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 49).select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(used, "p_partkey", "left_anti")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


@register(
    "readiness_score",
    _TRACE + """, parts as (select 100.0 * count(*) filter (p_partkey in (select l_partkey from lineitem)) / count(*) as used from part),
    scores as (select 100.0 * count(*) filter (n_code > 0) / count(*) as implemented, 100.0 * count(*) filter (n_tests > 0) / count(*) as tested, any_value(used) as used from matrix, parts),
    total as (select *, 0.4 * implemented + 0.4 * tested + 0.2 * used as score from scores)
    select round(implemented, 3) as implemented, round(tested, 3) as tested, round(used, 3) as used, round(score, 3) as score,
    case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade,
    round(0.4 * (100 - implemented), 3) as if_implemented from total""",
)
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of three coverage scores, its grade, and what full implementation would add."""
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    matrix = trace(spark, sf_dir).agg(share(F.col("n_code") > 0).alias("implemented"), share(F.col("n_tests") > 0).alias("tested"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("_u", F.lit(True))
    parts = table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").agg(share(F.col("_u").isNotNull()).alias("used"))
    both = matrix.unionByName(parts, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("implemented", "tested", "used")))
    total = both.withColumn("score", 0.4 * F.col("implemented") + 0.4 * F.col("tested") + 0.2 * F.col("used"))
    rounded = [F.round(c, 3).alias(c) for c in ("implemented", "tested", "used", "score")]
    return total.select(*rounded, grade(F.col("score")).alias("grade"), F.round(0.4 * (100 - F.col("implemented")), 3).alias("if_implemented"))


@register(
    "impact_from_supplier",
    """select count(distinct l_partkey) as n_parts, count(distinct l_orderkey) as n_orders, count(distinct o_custkey) as n_customers,
    count(distinct case when l_returnflag = 'R' then l_orderkey end) as n_tested_orders from lineitem join orders on o_orderkey = l_orderkey where l_suppkey = 1""",
)
def impact_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") == 1).select("l_orderkey", "l_partkey", "l_returnflag")
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    tested = F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))
    counts = {"n_parts": "l_partkey", "n_orders": "l_orderkey", "n_customers": "o_custkey"}
    return lines.join(owners, "l_orderkey").agg(*(F.count_distinct(c).alias(k) for k, c in counts.items()), F.count_distinct(tested).alias("n_tested_orders"))


@register(
    "impact_from_customer",
    """select 'Part' as kind, count(distinct l_partkey) as n from orders join lineitem on l_orderkey = o_orderkey where o_custkey = 1
    union all select 'Supplier', count(distinct l_suppkey) from orders join lineitem on l_orderkey = o_orderkey where o_custkey = 1
    union all select 'Order', count(*) from orders where o_custkey = 1""",
)
def impact_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").filter(F.col("o_custkey") == 1).select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(own, "l_orderkey")
    reached = lines.select(F.explode(F.array(F.struct(F.lit("Part").alias("kind"), F.col("l_partkey").alias("id")), F.struct(F.lit("Supplier").alias("kind"), F.col("l_suppkey").alias("id")))).alias("x"))
    kinds = reached.select("x.*").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    both = kinds.unionByName(own.agg(F.count("*").alias("n")).select(F.lit("Order").alias("kind"), "n"))
    wanted = F.explode(F.array(F.lit("Part"), F.lit("Supplier"), F.lit("Order"))).alias("kind")
    return spark.range(1).select(wanted).join(both, "kind", "left").fillna({"n": 0})


@register(
    "productivity_rollup",
    """with o as (select o_custkey c, count(*) n, count(*) filter (o_orderstatus = 'F') done, sum(o_totalprice) spent from orders group by 1),
    l as (select o_custkey c, count(*) lines, count(*) filter (l_returnflag = 'R') returned from lineitem join orders on o_orderkey = l_orderkey group by 1)
    select c_custkey, coalesce(n, 0) as n_orders, coalesce(done, 0) as n_done, round(coalesce(spent, 0), 2) as spent, coalesce(lines, 0) as n_lines,
    case when coalesce(lines, 0) = 0 then 0.0 else round(returned / lines, 4) end as return_rate
    from customer left join o on o.c = c_custkey left join l on l.c = c_custkey""",
)
def productivity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact table is aggregated to the customer before the joins, so no fan-out; lines first aggregate to their order."""
    orders = table(spark, sf_dir, "orders")
    per_order = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    per = (
        orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").join(per_order, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.sum("o_totalprice").alias("spent"), F.sum("lines").alias("n_lines"), F.sum("returned").alias("returned"))
    )
    zero = {"n_orders": 0, "n_done": 0, "spent": 0.0, "n_lines": 0, "returned": 0}
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(zero)
    rate = F.when(F.col("n_lines") == 0, 0.0).otherwise(F.round(F.col("returned") / F.col("n_lines"), 4))
    return joined.select("c_custkey", "n_orders", "n_done", F.round("spent", 2).alias("spent"), "n_lines", rate.alias("return_rate"))
