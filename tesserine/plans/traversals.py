"""Neighbourhoods, paths, traces, bridges and scopes on the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..graph import EDGE_KINDS, SQL_GRAPH, both_ways, both_ways_at, edges, edges_at, nodes, nodes_at, pairs
from ..operators.traversal import levels, reach, shortest_paths
from ..registry import register
from ..tables import table

_SEEDS = ["Customer:1", "Customer:2", "Supplier:1", "Nation:3"]
_SEED_SQL = "('Customer:1', 'Customer:2', 'Supplier:1', 'Nation:3')"


@register("neighbors_out", SQL_GRAPH + f"select src as node, rel, dst as other from edges where src in {_SEED_SQL}")
def neighbors_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_at(spark, sf_dir, _SEEDS).select(F.col("src").alias("node"), "rel", F.col("dst").alias("other"))


@register("neighbors_in", SQL_GRAPH + f"select dst as node, rel, src as other from edges where dst in {_SEED_SQL}")
def neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_at(spark, sf_dir, _SEEDS, back=True).select(F.col("dst").alias("node"), "rel", F.col("src").alias("other"))


_BOTH = SQL_GRAPH + ", b as (select src as node, rel, dst as other, 'out' as direction from edges union all select dst, rel, src, 'in' from edges) "


@register("neighbors_both", _BOTH + f"select * from b where node in {_SEED_SQL}")
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_ways_at(spark, sf_dir, _SEEDS)


@register(
    "neighbors_topk_per_node",
    _BOTH + "select node, rel, other from (select *, row_number() over (partition by node order by rel, other) as r from b where starts_with(node, 'Customer:') or starts_with(node, 'Nation:')) where r <= 5",
)
def neighbors_topk_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five neighbours of every node; the window's group limit runs before the shuffle, so hubs send five rows a task."""
    wanted = both_ways(edges(spark, sf_dir)).filter(F.col("node").startswith("Customer:") | F.col("node").startswith("Nation:"))
    ranked = wanted.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("rel", "other")))
    return ranked.filter(F.col("_r") <= 5).select("node", "rel", "other")


@register(
    "batch_enrich",
    _BOTH + f""", few as (select * from (select *, row_number() over (partition by node order by rel, other) as r from b where node in {_SEED_SQL}) where r <= 3)
    select node_id, label, name, coalesce(string_agg(rel || '>' || other, '; ' order by rel, other), '') as around from nodes left join few on node = node_id where node_id in {_SEED_SQL} group by all""",
)
def batch_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their properties and up to three neighbours as text."""
    own = nodes_at(spark, sf_dir, _SEEDS).select("node_id", "label", "name")
    ranked = both_ways_at(spark, sf_dir, _SEEDS).withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("rel", "other")))
    few = ranked.filter(F.col("_r") <= 3).groupBy(F.col("node").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("rel", "other"))).alias("_n"))
    text = F.array_join(F.transform("_n", lambda x: F.concat(x["rel"], F.lit(">"), x["other"])), "; ")
    return own.join(few, "node_id", "left").select("node_id", "label", "name", F.coalesce(text, F.lit("")).alias("around"))


@register(
    "transitive_deps",
    SQL_GRAPH.replace("with ", "with recursive ", 1) + """, walk as (select dst as node, 1 as depth from edges where src = 'Order:1' union select e.dst, depth + 1 from walk join edges e on e.src = node where depth < 4),
    least as (select node, min(depth) as depth from walk where node <> 'Order:1' group by 1) select node, depth from least where depth >= 2""",
)
def transitive_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indirect dependencies with their least depth; direct ones are left out."""
    start = spark.range(1).select(F.lit("Order:1").alias("node"))
    return reach(start, edges(spark, sf_dir), most=4, least=2, cut=cut).select("node", "depth")


@register(
    "var_length_path",
    SQL_GRAPH.replace("with ", "with recursive ", 1) + """, walk as (select src as start, dst as node, 1 as depth from edges where src in ('Customer:1', 'Customer:2', 'Supplier:1')
    union select start, e.dst, depth + 1 from walk join edges e on e.src = node where depth < 2) select start, node, min(depth) as depth from walk where node <> start group by 1, 2""",
)
def var_length_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = nodes(spark, sf_dir, "Customer", "Supplier").filter(F.col("node_id").isin("Customer:1", "Customer:2", "Supplier:1")).select(F.col("node_id").alias("node"))
    return reach(start, edges(spark, sf_dir), most=2, cut=cut)


_TREE = """with recursive tree as (select 'Region:' || r_regionkey as node, null::varchar as parent from region union all select 'Nation:' || n_nationkey, 'Region:' || n_regionkey from nation
    union all select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey from supplier), walk as (select node, 0 as depth, node as root from tree where parent is null
    union all select t.node, depth + 1, root from walk w join tree t on t.parent = w.node where depth < 5) """


@register("folder_tree", _TREE + "select root, depth, count(*) as n from walk group by 1, 2")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A containment tree with depth 0 for its roots, as a recursive common table expression."""
    rows = lambda t, label, key, up, upkey: table(spark, sf_dir, t).select(
        F.concat(F.lit(f"{label}:"), F.col(key)).alias("node"), (F.concat(F.lit(f"{up}:"), F.col(upkey)) if up else F.lit(None).cast("string")).alias("parent")
    )
    tree = rows("region", "Region", "r_regionkey", None, None).union(rows("nation", "Nation", "n_nationkey", "Region", "n_regionkey")).union(rows("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"))
    return spark.sql(
        """with recursive walk(node, depth, root) as (select node, 0, node from {tree} where parent is null
        union all select t.node, depth + 1, root from walk w join {tree} t on t.parent = w.node where depth < 5)
        select root, depth, count(*) as n from walk group by root, depth""",
        tree=tree,
    )


@register(
    "shortest_path",
    SQL_GRAPH.replace("with ", "with recursive ", 1) + """, e2 as (select src, dst from edges where rel like 'IN_%' union select dst, src from edges where rel like 'IN_%'),
    walk as (select 'Customer:1' as node, ['Customer:1'] as path, 0 as length union all select dst, list_append(path, dst), length + 1 from walk join e2 on src = node where length < 4 and not list_contains(path, dst)
    and (starts_with(dst, 'Nation:') or starts_with(dst, 'Region:') or dst in ('Supplier:1', 'Supplier:2', 'Supplier:3', 'Supplier:4', 'Region:0', 'Region:1', 'Region:2', 'Region:3', 'Region:4'))),
    best as (select node, min(length) as length from walk where node in ('Supplier:1', 'Supplier:2', 'Supplier:3', 'Supplier:4', 'Region:0', 'Region:1', 'Region:2', 'Region:3', 'Region:4') group by 1)
    select w.node, length, array_to_string(min(path), ' > ') as path from walk w join best using (node, length) group by 1, 2""",
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected shortest paths over the place hierarchy, at most four hops, the least path of equal ones."""
    start = spark.range(1).select(F.lit("Customer:1").alias("node"))
    targets = spark.range(1).select(F.explode(F.array(*map(F.lit, ("Supplier:1", "Supplier:2", "Supplier:3", "Supplier:4", *(f"Region:{k}" for k in range(5)))))).alias("node"))
    found = shortest_paths(start, targets, edges(spark, sf_dir, "IN_NATION", "IN_REGION"), most=4, cut=cut)
    return found.select("node", F.col("length"), F.array_join("path", " > ").alias("path"))


@register(
    "bidirectional_trace",
    SQL_GRAPH + """select 'up' as direction, a.rel || '/' || b.rel as rels, count(*) as n from edges a join edges b on b.src = a.dst where a.src like 'Order:%' group by 2
    union all select 'down', a.rel || '/' || b.rel, count(*) from edges a join edges b on b.dst = a.src where a.dst like 'Nation:%' group by 2""",
)
def bidirectional_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops up from orders and down from nations, by relationship path.

    Only the counts are wanted, so both sides of each pair of kinds that can follow
    one another are reduced to counts by the middle key before the join: a hub adds
    one row, not its paths, and no kind is read that can't be on a path.
    """
    parts = []
    for direction, first, label in (("up", 2, "Order"), ("down", 4, "Nation")):
        mid = 6 - first  # the end of the first edge that the second one shares
        for one in (k for k in EDGE_KINDS if k[first] == label):
            for two in (k for k in EDGE_KINDS if k[first] == one[mid]):
                near, far = ("b", "a") if direction == "up" else ("a", "b")
                left = pairs(spark, sf_dir, one).groupBy(F.col(near).alias("mid")).agg(F.count("*").alias("n1"))
                right = pairs(spark, sf_dir, two).groupBy(F.col(far).alias("mid")).agg(F.count("*").alias("n2"))
                parts.append(left.join(right, "mid").agg(F.sum(F.col("n1") * F.col("n2")).alias("n")).select(F.lit(direction).alias("direction"), F.lit(f"{one[0]}/{two[0]}").alias("rels"), "n"))
    return reduce(DataFrame.unionByName, parts).groupBy("direction", "rels").agg(F.sum("n").alias("n")).filter("n is not null")


@register("vmodel_bridge", "select distinct o_custkey as requirement, l_partkey as part from orders join lineitem on l_orderkey = o_orderkey")
def vmodel_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direct link from A to C wherever A links B and B links C."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("requirement"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(own, "l_orderkey").select("requirement", "part").distinct()


@register(
    "categorised_chain",
    SQL_GRAPH + "select src, count(*) filter (rel = 'PLACED_BY') as placed_by, count(*) filter (rel = 'CONTAINS') as contains from edges where src like 'Order:%' group by 1 order by contains desc, src limit 100",
)
def categorised_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = edges(spark, sf_dir, "PLACED_BY", "CONTAINS").groupBy("src").agg(F.count_if(F.col("rel") == "PLACED_BY").alias("placed_by"), F.count_if(F.col("rel") == "CONTAINS").alias("contains"))
    return per.orderBy(F.desc("contains"), "src").limit(100)


@register(
    "sequence_validation",
    """with s as (select user_id, event_type, ts, event_id, min(case when event_type = 'view' then ts end) over (partition by user_id) as first_view from events)
    select user_id, count(*) as n_calls, count(*) filter (first_view is null or ts < first_view) as n_violations from s where event_type = 'purchase' group by 1""",
)
def sequence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase must come after the user's first view: the dependency's first position is an aggregate, not a sorted sequence."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    first = events.filter(F.col("event_type") == "view").groupBy("user_id").agg(F.min("ts").alias("_first"))
    calls = events.filter(F.col("event_type") == "purchase").join(first, "user_id", "left")
    early = F.col("_first").isNull() | (F.col("ts") < F.col("_first"))
    return calls.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.count_if(early).alias("n_violations"))


@register(
    "topo_order",
    SQL_GRAPH + """select node_id as node, case label when 'Supplier' then 0 when 'Customer' then 0 when 'Nation' then 1 else 2 end as level from nodes where label in ('Supplier', 'Customer', 'Region')
    or (label = 'Nation' and node_id in (select dst from edges)) union all select node_id, 0 from nodes where label = 'Nation' and node_id not in (select dst from edges)""".replace(
        "else 2 end as level from nodes where label in ('Supplier', 'Customer', 'Region')",
        "else (select 1 + max(case when n.node_id in (select dst from edges) then 1 else 0 end) from edges e join nodes n on n.node_id = e.src where e.dst = nodes.node_id and e.rel = 'IN_REGION') end as level from nodes where label in ('Supplier', 'Customer', 'Region')",
    ),
)
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the place hierarchy: what nothing points at comes first."""
    own = nodes(spark, sf_dir, "Supplier", "Customer", "Nation", "Region").select(F.col("node_id").alias("node"))
    return levels(own, edges(spark, sf_dir, "IN_NATION", "IN_REGION"), most=5, cut=cut)


@register(
    "text_mention_link",
    """with n as (select distinct 'item_' || p_size as name, 'M' || p_size % 5 as module from part), t as (select l_orderkey, l_linenumber, 'M' || l_partkey % 5 as module, 'calls item_' || l_partkey % 50 || ' then item_' || l_suppkey % 7 || 'x, see ' || l_returnflag as text from lineitem)
    select distinct l_orderkey, l_linenumber, name from t join n on t.module = n.module and contains(text, name) where not (l_linenumber = 1 and name = 'item_3')""",
)
def text_mention_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link wherever a name with an underscore is a case-sensitive substring of a text of the same module, unless there is one already."""
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("item_"), F.col("p_size").cast("string")).alias("name"), F.concat(F.lit("M"), (F.col("p_size") % 5).cast("string")).alias("module")).distinct()
    part = lambda c, n: (F.col(c) % n).cast("string")
    text = F.concat(F.lit("calls item_"), part("l_partkey", 50), F.lit(" then item_"), part("l_suppkey", 7), F.lit("x, see "), "l_returnflag")
    texts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("M"), part("l_partkey", 5)).alias("module"), text.alias("text"))
    known = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.lit("item_3").alias("name"))
    return mentions(texts, names, ("l_orderkey", "l_linenumber"), "text", "module").join(known, ["l_orderkey", "l_linenumber", "name"], "left_anti")


def mentions(texts: DataFrame, names: DataFrame, keys: tuple[str, ...], text: str, scope: str) -> DataFrame:
    """``keys, name`` for every name of the same ``scope`` that a text has as a substring.

    Names and texts meet by an equi-join on pieces of the text's runs of word characters, at
    every place those of the lengths that names have, so the number of names
    does not multiply the texts and a long run makes its length times the number of lengths.  Names are runs of word characters; one may start inside a run.
    """
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1)))
    sizes = sorted(r[0] for r in names.select(F.length("name").alias("n")).distinct().collect() if r[0])  # as many as names have lengths
    if not sizes:
        return texts.select(*keys, F.lit("").alias("name")).limit(0)
    cuts = lambda w, n: F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda p: F.substring(w, p, F.lit(n)))
    inside = F.flatten(F.transform(F.filter(runs, lambda w: w.contains("_")), lambda w: F.concat(*(cuts(w, n) for n in sizes))))
    pieces = texts.select(*keys, scope, F.explode(F.array_distinct(F.filter(inside, lambda x: x.contains("_")))).alias("name"))
    return pieces.join(names.select("name", scope).distinct(), ["name", scope]).select(*keys, "name").distinct()


@register(
    "path_match_link",
    "select page_id, list_filter(string_split(split_part(split_part(url, '?', 1), '#', 1), '/'), lambda x: x <> '')[-1] as name from pages",
)
def path_match_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last non-empty segment of a path."""
    path = F.split(F.regexp_extract("url", "^([^?#]*)", 1), "/")
    return table(spark, sf_dir, "pages").select("page_id", F.try_element_at(F.filter(path, lambda x: x != ""), F.lit(-1)).alias("name"))


@register("scoped_nodes", SQL_GRAPH + "select node_id, name from nodes where label = 'Customer' and module = 'MACHINERY' order by name, node_id limit 50")
def scoped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = nodes(spark, sf_dir, "Customer").filter(F.col("module") == "MACHINERY")
    return members.select("node_id", "name").orderBy("name", "node_id").limit(50)


@register(
    "scoped_calls",
    "select o_orderkey, o_custkey from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderkey in (select l_orderkey from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#13')",
)
def scoped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose both ends are members of the scope: two semi joins."""
    owners = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    parts = table(spark, sf_dir, "part").filter(F.col("p_brand") == "Brand#13").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey", "left_semi").join(lines, "o_orderkey", "left_semi")


@register(
    "cross_scope",
    "select c_mktsegment as source_module, c_custkey, c_name from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from customer where c_mktsegment in ('BUILDING', 'MACHINERY')) where r <= 20",
)
def cross_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped retrieval of several modules, limited for each of them."""
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    own = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).withColumn("_r", rank).filter(F.col("_r") <= 20)
    return own.select(F.col("c_mktsegment").alias("source_module"), "c_custkey", "c_name")


@register(
    "isolation_check",
    """select c_mktsegment as module, count(*) as scoped, count(*) filter (c_nationkey in (select n_nationkey from nation where n_regionkey = 1)) as linked,
    count(*) = count(*) filter (c_nationkey in (select n_nationkey from nation where n_regionkey = 1)) as isolated from customer group by 1""",
)
def isolation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("c_nationkey"), F.lit(1).alias("_in"))
    per = table(spark, sf_dir, "customer").join(here, "c_nationkey", "left").groupBy(F.col("c_mktsegment").alias("module"))
    return per.agg(F.count("*").alias("scoped"), F.count("_in").alias("linked"), (F.count("*") == F.count("_in")).alias("isolated"))


@register(
    "boundary_rewire",
    """with stub as (select l_orderkey, case when l_linenumber = 1 then 'stub:' || l_partkey else 'Part:' || l_partkey end as dst from lineitem),
    resolved as (select 'stub:' || p_partkey as stub, 'Part:' || p_partkey as node from part where p_partkey % 2 = 0)
    select distinct l_orderkey, coalesce(node, dst) as dst from stub left join resolved on stub = dst""",
)
def boundary_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to stubs are rewired to the nodes that resolve them; edges that then coincide count once."""
    key = F.col("l_partkey").cast("string")
    stubs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, F.concat(F.lit("stub:"), key)).otherwise(F.concat(F.lit("Part:"), key)).alias("dst")).distinct()
    part = F.col("p_partkey").cast("string")
    resolved = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == 0).select(F.concat(F.lit("stub:"), part).alias("dst"), F.concat(F.lit("Part:"), part).alias("_node"))
    return stubs.join(resolved, "dst", "left").select("l_orderkey", F.coalesce("_node", "dst").alias("dst")).distinct()
