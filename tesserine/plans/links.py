"""Linking rules, neighbour expansion, checks and reports over the typed graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators.patterns import listed
from ..operators.traversal import reach
from ..registry import register
from ..sources import exports
from ..tables import table
from .typed_graph import sql_graph, typed_graph

C = F.col
_A, _B = sql_graph("A"), sql_graph("B")
_BOTH = "b as (select src as node, rel, dst as other from e union all select dst, rel, src from e)"


def _around(edges: DataFrame) -> DataFrame:
    """``node, rel, other``: every edge from either end."""
    return edges.select(C("src").alias("node"), "rel", C("dst").alias("other")).union(edges.select("dst", "rel", "src"))


@register(
    "neighbour_expansion",
    _A + f""", {_BOTH}, h as (select id, name, row_number() over (order by seq desc, id) as r from n where label = 'EA_Function' qualify r <= 5),
    c as (select h.id, h.r, b.rel, b.other, row_number() over (partition by h.id order by b.rel, b.other) as k from h join b on b.node = h.id qualify k <= 15),
    f as (select id, other, rel, row_number() over (partition by other order by r, rel) as first from c where other not in (select id from h))
    select h.id, h.name || coalesce(' | ' || string_agg(f.rel || ' ' || x.name, ' | ' order by f.rel, x.name), '') as text from h left join f on f.id = h.id and f.first = 1 left join n x on x.id = f.other group by h.id, h.name""",
)
def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits with the text of up to fifteen neighbours each; a neighbour is told once, with the best hit that has it."""
    g = typed_graph(spark, sf_dir, "A")
    hits = g.nodes.filter(C("label") == "EA_Function").orderBy(F.desc("seq"), "id").limit(5).select("id", "name", F.struct(-C("seq"), C("id")).alias("_r"))
    per = Window.partitionBy("id").orderBy("rel", "other")
    close = _around(g.edges).join(F.broadcast(hits.select(C("id").alias("node"), "id", "_r")), "node").withColumn("_k", F.row_number().over(per)).filter("_k <= 15")
    fresh = close.join(F.broadcast(hits.select(C("id").alias("other"))), "other", "left_anti")
    once = fresh.groupBy("other").agg(F.min(F.struct("_r", "rel", "id")).alias("_b")).select("other", "_b.rel", "_b.id")
    told = once.join(g.nodes.select(C("id").alias("other"), "name"), "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rel", "name"))).alias("_t"))
    text = F.transform("_t", lambda x: F.concat_ws(" ", x["rel"], x["name"]))
    return hits.join(told, "id", "left").select("id", F.concat_ws(" | ", "name", F.array_join(text, " | ")).alias("text"))


@register(
    "rich_neighbours",
    _A + f""", {_BOTH} select b.node as id, b.rel, substr(array_to_string(list_sort(list_distinct(list(x.name)))[1:20], ', '), 1, 400) as names from b join n x on x.id = b.other where b.node in ('P8', 'P18', 'S4', 'M1') group by 1, 2""",
)
def rich_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by relationship: the first twenty names, cut at 400 characters; names are distinct before they are gathered."""
    g = typed_graph(spark, sf_dir, "A")
    named = _around(g.edges).filter(C("node").isin("P8", "P18", "S4", "M1")).join(g.nodes.select(C("id").alias("other"), "name"), "other").select(C("node").alias("id"), "rel", "name").distinct()
    few = named.withColumn("_k", F.row_number().over(Window.partitionBy("id", "rel").orderBy("name"))).filter("_k <= 20")
    return few.groupBy("id", "rel").agg(F.array_sort(F.collect_list("name")).alias("_n")).select("id", "rel", F.substring(listed("_n"), 1, 400).alias("names"))


# What in a name says that a call works on after it returns, and that a function tells whether it has ended.
ASYNC_NAMES = "(?i)(send|transmit|transfer|start|trigger|request|enable)"
STATUS_NAMES = "(?i)(getStatus|isReady|isBusy|waitFor|pollStatus|checkComplete)"
_CALLS = """f as (select id, case seq % 4 when 0 then 'Drv_start' when 1 then 'Drv_getStatus' when 2 then 'Drv_isReady' else 'Drv_read' end || name as name from n where label = 'EA_Function')"""


@register(
    "polling_detection",
    _A + f""", {_CALLS} select f.name, regexp_matches(f.name, '{ASYNC_NAMES}') as needs_polling, case when regexp_matches(f.name, '{ASYNC_NAMES}') then coalesce(min(t.name), regexp_extract(f.name, '^(.*)_', 1) || '_getStatus') end as status_function
    from f left join e on e.src = f.id and e.rel = 'EA_CALLS' left join f t on t.id = e.dst and regexp_matches(t.name, '{STATUS_NAMES}') group by f.id, f.name""",
)
def polling_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that need polling, with the first status function they call, or one inferred from the name."""
    g = typed_graph(spark, sf_dir, "A")
    kind = C("seq") % 4
    prefix = F.when(kind == 0, "Drv_start").when(kind == 1, "Drv_getStatus").when(kind == 2, "Drv_isReady").otherwise("Drv_read")
    functions = g.nodes.filter(C("label") == "EA_Function").select("id", F.concat(prefix, "name").alias("name"))
    status = functions.filter(C("name").rlike(STATUS_NAMES)).select(C("id").alias("dst"), C("name").alias("_s"))
    found = g.edges.filter(C("rel") == "EA_CALLS").join(status, "dst").groupBy(C("src").alias("id")).agg(F.min("_s").alias("_s"))
    needs = C("name").rlike(ASYNC_NAMES)
    inferred = F.concat(F.regexp_extract("name", "^(.*)_", 1), F.lit("_getStatus"))
    return functions.join(found, "id", "left").select("name", needs.alias("needs_polling"), F.when(needs, F.coalesce("_s", inferred)).alias("status_function"))


@register(
    "neighbour_pull",
    _A.replace("with ", "with recursive ", 1) + """, s as (select e.src, e.dst from e join n x on x.id = e.src join n y on y.id = e.dst where x.module = y.module and e.rel in ('EA_CALLS', 'EA_DEPENDS_ON', 'EA_AGGREGATES')), b as (select * from s union select dst, src from s),
    w as (select dst as node, 1 as depth from b where src = 'P18' union select b.dst, depth + 1 from w join b on b.src = w.node where depth < 3) select node, min(depth) as depth from w where node <> 'P18' group by 1 order by 2, 1 limit 500""",
)
def neighbour_pull(spark: SparkSession, sf_dir: str, depth: int = 3) -> DataFrame:
    """What lies within ``depth`` hops in the same module, at most 500 nodes, nearest first."""
    if not 1 <= depth <= 5:
        raise ValueError("depth must lie between 1 and 5")
    g = typed_graph(spark, sf_dir, "A")
    own = g.edges.filter(C("rel").isin("EA_CALLS", "EA_DEPENDS_ON", "EA_AGGREGATES"))
    at = g.nodes.select("id", "module")
    same = own.join(at.select(C("id").alias("src"), C("module").alias("_a")), "src").join(at.select(C("id").alias("dst"), C("module").alias("_b")), "dst").filter("_a = _b").select("src", "dst")
    start = spark.range(1).select(F.lit("P18").alias("node"))
    return reach(start, same.union(same.select("dst", "src")), most=depth, cut=cut).select("node", "depth").orderBy("depth", "node").limit(500)


@register(
    "hw_sw_links",
    _A + """, l as (select src as f, dst as r, 0 as how from e where rel = 'EA_ACCESSES_REGISTER' union all select a.src, b.dst, 1 from e a join e b on b.src = a.dst where a.rel = 'EA_CALLS' and b.rel = 'EA_ACCESSES_REGISTER')
    select f.name as function, r.name as register, case min(how) when 0 then 'direct' else 'indirect' end as link from l join n f on f.id = l.f and f.label = 'EA_Function' and f.module = 'M1' join n r on r.id = l.r and r.label = 'EA_Register' group by 1, 2""",
)
def hw_sw_links(spark: SparkSession, sf_dir: str, module: str = "M1") -> DataFrame:
    """Functions of a module and the registers they reach, directly or over one call; the direct link counts where both are."""
    g = typed_graph(spark, sf_dir, "A")
    functions = g.scan("f", "EA_Function", module=module)
    direct = g.hop(functions, "f", "EA_ACCESSES_REGISTER", "r", "EA_Register").select("f.name", C("r.name").alias("register"), F.lit(0).alias("_how"))
    over = g.hop(g.hop(functions, "f", "EA_CALLS", "c"), "c", "EA_ACCESSES_REGISTER", "r", "EA_Register").select("f.name", C("r.name").alias("register"), F.lit(1).alias("_how"))
    best = direct.union(over).groupBy(C("name").alias("function"), "register").agg(F.min("_how").alias("_how"))
    return best.select("function", "register", F.when(C("_how") == 0, "direct").otherwise("indirect").alias("link"))


@register(
    "undocumented_registers",
    _A + """select name from n where label = 'EA_Register' and id not in (select dst from e where rel = 'EA_AGGREGATES') and id not in (select dst from e where rel = 'EA_ACCESSES_REGISTER' and mark = 'R') and id not in (select src from e where rel = 'APPEARS_IN')
    union select name from n where label in ('EA_DataType', 'EA_SourceFile') and id not in (select dst from e where rel = 'EA_AGGREGATES') and id not in (select dst from e where rel = 'EA_ACCESSES_REGISTER' and mark = 'R') and id not in (select src from e where rel = 'APPEARS_IN' and dst < 'D2')""",
)
def undocumented_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that none of three kinds of edges documents."""
    g = typed_graph(spark, sf_dir, "A")
    e = g.edges
    parts = e.filter(C("rel") == "EA_AGGREGATES").select(C("dst").alias("id"))
    read = e.filter((C("rel") == "EA_ACCESSES_REGISTER") & (C("mark") == "R")).select(C("dst").alias("id"))
    shown = e.filter((C("rel") == "APPEARS_IN") & ((C("dst") < "D2") | C("src").startswith("S"))).select(C("src").alias("id"))
    own = g.nodes.filter(C("label").isin("EA_Register", "EA_DataType", "EA_SourceFile")).select("id", "name")
    return reduce(lambda rows, links: rows.join(links, "id", "left_anti"), (parts, read, shown), own).select("name").distinct()


@register(
    "hsi_extraction",
    _B + """, a as (select src, list_sort(list_distinct(list(x.name || ':' || e.mark))) as v from e join n x on x.id = e.dst where rel = 'ACCESSES_REGISTER' group by 1), d as (select src, list_sort(list_distinct(list(x.name))) as v from e join n x on x.id = e.dst where rel = 'DEPENDS_ON' group by 1)
    select n.name as function, coalesce(array_to_string(a.v, ', '), '') as registers, coalesce(array_to_string(d.v, ', '), '') as callees, coalesce(len(a.v), 0) as n_registers from n left join a on a.src = n.id left join d on d.src = n.id where label = 'Function' and module = 'M3'""",
)
def hsi_extraction(spark: SparkSession, sf_dir: str, module: str = "M3") -> DataFrame:
    """Hardware and software interface of each function: its registers with access, and what it calls."""
    g = typed_graph(spark, sf_dir, "B")
    rows = g.gather(g.scan("f", "Function", module=module), "f", "ACCESSES_REGISTER", F.concat_ws(":", "x.name", "r.mark"), "_registers")
    rows = g.gather(rows, "f", "DEPENDS_ON", "name", "_callees")
    return rows.select(C("f.name").alias("function"), listed("_registers").alias("registers"), listed("_callees").alias("callees"), F.size("_registers").cast("long").alias("n_registers"))


@register(
    "hsi_enrichment",
    _A + "select r.name, x.label as twin, x.kind as twin_kind from n r join (select name, label, kind from n where label = 'ProductRequirement' union all select 'Supplier#' || lpad(cast(seq as string), 9, '0'), label, kind from n where label = 'EA_Function') x on x.name = r.name where r.label = 'EA_Register'",
)
def hsi_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register hits with their twins under another label, by equal name."""
    g = typed_graph(spark, sf_dir, "A")
    twin = g.nodes.filter(C("label") == "EA_Function").select(F.concat(F.lit("Supplier#"), F.lpad(C("seq").cast("string"), 9, "0")).alias("name"), C("label").alias("twin"), C("kind").alias("twin_kind"))
    return g.nodes.filter(C("label") == "EA_Register").select("name").join(twin, "name")


@register("membership_linking", _A + "select 'SET:' || module as src, 'HAS_MEMBER' as rel, id as dst from n where label in ('EA_Function', 'EA_Register') and not (module = 'M2' and label = 'EA_Register')")
def membership_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership edges of existing nodes to their module's set, but for those already there."""
    nodes = typed_graph(spark, sf_dir, "A").nodes.filter(C("label").isin("EA_Function", "EA_Register"))
    linked = nodes.filter((C("module") == "M2") & (C("label") == "EA_Register")).select("id")
    return nodes.join(linked, "id", "left_anti").select(F.concat(F.lit("SET:"), "module").alias("src"), F.lit("HAS_MEMBER").alias("rel"), C("id").alias("dst"))


@register("name_match_linking", f"select a.id as src, 'IMPLEMENTS_EA' as rel, d.id as dst from ({_B} select * from n) a join ({_A} select * from n) d on d.name = a.name and d.module = a.module where a.label = 'Function' and d.label = 'EA_Function'")
def name_match_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function and the design function of the same name and module."""
    code = typed_graph(spark, sf_dir, "B").nodes.filter(C("label") == "Function").select(C("id").alias("src"), "name", "module")
    design = typed_graph(spark, sf_dir, "A").nodes.filter(C("label") == "EA_Function").select(C("id").alias("dst"), "name", "module")
    return code.join(design, ["name", "module"]).select("src", F.lit("IMPLEMENTS_EA").alias("rel"), "dst")


@register(
    "tag_linking",
    _A + ", t as (select p_partkey, trim(unnest(string_split('PRQ-' || p_size || '; PRQ-' || p_partkey % 50 || ';X-1', ';'))) as tag from part) select distinct 'P' || p_partkey as src, n.id as dst from t join n on n.key = t.tag and n.label = 'ProductRequirement'",
)
def tag_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded tags meet the requirements they name."""
    text = F.concat(F.lit("PRQ-"), C("p_size").cast("string"), F.lit("; PRQ-"), (C("p_partkey") % 50).cast("string"), F.lit(";X-1"))
    tags = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), C("p_partkey").cast("string")).alias("src"), F.explode(F.transform(F.split(text, ";"), lambda t: F.trim(t))).alias("key"))
    targets = typed_graph(spark, sf_dir, "A").nodes.filter(C("label") == "ProductRequirement").select("key", C("id").alias("dst"))
    return tags.join(targets, "key").select("src", "dst").distinct()


_FUNCTIONS = "f as (select 'P' || p_partkey as id, 'fn_' || p_partkey % 40 as name, 'M' || p_partkey % 3 as module from part), c as (select 'P' || p_partkey as caller, 'M' || p_partkey % 3 as module, 'fn_' || (p_partkey * 7) % 55 as callee from part)"


def _functions_and_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, text = table(spark, sf_dir, "part"), lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    own = (text("P", C("p_partkey")), text("M", C("p_partkey") % 3))
    return part.select(own[0].alias("id"), text("fn_", C("p_partkey") % 40).alias("name"), own[1].alias("module")), part.select(own[0].alias("caller"), own[1].alias("module"), text("fn_", C("p_partkey") * 7 % 55).alias("callee"))


@register(
    "call_edge_linking",
    f"with {_FUNCTIONS}, i as (select name, module, min(id) as id from f group by 1, 2), x as (select name, min(id) as id from f group by 1) select caller, coalesce(i.id, x.id) as callee, i.id is null as cross_module from c left join i on i.name = callee and i.module = c.module left join x on x.name = callee where x.id is not null",
)
def call_edge_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by name: a function of the same module first, else one of another (flagged); unknown names give no edge."""
    functions, calls = _functions_and_calls(spark, sf_dir)
    inside = functions.groupBy(C("name").alias("callee"), "module").agg(F.min("id").alias("_in"))
    any_ = functions.groupBy(C("name").alias("callee")).agg(F.min("id").alias("_any"))
    found = calls.join(any_, "callee").join(inside, ["callee", "module"], "left")
    return found.select("caller", F.coalesce("_in", "_any").alias("callee"), C("_in").isNull().alias("cross_module"))


@register("cross_call_backfill", f"with {_FUNCTIONS} select caller, callee from c where not exists (select 1 from f where f.name = c.callee and f.module = c.module)")
def cross_call_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose callee is no function of the caller's module."""
    functions, calls = _functions_and_calls(spark, sf_dir)
    return calls.join(functions.select(C("name").alias("callee"), "module"), ["callee", "module"], "left_anti").select("caller", "callee")


@register("register_cross_reference", "with t as (select p_partkey, unnest(string_split('REG_' || p_size || ',REG_' || p_partkey % 7, ',')) as name from part) select distinct p_partkey, s_suppkey from t join supplier on 'REG_' || s_suppkey = name")
def register_cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register names in a function's list meet the registers."""
    names = F.array(F.concat(F.lit("REG_"), C("p_size").cast("string")), F.concat(F.lit("REG_"), (C("p_partkey") % 7).cast("string")))
    registers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("REG_"), C("s_suppkey").cast("string")).alias("name"), "s_suppkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(names).alias("name")).join(registers, "name").select("p_partkey", "s_suppkey").distinct()


@register(
    "requirement_trace",
    _B + """select 0 as level, 'Requirement' as kind, id from n where key = 'REQ-9' union select 1, 'Function', e.src from e join n on n.id = e.dst where n.key = 'REQ-9' and e.rel = 'IMPLEMENTS'
    union select 2, 'TestSpecification', e.src from e join n on n.id = e.dst where n.key = 'REQ-9' and e.rel = 'TRACES_TO' union select 3, 'TestResult', v.src from e join n on n.id = e.dst join e v on v.dst = e.src and v.rel = 'VERIFIES' where n.key = 'REQ-9' and e.rel = 'TRACES_TO'""",
)
def requirement_trace(spark: SparkSession, sf_dir: str, requirement: str = "REQ-9") -> DataFrame:
    """A requirement, what implements it, its tests and their results, as rows tagged by level."""
    g = typed_graph(spark, sf_dir, "B")
    own = g.scan("r", "Requirement", key=requirement)
    tests = g.hop(own, "r", "TRACES_TO", "t", "TestSpecification", back=True)
    levels = (own.select("r.id"), g.hop(own, "r", "IMPLEMENTS", "f", back=True).select("f.id"), tests.select("t.id"), g.hop(tests, "t", "VERIFIES", "v", back=True).select("v.id"))
    kinds = ("Requirement", "Function", "TestSpecification", "TestResult")
    return reduce(DataFrame.union, [rows.distinct().select(F.lit(k).alias("level"), F.lit(kind).alias("kind"), "id") for k, (kind, rows) in enumerate(zip(kinds, levels, strict=True))])


@register("design_without_source", f"select d.name from ({_A} select * from n) d where d.label = 'EA_Function' and not exists (select 1 from ({_B} select * from n) c where c.label = 'Function' and c.seq % 2 = 0 and c.name = d.name)")
def design_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design functions that no source function is named after."""
    source = typed_graph(spark, sf_dir, "B").nodes.filter((C("label") == "Function") & (C("seq") % 2 == 0)).select("name")
    return typed_graph(spark, sf_dir, "A").nodes.filter(C("label") == "EA_Function").select("name").join(source, "name", "left_anti")


@register(
    "readiness_parts",
    _A + f", t as (select distinct dst from e where rel = 'TS_VERIFIES'), i as (select distinct src from e where rel = 'EA_IMPLEMENTS'), d as (select distinct dst from e where rel = 'EA_CALLS'), m as (select distinct e.src from e left join n on n.id = e.dst where e.rel = 'EA_CALLS' and n.id is null) select module, "
    + ", ".join(f"round(100.0 * count(case when label = '{label}' and {test} then 1 end) / nullif(count(case when label = '{label}' then 1 end), 0), 2) as {name}" for name, label, test in (
        ("design_coverage", "EA_Function", "id in (select src from i)"), ("test_coverage", "ProductRequirement", "id in (select dst from t)"), ("orphan_ratio", "EA_Function", "id not in (select dst from d)"), ("stale_refs", "EA_Function", "id in (select src from m)")
    )) + " from n where module is not null and label in ('EA_Function', 'ProductRequirement') group by 1",
)
def readiness_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per module: functions with a requirement, requirements with a test, functions nothing calls, functions that call what is gone."""
    g = typed_graph(spark, sf_dir, "A")
    of = lambda rel, end, name: g.edges.filter(C("rel") == rel).select(C(end).alias("id")).distinct().withColumn(name, F.lit(True))
    gone = g.edges.filter(C("rel") == "EA_CALLS").join(g.nodes.select(C("id").alias("dst")), "dst", "left_anti").select(C("src").alias("id")).distinct().withColumn("_gone", F.lit(True))
    rows = g.nodes.filter(C("module").isNotNull() & C("label").isin("EA_Function", "ProductRequirement")).select("id", "label", "module")
    for marks in (of("EA_IMPLEMENTS", "src", "_designed"), of("TS_VERIFIES", "dst", "_tested"), of("EA_CALLS", "dst", "_called"), gone):
        rows = rows.join(marks, "id", "left")
    share = lambda label, test: F.round(100.0 * F.count_if((C("label") == label) & test) / F.nullif(F.count_if(C("label") == label), F.lit(0)), 2)
    return rows.groupBy("module").agg(
        share("EA_Function", C("_designed").isNotNull()).alias("design_coverage"), share("ProductRequirement", C("_tested").isNotNull()).alias("test_coverage"),
        share("EA_Function", C("_called").isNull()).alias("orphan_ratio"), share("EA_Function", C("_gone").isNotNull()).alias("stale_refs"),
    )


@register("node_set_summary", _A + "select label, count(*) as n from n where module = 'M1' group by 1")
def node_set_summary(spark: SparkSession, sf_dir: str, module: str = "M1") -> DataFrame:
    return typed_graph(spark, sf_dir, "A").nodes.filter(C("module") == module).groupBy("label").agg(F.count("*").alias("n"))


@register(
    "aggregation_search",
    _A + """select r.name, string_agg(distinct f.name, ', ' order by f.name) as functions, round(1.6 + 0.1 * (count(distinct f.id) > 3)::int, 2) as score from n r join e on e.dst = r.id and e.rel = 'EA_ACCESSES_REGISTER' join n f on f.id = e.src and f.module = 'M2' where r.label = 'EA_Register' group by 1""",
)
def aggregation_search(spark: SparkSession, sf_dir: str, module: str = "M2") -> DataFrame:
    """The complete list for a question about registers: each with all functions of the module that access it; must-include scores."""
    g = typed_graph(spark, sf_dir, "A")
    rows = g.hop(g.scan("f", module=module), "f", "EA_ACCESSES_REGISTER", "r", "EA_Register").select(C("r.name").alias("name"), C("f.name").alias("_f")).distinct()
    lists = rows.groupBy("name").agg(F.array_sort(F.collect_list("_f")).alias("_l"))
    return lists.select("name", listed("_l").alias("functions"), F.round(1.6 + 0.1 * (F.size("_l") > 3).cast("int"), 2).alias("score"))


@register(
    "node_text",
    _A + "select id, '[' || label || ']' || coalesce(chr(10) || '  Name: ' || name, '') || coalesce(chr(10) || '  Module: ' || module, '') || coalesce(chr(10) || '  Kind: ' || case when length(kind) > 5 then substr(kind, 1, 5) || '…' else kind end, '') || coalesce(chr(10) || '  Status: ' || status, '') as text from n",
)
def node_text(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """A node as labelled lines of its non-empty properties, long values cut."""
    nodes = typed_graph(spark, sf_dir, "A").nodes
    kind = F.when(F.length("kind") > most, F.concat(F.substring("kind", 1, most), F.lit("…"))).otherwise(C("kind"))
    line = lambda title, value: F.concat(F.lit(f"  {title}: "), value)
    return nodes.select("id", F.concat_ws("\n", F.concat(F.lit("["), "label", F.lit("]")), line("Name", C("name")), line("Module", C("module")), line("Kind", kind), line("Status", C("status"))).alias("text"))


# Which context slot a node's label belongs to; the first match wins.
SLOT_RULES = (
    ("src_function", "code_examples"), ("src_sourcefile", "code_examples"), ("swa_sourcefile", "code_examples"), ("src_datatype", "code_examples"), ("src_macro", "code_examples"), ("src_globalvariable", "code_examples"),
    ("src_localvariable", "code_examples"), ("sfr_", "registers"), ("ea_register", "registers"), ("function", "api_functions"), ("testcase", "tests"), ("test", "tests"), ("config", "api_functions"), ("derived", "api_functions"),
    ("requirement", "requirements"), ("decision", "dependencies"), ("architectural", "dependencies"), ("safety", "safety"), ("dependency", "dependencies"), ("module", "relationships"), ("folder", "relationships"),
)
_HEADINGS = (("interface", "api_functions"), ("exported", "api_functions"), ("safety", "safety"), ("config", "api_functions"))


# The same for a document's type, after label and heading.
_TYPES = (("architectural", "dependencies"), ("decision", "dependencies"), ("safety", "safety"), ("config", "api_functions"), ("requirement", "requirements"))


@register(
    "slot_classification",
    _A + ", t as (select id, case when seq % 3 = 0 then '' else label end as label, case seq % 5 when 0 then 'Exported Interface' when 1 then 'Safety notes' when 2 then 'Other' else kind end as heading, case seq % 7 when 0 then 'Architectural Decision' when 1 then 'Config item' when 2 then 'Requirement' when 3 then 'SAFETY case' end as type from n) select id, case "
    + " ".join(f"when contains(lower(label), '{w}') then '{s}'" for w, s in SLOT_RULES) + " " + " ".join(f"when contains(lower(heading), '{w}') then '{s}'" for w, s in _HEADINGS) + " " + " ".join(f"when contains(lower(type), '{w}') then '{s}'" for w, s in _TYPES) + " else 'custom' end as slot from t",
)
def slot_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context slot of a hit, by its label, then by its heading, then by its document's type."""
    seq = C("seq")
    heading = F.when(seq % 5 == 0, "Exported Interface").when(seq % 5 == 1, "Safety notes").when(seq % 5 == 2, "Other").otherwise(C("kind"))
    kind = F.when(seq % 7 == 0, "Architectural Decision").when(seq % 7 == 1, "Config item").when(seq % 7 == 2, "Requirement").when(seq % 7 == 3, "SAFETY case")
    rows = typed_graph(spark, sf_dir, "A").nodes.select("id", F.lower(F.when(seq % 3 == 0, "").otherwise(C("label"))).alias("_l"), F.lower(heading).alias("_h"), F.lower(kind).alias("_t"))
    rules = [(C(c).contains(w), s) for c, own in (("_l", SLOT_RULES), ("_h", _HEADINGS), ("_t", _TYPES)) for w, s in own]
    return rows.select("id", reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit("custom")).alias("slot"))


@register(
    "hit_formatting",
    "select doc_id, md5('[VECTOR] ' || coalesce(source, '') || chr(10) || coalesce('Module: ' || lang || chr(10), '') || case when length(trim(coalesce(text, ''))) > 2000 then substr(trim(text), 1, 2000) || chr(10) || '... (truncated)' else trim(coalesce(text, '')) end) as formatted_md5 from documents",
)
def hit_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit with its tag, its metadata and its text, cut at 2000 characters; a hit without module has no such line."""
    docs = table(spark, sf_dir, "documents")
    body = F.trim(F.coalesce("text", F.lit("")))
    body = F.when(F.length(body) > 2000, F.concat(F.substring(body, 1, 2000), F.lit("\n... (truncated)"))).otherwise(body)
    return docs.select("doc_id", F.md5(F.concat_ws("\n", F.concat(F.lit("[VECTOR] "), F.coalesce("source", F.lit(""))), F.concat(F.lit("Module: "), "lang"), body)).alias("formatted_md5"))


def register_map_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are known nodes: the rest of a load waits until its nodes have come."""
    ends = nodes.select("id")
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


@register("scoped_write", _A + "select e.src, e.rel, e.dst from e join n a on a.id = e.src join n b on b.id = e.dst where a.module = 'M1' and b.module = 'M1'")
def scoped_write(spark: SparkSession, sf_dir: str, module: str = "M1") -> DataFrame:
    """What a tenant's load may write: edges between nodes of its own scope."""
    g = typed_graph(spark, sf_dir, "A")
    return register_map_links(g.edges, g.nodes.filter(C("module") == module)).select("src", "rel", "dst")


@register("graph_export", _A + "select '{\"type\":\"node\",\"id\":\"' || id || '\",\"label\":\"' || label || '\"' || coalesce(',\"name\":\"' || name || '\"', '') || '}' as line from n union all select '{\"type\":\"edge\",\"src\":\"' || src || '\",\"rel\":\"' || rel || '\",\"dst\":\"' || dst || '\"' || coalesce(',\"seq\":' || seq, '') || '}' from e")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes and edges as JSON lines; :func:`exports.write_lines` writes them where they lie."""
    g = typed_graph(spark, sf_dir, "A")
    return exports.graph_lines(g, ("name",), ("seq",))


@register(
    "subgraph_export",
    _A + """, s as (select id from n where label = 'EA_Function' and module = 'M2'), one as (select case when e.src = s.id then e.dst else e.src end as id from e join s on s.id in (e.src, e.dst)), k as (select id from s union select one.id from one join n using (id))
    select '{"type":"node","id":"' || id || '","label":"' || label || '"' || coalesce(',"name":"' || name || '"', '') || '}' as line from n join k using (id) union all select '{"type":"edge","src":"' || src || '","rel":"' || rel || '","dst":"' || dst || '"}' from e where src in (select id from k) and dst in (select id from k)""",
)
def subgraph_export(spark: SparkSession, sf_dir: str, module: str = "M2") -> DataFrame:
    """A module's functions, what is one relationship away, and all relationships among these, as JSON lines."""
    g = typed_graph(spark, sf_dir, "A")
    starts = g.nodes.filter((C("label") == "EA_Function") & (C("module") == module)).select("id")
    return exports.graph_lines(exports.subgraph(g, starts, 1), ("name",))
