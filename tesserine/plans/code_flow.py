"""Queries over code: register accesses, usage of global variables and their propagation along calls.

The tables stand for code: customers and some nations are public functions that
call nations, suppliers and parts of a driver; line items are statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators import dataflow
from ..operators.interfaces import register_interface
from ..operators.source_graph import source_graph
from ..registry import register
from ..sources import c_access
from ..sources.c_source import c_findings
from ..tables import table

#: The call graph and what belongs to it, the same text for Spark and the oracle.  Every fourth nation is a dispatcher (its suppliers are cases);
#: parts (P) and their helpers (Q) call each other; T is five calls away from a customer.
_GRAPH = {
    "public": "select 'C' || cast(c_custkey as string) as node from {customer} union all select 'N' || cast(n_nationkey as string) from {nation} where n_nationkey % 3 = 0",
    "calls": """select 'C' || cast(c_custkey as string) as caller, 'N' || cast(c_nationkey as string) as callee, cast(null as string) as case_label from {customer}
        union all select 'N' || cast(s_nationkey as string), 'S' || cast(s_suppkey as string), case when s_nationkey % 4 = 0 and s_suppkey % 5 > 0 then 'case ' || cast(s_suppkey as string) end from {supplier}
        union all select 'S' || cast(s_suppkey as string), 'P' || cast(s_suppkey % 25 as string), null from {supplier}
        union all select 'P' || cast(n_nationkey as string), 'Q' || cast(n_nationkey % 5 as string), null from {nation}
        union all select 'Q' || cast(r_regionkey as string), 'P' || cast(r_regionkey * 3 as string), null from {region}
        union all select 'Q' || cast(r_regionkey as string), 'T' || cast(r_regionkey as string), null from {region}
        union all select 'N' || cast(n_nationkey as string), 'T' || cast(n_nationkey % 5 as string), null from {nation} where n_nationkey % 5 = 1""",
    "accesses": """select 'P' || cast(n_nationkey as string) as node, 'G' || cast(n_nationkey % 3 as string) as target, 'mode' as member, 'READ' as access_type, 'DIRECT' as context, 'B0' as branch_id from {nation}
        union all select 'P' || cast(n_nationkey as string), 'G' || cast(n_nationkey % 3 as string), 'mode', 'WRITE', 'DIRECT', 'B1' from {nation}
        union all select 'P' || cast(n_nationkey as string), 'G' || cast(n_nationkey % 3 as string), 'level', 'READ', 'DIRECT', 'B2' from {nation}
        union all select 'P' || cast(n_nationkey as string), 'G' || cast(n_nationkey % 3 as string), 'level', 'READ_WRITE', 'DIRECT', 'B3' from {nation}
        union all select 'N' || cast(n_nationkey as string), 'G' || cast(n_nationkey % 3 as string), 'count', case when n_nationkey % 2 = 0 then 'READ' else 'WRITE' end, 'DIRECT', 'B0' from {nation}
        union all select 'S' || cast(s_suppkey as string), 'G' || cast(s_suppkey % 3 as string), 'share', case when s_suppkey % 2 = 0 then 'READ' else 'WRITE' end, 'ALIAS', null from {supplier}
        union all select 'Q' || cast(r_regionkey as string), 'G0', 'mode', 'READ', null, null from {region}
        union all select 'T' || cast(r_regionkey as string), 'G1', 'tail', 'WRITE', 'DIRECT', 'B0' from {region}
        union all select 'C' || cast(c_custkey as string), 'G' || cast(c_custkey % 3 as string), 'mode', 'READ', case when c_custkey % 2 = 0 then 'DIRECT' else 'ALIAS' end, 'B0' from {customer} where c_custkey % 10 < 4""",
    "constants": """select 'S' || cast(s_suppkey as string) as caller, 'P' || cast(s_suppkey % 25 as string) as callee, 0 as position, cast(s_nationkey % 3 as string) as value from {supplier} where s_suppkey % 7 > 0
        union all select 'Q' || cast(r_regionkey as string), 'P' || cast(r_regionkey * 3 as string), 0, '1' from {region}""",
    "parameters": "select 'P' || cast(n_nationkey as string) as function_id, 0 as position, 'mode_id' as name from {nation} where n_nationkey % 6 <> 5",
    "branches": """select 'P' || cast(n_nationkey as string) as callee, 'B1' as branch_id, 'mode_id' as param, '==' as op, '0' as value, false as is_else, 'x' as chain from {nation}
        union all select 'P' || cast(n_nationkey as string), 'B2', 'mode_id', case when n_nationkey % 2 = 0 then '==' else '!=' end, '1', false, 'x' from {nation}
        union all select 'P' || cast(n_nationkey as string), 'B3', 'mode_id', null, null, true, 'x' from {nation}""",
}
_NAMES = {t: t for t in ("region", "nation", "customer", "supplier")}


def code_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``public, calls, accesses, constants, parameters, branches`` as :func:`dataflow.propagate` takes them."""
    given = {t: table(spark, sf_dir, t) for t in _NAMES}
    return {name: spark.sql(text, **{t: df for t, df in given.items() if f"{{{t}}}" in text}) for name, text in _GRAPH.items()}


def _walk(name: str, closed: str) -> str:
    return f"""{name}(node, spot, depth) as (select node, node, 0 from public union select w.node, l.callee, w.depth + 1 from {name} w join links l on l.caller = w.spot left join disp d on d.caller = w.spot
        where w.depth < 4 and l.callee <> w.node and ({closed}))"""


_PROPAGATION_SQL = (
    "with recursive "
    + ", ".join(f"{name} as ({text.format(**_NAMES)})" for name, text in _GRAPH.items())
    + """, disp as (select caller from calls where case_label is not null group by 1 having count(distinct callee) >= 2), links as (select distinct caller, callee, case_label is null as plain from calls), """
    + _walk("own", "d.caller is null or (w.depth = 0 and l.plain)")
    + ", "
    + _walk("wide", "true")
    + """, flows as (select node, spot, min(depth) as depth from own where depth > 0 group by 1, 2), around as (select distinct node, spot as caller from wide),
    given as (select a.node, c.callee as spot, p.name as param, c.value from constants c join around a on a.caller = c.caller join flows f on f.node = a.node and f.spot = c.callee left join parameters p on p.function_id = c.callee and p.position = c.position),
    decided as (select distinct node, spot from given where spot in (select callee from branches)), one as (select node, spot, param, min(value) as v from given where param is not null group by all having count(distinct value) = 1),
    taken as (select d.node, d.spot, b.branch_id from decided d join branches b on b.callee = d.spot left join one o on o.node = d.node and o.spot = d.spot and o.param = b.param
        where o.v is null or case when b.is_else then not exists (select 1 from branches s where s.callee = b.callee and s.chain = b.chain and s.op = '==' and s.value = o.v) when b.op = '==' then b.value = o.v when b.op = '!=' then b.value <> o.v else true end),
    met as (select f.node, f.spot, f.depth, a.target, a.member, a.access_type from flows f join accesses a on a.node = f.spot left join decided d on d.node = f.node and d.spot = f.spot
        left join taken t on t.node = f.node and t.spot = f.spot and t.branch_id = a.branch_id where d.node is null or coalesce(a.branch_id, 'B0') = 'B0' or t.node is not null),
    open as (select m.* from met m left join (select distinct node, target, member from accesses where coalesce(context, 'DIRECT') = 'DIRECT') x on x.node = m.node and x.target = m.target and x.member = m.member where x.node is null),
    each as (select node, spot, target, member, min(depth) as depth, bool_or(access_type = 'READ') as r, bool_or(access_type = 'WRITE') as w, bool_or(access_type = 'READ_WRITE') as b from open group by 1, 2, 3, 4),
    kinds as (select node, spot, depth, target, member, unnest(case when r and w and not b then ['READ_WRITE'] else list_filter([case when r then 'READ' end, case when w then 'WRITE' end, case when b then 'READ_WRITE' end], lambda x: x is not null) end) as access_type from each),
    left_over as (select k.* from kinds k left join (select distinct node, target, member, access_type from accesses) x on x.node = k.node and x.target = k.target and x.member = k.member and x.access_type = k.access_type where x.node is null)
    select node, target, member, access_type, spot as callee, depth from left_over
    qualify row_number() over (partition by node, target, member order by case access_type when 'READ_WRITE' then 0 when 'WRITE' then 1 else 2 end, depth, spot) = 1"""
)


@register("callee_propagation", _PROPAGATION_SQL)
def callee_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses that public functions have through their callees, with dispatchers closed and branches chosen by constants."""
    g = code_graph(spark, sf_dir)
    public, calls = cut(g["public"]), cut(g["calls"])
    return dataflow.propagate(public, calls, g["accesses"], g["constants"], g["parameters"], g["branches"], most=4, cut=cut)


#: Statements by kind, and the accesses in each of them.  Fixed values of the made-up code, not of any source.
_STATEMENTS = """case l_partkey % 8
    when 0 then 'AdcSFR->REG' || cast(l_suppkey % 40 as string) || '.U = 1u;'
    when 1 then 'x = AdcSFR->REG' || cast(l_suppkey % 40 as string) || '.B.FLD & (1u << 3);'
    when 2 then 'AdcSFR->REG' || cast(l_suppkey % 40 as string) || '[i].U |= 1u;'
    when 3 then 'while ((AdcSFR->REG' || cast(l_suppkey % 40 as string) || '.U & MASK) == 0u) {{ ; }}'
    when 4 then 'DRV_SFRWRITE(AdcSFR->REG' || cast(l_suppkey % 40 as string) || '.U, AdcSFR->SRC.U);'
    when 5 then 'y = DRV_SFRREAD(4, AdcSFR->REG' || cast(l_suppkey % 40 as string) || '.U); /* AdcSFR->NOT.U = 1; */'
    when 6 then 'DRV_SWPMSK(&AdcSFR->REG' || cast(l_suppkey % 40 as string) || '.U, mask, 1u);'
    else 'Dma_RegPtr[k]->GRP[j].REG' || cast(l_suppkey % 40 as string) || '.U ^= 2u;' end"""
_ACCESSES_SQL = f"""s as (select l_orderkey as function_id, row_number() over (partition by l_orderkey order by l_linenumber, {_STATEMENTS.replace("{{", "{").replace("}}", "}")})::int as line, l_partkey % 8 as kind, 'REG' || (l_suppkey % 40) as reg from lineitem),
    k(kind, before, after, field, access_type) as (values (0, '', '', 'U', 'WRITE'), (1, '', '', 'FLD', 'READ'), (2, '', '[i]', 'U', 'READ'), (2, '', '[i]', 'U', 'WRITE'), (3, '', '', 'U', 'READ'), (4, '', '', 'U', 'WRITE'), (5, '', '', 'U', 'READ'), (6, '', '', 'U', 'READ'), (6, '', '', 'U', 'WRITE'), (7, 'GRP_', '', 'U', 'READ'), (7, 'GRP_', '', 'U', 'WRITE')),
    a as (select function_id, before || reg || after as register, field, access_type, line from s join k using (kind) union all select function_id, 'SRC', 'U', 'READ', line from s where kind = 4)"""


def driver_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``function_id, body``: an order's line items as the statements of a function."""
    lines = spark.sql(f"select l_orderkey as function_id, l_linenumber as no, {_STATEMENTS} as statement from {{lineitem}}", lineitem=table(spark, sf_dir, "lineitem"))
    grouped = lines.groupBy("function_id").agg(F.array_sort(F.collect_list(F.struct("no", "statement"))).alias("s"))
    return grouped.select("function_id", F.array_join(F.transform("s", lambda x: x["statement"]), "\n").alias("body"))


@register("register_accesses", f"with {_ACCESSES_SQL} select * from a")
def register_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of registers in every function's text."""
    return c_access.register_accesses(driver_functions(spark, sf_dir))


_REGISTERS = "select case s_suppkey % 3 when 0 then 'ADC_REG' when 1 then 'ADC_GRP' || cast(s_suppkey % 2 as string) || '_REG' else 'DMA_REG' end || cast(s_suppkey % 50 as string) as name, case when s_suppkey % 3 = 2 then 'dma' else 'adc' end as module from {supplier}"


@register(
    "register_access_edges",
    f"""with {_ACCESSES_SQL}, r as (select distinct * from ({_REGISTERS.format(supplier="supplier")})), n as (select function_id, replace(regexp_replace(register, '\\[.*?\\]', '', 'g'), '.', '_') as norm, access_type, min(field) as field from a group by 1, 2, 3),
    m as (select norm, name from (select distinct norm from n) join r on module = 'adc' and (ends_with(name, '_' || norm) or (contains(norm, '_') and regexp_full_match(name, '.*_' || replace(norm, '_', '\\d*_') || '\\d*'))))
    select function_id, coalesce(name, norm) as register, access_type, min(field) as field, name is null as created from n left join m using (norm) group by 1, 2, 3, 5""",
)
def register_access_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions linked to the registers of their module that they access; what no register matches is created."""
    found = c_access.register_accesses(driver_functions(spark, sf_dir)).withColumn("module", F.lit("adc"))
    return dataflow.register_edges(found, spark.sql(_REGISTERS, supplier=table(spark, sf_dir, "supplier")).distinct())


_USES = """select l_suppkey as function_id, case l_partkey % 7 when 0 then 'Drv_State.core[' || cast(l_linenumber as string) || '].regs->mode' when 1 then 'p->mode' when 2 then '(*q).level' when 3 then 'Count' when 4 then '&Drv_State.other.unknown'
    when 5 then 'local_only.x' else 'Drv_State.core[0].regs' end as chain, case when l_returnflag = 'R' then 'READ' else 'WRITE' end as access_type, case when l_linestatus = 'F' then 'CALL' end as context from {lineitem}"""


@register(
    "global_usage",
    f"""with u as ({_USES.format(lineitem="lineitem")}), v as (select function_id, case when chain like 'Drv_State%' or chain like '&Drv_State%' or ((chain like 'p%' or chain like '(*q%') and function_id % 2 = 0) then 1 when chain = 'Count' then 2 when chain like 'p%' or chain like '(*q%' then 3 end as variable_id,
    case when chain like '%regs->mode' or chain = 'p->mode' then 'core.regs.mode' when chain = '(*q).level' then 'core.regs.level' when chain like '%.regs' then 'core.regs' when chain like '%other%' then 'other' else '' end as member, access_type,
    case when chain like 'p%' or chain like '(*q%' then 'ALIAS' else coalesce(context, 'DIRECT') end as context, chain from u where chain <> 'local_only.x')
    select function_id, variable_id, member, case when count(distinct access_type) > 1 then 'READ_WRITE' else min(access_type) end as access_type, array_to_string(list_sort(list_distinct(list(context))), ',') as contexts, (array_agg(chain order by length(chain) desc, chain))[1] as via_chain, count(*) as n from v group by 1, 2, 3""",
)
def global_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions linked to the global variables and members that they use, straight or through local pointers (``q`` stands for ``p``)."""
    uses = spark.sql(_USES, lineitem=table(spark, sf_dir, "lineitem"))
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("function_id"))
    target = F.when(F.col("function_id") % 2 == 0, "&Drv_State.core[0].regs").otherwise("&Drv_Other.core[1].regs")
    aliases = owners.select("function_id", F.lit("p").alias("local"), target.alias("chain")).unionByName(owners.select("function_id", F.lit("q").alias("local"), F.lit("*p").alias("chain")))
    variables = spark.createDataFrame([(1, "Drv_State", "State"), (2, "Count", "uint32"), (3, "Drv_Other", "State")], "variable_id int, name string, type string")
    members = spark.createDataFrame([("State", "core", "Core"), ("State", "other", "uint32"), ("Core", "regs", "Regs"), ("Regs", "mode", "uint8"), ("Regs", "level", "uint8")], "type string, member string, member_type string")
    return dataflow.usage_edges(dataflow.resolve_chains(uses, variables, aliases, members))


_OWN_REGISTERS = """select 'P' || cast(n_nationkey as string) as node, 'REG' || cast(n_nationkey % 7 as string) as register, case when n_nationkey % 2 = 0 then 'READ' else 'WRITE' end as access_type, 'F' || cast(n_nationkey as string) as field from {nation}
    union all select 'N' || cast(n_nationkey as string), 'REG' || cast(n_nationkey % 5 as string), 'READ', 'N' || cast(n_nationkey as string) from {nation}"""


@register(
    "register_propagation",
    "with recursive "
    + ", ".join(f"{name} as ({_GRAPH[name].format(**_NAMES)})" for name in ("public", "calls"))
    + f""", own as ({_OWN_REGISTERS.format(nation="nation")}), disp as (select caller from calls where case_label is not null group by 1 having count(distinct callee) >= 2), links as (select distinct caller, callee from calls),
    w(node, spot, depth) as (select node, node, 0 from public union select w.node, l.callee, w.depth + 1 from w join links l on l.caller = w.spot left join disp d on d.caller = w.spot where w.depth < 5 and l.callee <> w.node and (d.caller is null or w.depth = 0))
    select w.node, o.register, o.access_type, coalesce(min(case when w.depth = 0 then o.field end), min(o.field)) as field, bool_and(w.depth > 0) as propagated from w join own o on o.node = w.spot group by 1, 2, 3""",
)
def register_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers that public functions access themselves or through up to five calls, not through dispatchers."""
    g = code_graph(spark, sf_dir)
    own = spark.sql(_OWN_REGISTERS, nation=table(spark, sf_dir, "nation"))
    return dataflow.propagate_registers(cut(g["public"]), cut(g["calls"]), own, most=5, cut=cut)


_FILE_SQL = """s as (select s_suppkey as s, s_nationkey as n, (s_suppkey * 7) % 100 as c from supplier), calls as (select a.s, b.s as c from s a join s b on a.c = b.s),
    w(s, spot, depth) as (select s, s, 0 from s union select w.s, calls.c, depth + 1 from w join calls on calls.s = w.spot where depth < 5 and calls.c <> w.s)
    select 'CALLS' as rel, 'Function:Fn_' || s as src, 'Function:Fn_' || c as dst from calls union select 'DEFINED_IN', 'Function:Fn_' || s, 'SourceFile:src/f' || n || '.c' from s union select 'DEFINED_IN', 'GlobalVariable:src/f' || n || '.c:Count_' || n, 'SourceFile:src/f' || n || '.c' from s
    union select 'HAS_GLOBAL', 'SourceFile:src/f' || n || '.c', 'GlobalVariable:src/f' || n || '.c:Count_' || n from s union select 'BELONGS_TO_MODULE', 'SourceFile:src/f' || n || '.c', 'Module:drv' from s
    union select 'USES_GLOBAL', 'Function:Fn_' || s, 'GlobalVariable:src/f' || n || '.c:Count_' || n from s union select 'ACCESSES_REGISTER', 'Function:Fn_' || s, 'Register:REG' || (spot % 40) from w"""


@register("source_graph", f"with recursive {_FILE_SQL}")
def source_graph_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationships of a tree of C files, a nation's suppliers each: parsed, resolved over files, and propagated along calls."""
    key = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("void Fn_"), key("s_suppkey"), F.lit("(uint8 Mode)\n{\n    Count_"), key("s_nationkey"), F.lit(" += 1u; /* one more */\n    Fn_"), (F.col("s_suppkey") * 7 % 100).cast("string"), F.lit("(1u);\n    AdcSFR->REG"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".U = Mode;\n}\n"))
    parts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", text.alias("text")))).alias("f"))
    head = F.concat(F.lit("static uint32 Count_"), key("s_nationkey"), F.lit(" = 0u;\n"))
    files = parts.select(F.concat(F.lit("src/f"), key("s_nationkey"), F.lit(".c")).alias("file"), F.concat(head, F.array_join(F.transform("f", lambda x: x["text"]), "")).alias("text"))
    return source_graph(c_findings(files), "drv", cut=cut).edges.select("rel", "src", "dst").distinct()


_REG = "'MOD_REG' || cast(l_suppkey % 60 as string)"
_EVIDENCE = {
    "edges": f"select l_partkey as function, {_REG} as register, case l_returnflag when 'R' then 'read' when 'A' then 'WRITE' end as access_type, case when l_suppkey % 2 = 0 then 'F' || cast(l_suppkey % 3 as string) end as field, cast(l_suppkey as int) as line, 'D' || cast(l_linenumber as string) as device from {{lineitem}} where l_linenumber <= 2 and l_partkey % 3 > 0",
    "recorded": f"select l_partkey as function, {_REG} as register, case when l_suppkey % 2 = 0 then 'READ' else 'write' end as access_type, 'U' as field, cast(l_suppkey as int) as line from {{lineitem}} where l_linenumber between 2 and 3",
    "listed": f"select l_partkey as function, {_REG} as register, case when l_linenumber = 4 then 'WRITE' else 'READ' end as access_type from {{lineitem}} where l_linenumber between 4 and 5",
    "twins": "select case when s_suppkey % 3 = 0 then 'MOD_REG' || cast(s_suppkey as string) end as sfr_id, 'REG' || cast(s_suppkey as string) as name, case s_suppkey % 5 when 0 then 'PTOP0' when 1 then 'pcpu1' when 2 then 'X' end as read_apu, case s_suppkey % 7 when 0 then 'PCPU' when 1 then 'Y' end as write_apu from {supplier} where s_suppkey % 4 > 0",
    "twin_edges": "select l_partkey as function, case when l_suppkey % 2 = 0 then 'MOD_REG' || cast(l_suppkey % 60 as string) end as sfr_id, 'REG' || cast(l_suppkey % 60 as string) as name, case l_returnflag when 'R' then 'READ' when 'A' then 'write' end as access_type, case l_suppkey % 3 when 0 then 'PTOP' when 1 then 'Z' end as read_apu, cast(null as string) as write_apu from {lineitem} where l_linenumber >= 6",
}
_ZONE = "case when {r} is null and {w} is null then null when upper(concat_ws(' ', {r}, {w})) like '%PTOP%' then 'Untrusted' when upper(concat_ws(' ', {r}, {w})) like '%PCPU%' then 'Trusted' else 'APU: ' || concat_ws(', ', {r}, {w}) end".format(r="read_apu", w="write_apu")


@register(
    "interface_evidence",
    "with "
    + ", ".join(f"{n} as ({t.format(lineitem='lineitem', supplier='supplier')})" for n, t in _EVIDENCE.items())
    + f""", noted as (select function, register, arg_min(access_type, line) as access_type, min(line) as line, 'U' as field from (select *, row_number() over (partition by function, register order by line, access_type) as r from recorded) where r = 1 group by 1, 2),
    own as (select function, register, (array_agg(upper(access_type) order by line, access_type) filter (access_type is not null))[1] as access_type, (array_agg(field order by line, field) filter (field is not null))[1] as field, min(line) as line, array_to_string(list_sort(list_distinct(list(device))), ', ') as device from edges group by 1, 2),
    c as (select o.function, o.register, coalesce(o.access_type, upper(n.access_type), 'UNKNOWN') as access_type, o.field, o.line, o.device, 1 as rank from own o left join noted n on n.function = o.function and n.register = o.register
        union all select function, register, upper(access_type), field, line, '', 2 from noted where function not in (select function from edges) union all select distinct function, register, access_type, null, null::int, '', case when access_type = 'WRITE' then 3 else 4 end from listed),
    held as (select * from c qualify row_number() over (partition by function, register order by rank) = 1), z as (select sfr_id, name, {_ZONE} as zone from twins), d as (select distinct function, sfr_id, name, upper(access_type) as said, {_ZONE} as zone from twin_edges),
    entry as (select h.*, (select arg_min(coalesce(zone, ''), name || coalesce(zone, '')) from z where z.sfr_id = h.register or z.name = regexp_replace(h.register, '^[^_]*_', '')) as zone from held h),
    met as (select d.function, d.sfr_id, d.name, d.said, d.zone, e.register, e.rank from d join entry e on e.function = d.function and (d.sfr_id = e.register or contains(e.register, d.name))),
    one as (select * from met qualify row_number() over (partition by function, sfr_id, name, said, zone order by rank, register) = 1), given as (select function, register, min(zone) as zone from one group by 1, 2),
    fresh as (select coalesce(sfr_id, name) as register, function, min(said) as said, min(zone) as zone from d where not exists (select 1 from met m where m.function = d.function and m.name = d.name and m.sfr_id is not distinct from d.sfr_id) group by 1, 2)
    select e.function, e.register, e.access_type, e.field, e.line, e.device, coalesce(nullif(e.zone, ''), g.zone) as trust_zone, ['edge', 'record', 'written', 'read'][rank] as evidence from entry e left join given g on g.function = e.function and g.register = e.register
    union all select function, register, coalesce(said, 'UNKNOWN'), null, null, '', zone, 'design' from fresh""",
)
def interface_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers of each function by the evidence of both graphs and its own records, which disagree."""
    given = {t: table(spark, sf_dir, t) for t in ("lineitem", "supplier")}
    rows = {n: spark.sql(t, **{k: v for k, v in given.items() if "{" + k + "}" in t}) for n, t in _EVIDENCE.items()}
    return register_interface(**rows)
