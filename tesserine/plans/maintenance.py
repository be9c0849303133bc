"""Queries over kept state and texts: ownership deletes, suggested orders, versions, JSON in noise, sections by depth, pieces of large texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_folder
from ..functions.json_text import first_object
from ..operators.chunking import depth_sections, large_pieces
from ..operators.ordering import suggest_order
from ..operators.ownership import gone_with
from ..registry import register
from ..sources.snapshots import Snapshots, detect
from ..tables import table

_OWNS = """select 'R' || cast(n_regionkey as string) as owner, 'N' || cast(n_nationkey as string) as owned from {nation}
    union all select 'N' || cast(c_nationkey as string), 'C' || cast(c_custkey as string) from {customer}
    union all select 'N' || cast(s_nationkey as string), 'S' || cast(s_suppkey as string) from {supplier}
    union all select 'C' || cast(o_custkey as string), 'O' || cast(o_orderkey as string) from {orders}
    union all select distinct 'S' || cast(l_suppkey as string), 'O' || cast(l_orderkey as string) from {lineitem}"""
_OWNERS = ("nation", "customer", "supplier", "orders", "lineitem")


@register(
    "owned_delete",
    f"""with recursive owns as ({_OWNS.format(**{t: t for t in _OWNERS})}), roots as (select 'N' || n_nationkey as node from nation where n_nationkey % 4 > 0), nodes as (select owner as node from owns union select owned from owns),
    kept(node) as (select node from nodes where node not in (select owned from owns) and node not in (select node from roots) union select o.owned from kept k join owns o on o.owner = k.node left join roots r on r.node = o.owned where r.node is null)
    select node from nodes where node not in (select node from kept)""",
)
def owned_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with most nations: their customers and suppliers, and the orders of which no owner is left."""
    owns = spark.sql(_OWNS, **{t: table(spark, sf_dir, t) for t in _OWNERS})
    roots = table(spark, sf_dir, "nation").filter("n_nationkey % 4 > 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    return gone_with(roots, owns, cut).select("node")


_NEEDS = """select p_partkey as node, cast(floor(p_partkey / 10) as bigint) as need from {part} union all select p_partkey, cast(floor(p_partkey / 7) as bigint) from {part}
    union all select p_partkey, p_partkey + 1 from {part} where p_partkey % 500 = 7 union all select p_partkey, p_partkey - 1 from {part} where p_partkey % 500 = 8"""


def _order_sql(levels: int = 9) -> str:
    """Levels by longest paths outside of what cycles reach, positions level by level."""
    steps = []
    for k in range(levels):
        before = " union all ".join(f"select * from p{j}" for j in range(k)) or "select 0 as node, 0 as position where false"
        steps.append(f"""p{k} as materialized (select node, (select count(*) from lv where level < {k}) + row_number() over (order by last, place, node) - 1 as position from
            (select f.node, f.place, coalesce(max(b.position), -1) as last from lv l join f on f.node = l.node left join needs n on n.node = f.node left join ({before}) b on b.node = n.need where l.level = {k} group by 1, 2))""")
    served = " union all ".join(f"select * from p{k}" for k in range(levels))
    return f"""with recursive f as (select p_partkey as node, p_partkey * 7919 % 100003 as place from part), needs as (select distinct node, need from ({_NEEDS.format(part="part")}) where need in (select node from f)),
    bad(node) as (select node from f where (node % 500 = 7 and node + 1 in (select node from f)) or (node % 500 = 8 and node - 1 in (select node from f)) union select n.node from bad join needs n on n.need = bad.node),
    deep(node, level) as (select node, 0 from f where node not in (select node from bad) and node not in (select node from needs) union select n.node, level + 1 from deep join needs n on n.need = deep.node where n.node not in (select node from bad)),
    lv as (select node, max(level) as level from deep group by 1), {", ".join(steps)}, served as ({served})
    select f.node, lv.level, coalesce(s.position, (select count(*) from served) + row_number() over (partition by s.position is null order by place, f.node) - 1) as position from f left join served s on s.node = f.node left join lv on lv.node = f.node"""


@register("suggested_order", _order_sql())
def suggested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts with what they need before them; some need each other and come last, with all that waits for them."""
    parts = table(spark, sf_dir, "part")
    functions = parts.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7919 % 100003).alias("place"))
    return suggest_order(functions, spark.sql(_NEEDS, part=parts), cut).select("node", "level", "position")


@register(
    "snapshot_delta",
    """with n as (select o_orderkey::varchar as path, md5(o_orderstatus || floor(o_totalprice + 0.5)::bigint) as h from orders where o_orderkey % 20 <> 0), b as (select o_orderkey::varchar as path, md5(case when o_orderkey % 7 = 0 then 'old' else o_orderstatus end || floor(o_totalprice + 0.5)::bigint) as h from orders where o_orderkey % 11 <> 0)
    select coalesce(n.path, b.path) as path, case when b.path is null then 'ADDED' when n.path is null then 'DELETED' else 'MODIFIED' end as change_type, b.h as old_hash, n.h as new_hash from n full join b on n.path = b.path
    where b.path is null or n.path is null or n.h <> b.h or n.path::bigint % 101 = 5""",
)
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two versions of a store: the first is committed, the second staged over it, with some paths listed by a version-control diff."""
    orders = table(spark, sf_dir, "orders")
    price = F.floor(F.col("o_totalprice") + 0.5).cast("long").cast("string")
    snap = lambda df, status: df.select(F.col("o_orderkey").cast("string").alias("path"), F.md5(F.concat(status, price)).alias("content_hash"))
    store = Snapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    detect(store, snap(orders.filter("o_orderkey % 11 <> 0"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("old")).otherwise(F.col("o_orderstatus"))))
    store.commit()
    listed = orders.filter("o_orderkey % 101 = 5").select(F.col("o_orderkey").cast("string").alias("path"))
    return detect(store, snap(orders.filter("o_orderkey % 20 <> 0"), F.col("o_orderstatus")), listed)


@register(
    "json_in_noise",
    """select event_id, case event_id % 4 when 0 then props::json->>'$.k' when 1 then '7' when 2 then null else cast(event_id as varchar) end as k from events""",
)
def json_in_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in the first JSON object of an answer with prose, fences, braces in strings and objects that never end."""
    own = F.col("event_id").cast("string")
    noise = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('sure } { "a": 1 then '), "props", F.lit(' and {"late": 1}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{not json} ```{"s": "}{ \\" {", "k": 7}``` '), own))
    noise = noise.when(F.col("event_id") % 4 == 2, F.concat(F.lit("[1, 2] } {"), own)).otherwise(F.concat(F.lit('{"open": {bad} {"n": {"k": 2}, "k": '), own, F.lit("}")))
    found = table(spark, sf_dir, "events").select("event_id", first_object(noise).alias("o"))
    return found.select("event_id", F.get_json_object("o", "$.k").alias("k"))


_TURNS = "select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as t, role from {conversations}"


@register(
    "sections_by_depth",
    f"""with t as ({_TURNS.format(conversations="conversations")}), n as (select conv_id, count(*) filter (t % 2 = 0) as one, count(*) filter (t % 2 = 1) as two from t group by 1),
    d as (select conv_id, case when one >= 3 then 1 when two >= 3 then 2 else 1 end as depth from n)
    select conv_id, 'turn ' || min(t) as title, string_agg(case when t % 2 = 0 then '# ' else '## ' end || 'turn ' || t || chr(10) || role, chr(10) order by t) as content from (select *, case when depth = 2 then t else t // 2 end as section from t join d using (conv_id)) where depth = 1 or t % 2 = 1 group by conv_id, section, depth""",
)
def sections_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown, even turns above odd ones, split at the shallowest depth with three headings."""
    turns = spark.sql(_TURNS, conversations=table(spark, sf_dir, "conversations").withColumn("role", F.coalesce("role", F.lit(""))))
    line = F.concat(F.when(F.col("t") % 2 == 0, "# ").otherwise("## "), F.lit("turn "), F.col("t").cast("string"), F.lit("\n"), "role")
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return depth_sections(texts, "conv_id", "text").select("conv_id", "title", "content")


@register("large_pieces")
def pieces_of_large_texts(spark: SparkSession, sf_dir: str, most: int = 2000) -> DataFrame:
    """Spans of every document, none above 2000 characters, cut at headings, then paragraphs, then lines; they join to the text."""
    return large_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", most).select("doc_id", "no", "start", "end", F.md5("piece").alias("piece_md5"))
