"""Fusion variants, stores, sections, checks and reports over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import overlay
from ..operators.components import components
from ..registry import register
from ..sources import exports
from ..tables import table
from .typed_graph import sql_graph, typed_graph

C = F.col
_A = sql_graph("A")

_HITS = """h as (select doc_id, case when doc_id % 3 = 0 then ' Head ' || doc_id % 40 || ' ' else '' end as heading, text, doc_id % 2 = 1 as graph, case when doc_id % 2 = 0 then (doc_id % 97) / 97.0 else (doc_id % 89) / 50.0 end as score from documents where text is not null)"""
_FUSED = "select md5(key) as key_md5, round(coalesce(v, 0) * 0.4 + coalesce(g, 0) * 0.6, 6) as score, case when v is not null and g is not null then 'hybrid' when g is null then 'vector' else 'graph' end as origin from f"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C("doc_id")
    heading = F.when(n % 3 == 0, F.concat(F.lit(" Head "), (n % 40).cast("string"), F.lit(" "))).otherwise("")
    score = F.when(n % 2 == 0, (n % 97) / 97.0).otherwise((n % 89) / 50.0)
    return table(spark, sf_dir, "documents").filter(C("text").isNotNull()).select(n, heading.alias("heading"), "text", (n % 2 == 1).alias("graph"), score.alias("score"))


def fuse(hits: DataFrame, key: Column, alpha: float = 0.6) -> DataFrame:
    """Blend of two lists that meet by ``key``: the best of the vector list's copies, the sum of the graph list's."""
    both = hits.groupBy(key.alias("_key")).agg(F.max(F.when(~C("graph"), C("score"))).alias("v"), F.sum(F.when(C("graph"), C("score"))).alias("g"))
    score = F.coalesce("v", F.lit(0.0)) * (1 - alpha) + F.coalesce("g", F.lit(0.0)) * alpha
    origin = F.when(C("v").isNotNull() & C("g").isNotNull(), "hybrid").when(C("g").isNull(), "vector").otherwise("graph")
    return both.select(F.md5("_key").alias("key_md5"), F.round(score, 6).alias("score"), origin.alias("origin"))


@register(
    "fuse_strict",
    f"with {_HITS}, m as (select graph, max(score) as top from h group by 1), k as (select graph, case when top > 0 then score / top else score end as score, substr(trim(lower(coalesce(nullif(heading, ''), substr(text, 1, 40)))), 1, 120) as key from h join m using (graph)), f as (select key, max(score) filter (not graph) as v, sum(score) filter (graph) as g from k group by 1) {_FUSED}",
)
def fuse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists divided by their maximum, then blended by heading (or the text's beginning), whatever its case."""
    hits = _hits(spark, sf_dir)
    top = F.broadcast(hits.groupBy("graph").agg(F.max("score").alias("_top")))
    scaled = hits.join(top, "graph").withColumn("score", F.when(C("_top") > 0, C("score") / C("_top")).otherwise(C("score")))
    return fuse(scaled, F.substring(F.trim(F.lower(F.coalesce(F.nullif("heading", F.lit("")), F.substring("text", 1, 40)))), 1, 120))


@register("fuse_relaxed", f"with {_HITS}, k as (select graph, score, coalesce(nullif(heading, ''), substr(text, 1, 40)) as key from h), f as (select key, max(score) filter (not graph) as v, sum(score) filter (graph) as g from k group by 1) {_FUSED}")
def fuse_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw blend; keys keep their case."""
    return fuse(_hits(spark, sf_dir), F.coalesce(F.nullif("heading", F.lit("")), F.substring("text", 1, 40)))


@register("score_normalise", "select o_orderkey, round(case when m > 0 then (o_totalprice - 50000) / m else o_totalprice - 50000 end, 6) as score from orders join (select o_orderpriority as p, max(o_totalprice - 50000) as m from orders group by 1) on p = o_orderpriority")
def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by their list's maximum, unchanged where it is not positive; the maximum is an aggregate, so no list is gathered."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (C("o_totalprice") - 50000).alias("_s"))
    top = F.broadcast(rows.groupBy("o_orderpriority").agg(F.max("_s").alias("_m")))
    return rows.join(top, "o_orderpriority").select("o_orderkey", F.round(F.when(C("_m") > 0, C("_s") / C("_m")).otherwise(C("_s")), 6).alias("score"))


@register(
    "overlay_hybrid_search",
    """with d as (select doc_id, 'dir/File_' || doc_id % 30 || '.C' as file, n_chars / 1000.0 as s from documents), o as (select * from d where doc_id % 30 < 3 and doc_id % 60 < 30),
    u as (select doc_id, s, 'overlay' as origin from o union all select doc_id, s * 0.9, 'production' from d where lower(split_part(file, '/', 2)) not in (select lower(split_part(file, '/', 2)) from o))
    select doc_id, round(s, 6) as score, origin from u order by s desc, doc_id limit 50""",
)
def overlay_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay hits, and production hits at nine tenths of their score unless their file (by lower-cased base name) was uploaded anew."""
    n = C("doc_id")
    docs = table(spark, sf_dir, "documents").select(n, F.concat(F.lit("dir/File_"), (n % 30).cast("string"), F.lit(".C")).alias("file"), (C("n_chars") / 1000.0).alias("_s"))
    base = F.lower(F.element_at(F.split("file", "/"), -1))
    over = docs.filter((n % 30 < 3) & (n % 60 < 30))
    prod = docs.withColumn("_f", base).join(over.select(base.alias("_f")).distinct(), "_f", "left_anti")
    both = over.select("doc_id", "_s", F.lit("overlay").alias("origin")).union(prod.select("doc_id", C("_s") * 0.9, F.lit("production")))
    return both.orderBy(F.desc("_s"), "doc_id").limit(50).select("doc_id", F.round("_s", 6).alias("score"), "origin")


@register("pattern_usage", "select p_partkey, p_size + count(l_partkey) as usage_count from part left join lineitem on l_partkey = p_partkey and l_returnflag = 'R' group by p_partkey, p_size")
def pattern_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counters raised by what was used: counted first, then one keyed update."""
    used = table(spark, sf_dir, "lineitem").filter(C("l_returnflag") == "R").groupBy(C("l_partkey").alias("p_partkey")).agg(F.count("*").alias("_n"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left").select("p_partkey", (C("p_size") + F.coalesce("_n", F.lit(0))).alias("usage_count"))


@register("top_patterns", "select p_partkey, p_size as usage_count from part where p_size >= 40 order by p_size desc, p_partkey limit 25")
def top_patterns(spark: SparkSession, sf_dir: str, least: int = 40) -> DataFrame:
    return table(spark, sf_dir, "part").filter(C("p_size") >= least).select("p_partkey", C("p_size").alias("usage_count")).orderBy(F.desc("usage_count"), "p_partkey").limit(25)


# What the suffix of a collection's name says about its nodes.
COLLECTION_KINDS = (("_requirements", "Requirement"), ("_tests", "TestCase"), ("_code", "Function"), ("_hw", "Register"))
_COLLECTIONS = "c as (select distinct 'rag_' || lower(c_mktsegment) || case c_custkey % 5 when 0 then '_requirements' when 1 then '_tests' when 2 then '_code' when 3 then '_hw' else '_misc' end as name from customer)"


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey") % 5
    suffix = F.when(k == 0, "_requirements").when(k == 1, "_tests").when(k == 2, "_code").when(k == 3, "_hw").otherwise("_misc")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("rag_"), F.lower("c_mktsegment"), suffix).alias("name")).distinct()


@register("collection_resolution", f"with {_COLLECTIONS} select name from c where starts_with(name, 'rag_building_')")
def collection_resolution(spark: SparkSession, sf_dir: str, module: str = "BUILDING") -> DataFrame:
    """The collections of a module, by the naming rule."""
    return _collections(spark, sf_dir).filter(C("name").startswith(f"rag_{module.lower()}_"))


@register("collection_node_type", f"with {_COLLECTIONS} select name, case " + " ".join(f"when ends_with(name, '{s}') then '{k}'" for s, k in COLLECTION_KINDS) + " else 'Document' end as node_type from c")
def collection_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = reduce(lambda rest, x: F.when(C("name").endswith(x[0]), x[1]).otherwise(rest), reversed(COLLECTION_KINDS), F.lit("Document"))
    return _collections(spark, sf_dir).select("name", kind.alias("node_type"))


@register("metadata_delete", "select doc_id from documents where not coalesce(lang = 'de' and n_chars > 500, false)")
def metadata_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that match all filters go; a null never matches."""
    return table(spark, sf_dir, "documents").filter(~F.coalesce((C("lang") == "de") & (C("n_chars") > 500), F.lit(False))).select("doc_id")


@register("vector_upsert", "select vec_id, case when vec_id % 10 = 0 then label + 100 else label end as label from embeddings union all select max(vec_id) + 1, 7 from embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions replace points of the same id, new ids are added."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    fresh = own.filter(C("vec_id") % 10 == 0).select("vec_id", (C("label") + 100).cast("int").alias("label")).union(own.agg((F.max("vec_id") + 1).alias("vec_id"), F.lit(7).alias("label")))
    return overlay.merge(own, fresh, "vec_id")


@register("vector_export", "select (row_number() over (order by vec_id, label) - 1) // 100 as page, (row_number() over (order by vec_id, label) - 1) % 100 as place, vec_id, label, len(embedding) as n_dimensions from embeddings")
def vector_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its scroll page and its place there, a hundred to a page in order of the ids; :func:`exports.write_pages` writes such pages to files."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("n_dimensions"))
    return exports.paged(rows, [F.asc("vec_id"), F.asc("label")], 100).select("page", "place", "vec_id", "label", "n_dimensions")


@register("cascade_delete", _A + ", gone as (select id from n where label = 'EA_SourceFile' or module = 'M4') select rel, count(*) as n from e where src not in (select id from gone) and dst not in (select id from gone) group by 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of the relationships when nodes of deleted files go."""
    g = typed_graph(spark, sf_dir, "A")
    gone = g.nodes.filter((C("label") == "EA_SourceFile") | (C("module") == "M4")).select("id")
    left = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left.groupBy("rel").agg(F.count("*").alias("n"))


_NUMBER = "case p_partkey % 4 when 0 then p_partkey % 3 || '' when 1 then p_partkey % 3 || '.' || p_partkey % 5 when 2 then p_partkey % 3 || '.' || p_partkey % 5 || '.' || p_size % 4 else p_partkey % 3 || '.' || p_partkey % 5 || '.' || p_size % 4 || '.' || p_size end"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``number, content``: numbered sections up to four levels deep."""
    part = lambda n: [(C("p_partkey") % 3), (C("p_partkey") % 5), (C("p_size") % 4), C("p_size")][: n + 1]
    number = reduce(lambda rest, k: F.when(C("p_partkey") % 4 == k, F.concat_ws(".", *(x.cast("string") for x in part(k)))).otherwise(rest), range(4), F.lit(""))
    return table(spark, sf_dir, "part").select(number.alias("number"), "p_name").groupBy("number").agg(F.min("p_name").alias("content"))


@register(
    "deep_rollup",
    f"""with s as (select {_NUMBER} as number, min(p_name) as content from part group by 1), d as (select number, content from s where len(string_split(number, '.')) > 3),
    a as (select d.number, d.content, max_by(s.number, length(s.number)) as up from d join s on starts_with(d.number, s.number || '.') and len(string_split(s.number, '.')) <= 3 group by 1, 2)
    select s.number, md5(s.content || coalesce(string_agg(chr(10) || a.number || ' ' || a.content, '' order by a.number), '')) as content_md5 from s left join a on a.up = s.number where s.number not in (select number from a) group by s.number, s.content""",
)
def deep_rollup(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Sections deeper than ``most`` levels are appended to their nearest ancestor that is not; without one they stay."""
    sections = _sections(spark, sf_dir).withColumn("_p", F.split("number", r"\."))
    ups = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.array_join(F.slice("_p", F.lit(1), n), "."))
    deep = sections.filter(F.size("_p") > most).select("number", "content", F.explode(ups).alias("up"))
    known = sections.filter(F.size("_p") <= most).select(C("number").alias("up"))
    near = deep.join(known, "up").groupBy("number", "content").agg(F.max_by("up", F.length("up")).alias("up"))
    added = near.groupBy("up").agg(F.array_sort(F.collect_list(F.struct("number", "content"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("\n"), x["number"], F.lit(" "), x["content"])), "")
    kept = sections.join(near.select("number"), "number", "left_anti").join(added.withColumnRenamed("up", "number"), "number", "left")
    return kept.select("number", F.md5(F.concat("content", F.coalesce(text, F.lit("")))).alias("content_md5"))


# Sections to collections by the beginning of their number; the first match wins.
ROUTES = (("1", "overview"), ("2.1", "interfaces"), ("2", "design"), ("0.3", "safety"))


@register("section_routing", f"with s as (select distinct {_NUMBER} as number from part) select number, case " + " ".join(f"when starts_with(number, '{p}') then '{c}'" for p, c in ROUTES) + " else 'general' end as collection from s")
def section_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = reduce(lambda rest, x: F.when(C("number").startswith(x[0]), x[1]).otherwise(rest), reversed(ROUTES), F.lit("general"))
    return _sections(spark, sf_dir).select("number", route.alias("collection"))


@register("leaf_sections", f"with s as (select distinct {_NUMBER} as number from part) select number from s where len(string_split(number, '.')) <= 4 and not exists (select 1 from s t where starts_with(t.number, s.number || '.') and len(string_split(t.number, '.')) = len(string_split(s.number, '.')) + 1)")
def leaf_sections(spark: SparkSession, sf_dir: str, most: int = 4) -> DataFrame:
    """Sections of at most ``most`` levels that have no subsection of their own: an anti join with the parents of all sections."""
    sections = _sections(spark, sf_dir).select("number")
    parents = sections.select(F.regexp_extract("number", r"^(.*)\.[^.]*$", 1).alias("number")).filter("number <> ''").distinct()
    return sections.filter(F.size(F.split("number", r"\.")) <= most).join(parents, "number", "left_anti")


@register("metadata_coercion", "select doc_id, array_to_string(list_filter([case when lang is not null then 'lang=' || lang end, case when source is not null then 'source=' || source end, case when n_chars is not null then 'n_chars=' || n_chars end], lambda x: x is not null), ';') as metadata from documents")
def metadata_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as text values, nulls left out."""
    rows = table(spark, sf_dir, "documents")
    pair = lambda k: F.concat(F.lit(f"{k}="), C(k).cast("string"))
    return rows.select("doc_id", F.concat_ws(";", pair("lang"), pair("source"), pair("n_chars")).alias("metadata"))


@register("chunk_record", "select doc_id, regexp_replace(lower('docs/' || coalesce(source, '') || '#' || doc_id), '[^a-z0-9]+', '_', 'g') || '_' || substr(md5(coalesce(text, '')), 1, 10) as chunk_id, coalesce(lang, 'none') as collection, length(coalesce(text, '')) // 4 as tokens from documents")
def chunk_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    path = F.regexp_replace(F.lower(F.concat(F.lit("docs/"), F.coalesce("source", F.lit("")), F.lit("#"), C("doc_id").cast("string"))), "[^a-z0-9]+", "_")
    return docs.select("doc_id", F.concat_ws("_", path, F.substring(F.md5("text"), 1, 10)).alias("chunk_id"), F.coalesce("lang", F.lit("none")).alias("collection"), F.floor(F.length("text") / 4).alias("tokens"))


@register(
    "initializer_text",
    """with f as (select distinct p_brand as struct, 'f' || p_size as field from part), o as (select distinct p_brand as struct, 'f' || p_partkey % 60 as field, p_partkey % 60 as v from part where p_partkey % 3 = 0)
    select f.struct, f.struct || ' cfg = { ' || string_agg('.' || f.field || ' = ' || coalesce(o.v, 0), ', ' order by f.field) || ' };' as code, (select count(*) from o r where r.struct = f.struct and not exists (select 1 from f g where g.struct = r.struct and g.field = r.field)) as n_rejected
    from f left join o on o.struct = f.struct and o.field = f.field group by f.struct""",
)
def initializer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their overrides as an initializer; overrides of unknown fields are counted as rejected."""
    part = table(spark, sf_dir, "part")
    fields = part.select(C("p_brand").alias("struct"), F.concat(F.lit("f"), C("p_size").cast("string")).alias("field")).distinct()
    given = part.filter(C("p_partkey") % 3 == 0).select(C("p_brand").alias("struct"), F.concat(F.lit("f"), (C("p_partkey") % 60).cast("string")).alias("field"), (C("p_partkey") % 60).alias("v")).distinct()
    lines = fields.join(given, ["struct", "field"], "left").groupBy("struct").agg(F.array_sort(F.collect_list(F.struct("field", F.coalesce("v", F.lit(0)).cast("string").alias("v")))).alias("_l"))
    rejected = given.join(fields, ["struct", "field"], "left_anti").groupBy("struct").agg(F.count("*").alias("_n"))
    body = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("."), x["field"], F.lit(" = "), x["v"])), ", ")
    return lines.join(rejected, "struct", "left").select("struct", F.concat("struct", F.lit(" cfg = { "), body, F.lit(" };")).alias("code"), F.coalesce("_n", F.lit(0)).alias("n_rejected"))


_MEMBERS = "m as (select 'T' || p_partkey % 50 as owner, 'f' || p_partkey % 7 as field, min('T' || p_size % 50) as kind from part group by 1, 2)"


@register("chain_resolution", f"with {_MEMBERS}, r as (select distinct owner as root from m) select root, c.kind as resolved from r join m a on a.owner = root and a.field = 'f1' join m b on b.owner = a.kind and b.field = 'f2' join m c on c.owner = b.kind and c.field = 'f3'")
def chain_resolution(spark: SparkSession, sf_dir: str, chain: tuple[str, ...] = ("f1", "f2", "f3")) -> DataFrame:
    """The type that a chain of member accesses ends in: one join for each link."""
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    members = table(spark, sf_dir, "part").groupBy(text("T", C("p_partkey") % 50).alias("owner"), text("f", C("p_partkey") % 7).alias("field")).agg(F.min(text("T", C("p_size") % 50)).alias("kind"))
    rows = members.select(C("owner").alias("root"), "owner").distinct()
    for field in chain:
        rows = rows.join(members.filter(C("field") == field), "owner").select("root", C("kind").alias("owner"))
    return rows.select("root", C("owner").alias("resolved"))


@register("failure_patterns", "select event_id, ts, user_id from events where event_type = 'error' and user_id % 2 = 1 order by ts desc, event_id desc limit 20")
def failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty failures of a category, newest first."""
    return table(spark, sf_dir, "events").filter((C("event_type") == "error") & (C("user_id") % 2 == 1)).select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@register("audit_query", "select event_id, ts, event_type from events where event_type = 'purchase' order by ts desc, event_id desc limit 50")
def audit_query(spark: SparkSession, sf_dir: str, tool: str = "purchase", most: int = 50) -> DataFrame:
    return table(spark, sf_dir, "events").filter(C("event_type") == tool).select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


@register("learning_metrics", "select count(*) as n_reviews, round(count(*) filter (event_type = 'purchase') / count(*), 3) as approval_rate, round(count(*) filter (event_type = 'error') / count(*), 3) as rejection_rate from events where event_type in ('purchase', 'error', 'click')")
def learning_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "events").filter(C("event_type").isin("purchase", "error", "click"))
    rate = lambda kind: F.round(F.count_if(C("event_type") == kind) / F.count("*"), 3)
    return reviews.agg(F.count("*").alias("n_reviews"), rate("purchase").alias("approval_rate"), rate("error").alias("rejection_rate"))


@register("feedback_outcomes", "select user_id, count(*) filter (event_type = 'purchase') as patterns, count(*) filter (event_type = 'error') as failures, max(ts) as last_review from events where event_type in ('purchase', 'error') group by 1")
def feedback_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid decisions only: what is approved becomes a pattern, what is rejected a failure pattern."""
    valid = table(spark, sf_dir, "events").filter(C("event_type").isin("purchase", "error"))
    return valid.groupBy("user_id").agg(F.count_if(C("event_type") == "purchase").alias("patterns"), F.count_if(C("event_type") == "error").alias("failures"), F.max("ts").alias("last_review"))


@register("result_processing", "select l_partkey % 10 as module, count(*) as total, count(*) filter (l_returnflag = 'A') as passed, count(*) filter (l_returnflag = 'R') as failed, count(*) filter (l_returnflag = 'N') as skipped, round(100.0 * count(*) filter (l_returnflag = 'A') / count(*), 2) as pass_rate from lineitem group by 1")
def result_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test results by module: totals by status and the pass rate."""
    of = lambda flag: F.count_if(C("l_returnflag") == flag)
    return table(spark, sf_dir, "lineitem").groupBy((C("l_partkey") % 10).alias("module")).agg(F.count("*").alias("total"), of("A").alias("passed"), of("R").alias("failed"), of("N").alias("skipped"), F.round(100.0 * of("A") / F.count("*"), 2).alias("pass_rate"))


@register("build_results", "select o_orderpriority as suite, count(*) as n_cases, count(*) filter (o_orderstatus = 'F') as n_failed, round(sum(o_totalprice), 2) as duration from orders group by 1")
def build_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suite totals and durations of a build."""
    return table(spark, sf_dir, "orders").groupBy(C("o_orderpriority").alias("suite")).agg(F.count("*").alias("n_cases"), F.count_if(C("o_orderstatus") == "F").alias("n_failed"), F.round(F.sum("o_totalprice"), 2).alias("duration"))


@register("stream_metrics", "select user_id, epoch_us(min(ts) filter (event_type = 'click') - min(ts)) as first_us, epoch_us(max(ts) - min(ts)) as total_us, count(*) as n from events group by 1")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to the first token (here: click) and in all, for every stream (here: user)."""
    micros = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    rows = table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp")).groupBy("user_id")
    return rows.agg(micros(F.min(F.when(C("event_type") == "click", C("ts"))), F.min("ts")).alias("first_us"), micros(F.max("ts"), F.min("ts")).alias("total_us"), F.count("*").alias("n"))


@register("entity_validation", _A + "select id, case when label not in ('EA_Function', 'EA_Register', 'ProductRequirement', 'StakeholderRequirement', 'MCALModule') then 'unknown type' when key is null and label like '%Requirement' then 'missing identifier' end as issue from n where label not in ('EA_Function', 'EA_Register', 'ProductRequirement', 'StakeholderRequirement', 'MCALModule') or (key is null and label like '%Requirement')")
def entity_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all entities: a type that the catalogue has not, or no identifier where the type needs one."""
    known = ("EA_Function", "EA_Register", "ProductRequirement", "StakeholderRequirement", "MCALModule")
    issue = F.when(~C("label").isin(*known), "unknown type").when(C("key").isNull() & C("label").endswith("Requirement"), "missing identifier")
    return typed_graph(spark, sf_dir, "A").nodes.select("id", issue.alias("issue")).filter(C("issue").isNotNull())


@register(
    "community_detection",
    _A.replace("with ", "with recursive ", 1) + """, s as (select src, dst from e join n a on a.id = src join n b on b.id = dst where rel in ('EA_AGGREGATES', 'EA_EXTERNAL_DEP') and src <> dst), b as (select * from s union select dst, src from s),
    w as (select src as node, src as seen from b union select w.node, b.dst from w join b on b.src = w.seen), c as (select node, min(seen) as community from w group by 1) select community, count(*) as n from c group by 1 having count(*) >= 3""",
)
def community_detection(spark: SparkSession, sf_dir: str, min_size: int = 3) -> DataFrame:
    """Clusters of linked nodes (connected components), of at least ``min_size`` members."""
    g = typed_graph(spark, sf_dir, "A")
    ids = g.nodes.select("id")
    links = g.edges.filter(C("rel").isin("EA_AGGREGATES", "EA_EXTERNAL_DEP")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return components(links, "src", "dst").groupBy(C("component").alias("community")).agg(F.count("*").alias("n")).filter(C("n") >= min_size)


@register("hierarchy_edges", f"with s as (select distinct {_NUMBER} as number from part) select c.number as child, p.number as parent from s c join s p on p.number = regexp_replace(c.number, '\\.[^.]*$', '') where contains(c.number, '.')")
def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHILD_OF edges: the parent's sequence is the child's without its last segment."""
    sections = _sections(spark, sf_dir).select("number")
    children = sections.filter(C("number").contains(".")).select(C("number").alias("child"), F.regexp_replace("number", r"\.[^.]*$", "").alias("parent"))
    return children.join(sections.select(C("number").alias("parent")), "parent").select("child", "parent")


@register("module_derivation", "select split_part(p_brand, '#', 1) || '#' || substr(split_part(p_brand, '#', 2), 1, 1) as module, count(*) as n from part group by 1")
def module_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules derived from the distinct prefixes of names, with their counts."""
    return table(spark, sf_dir, "part").groupBy(F.regexp_extract("p_brand", "^([^#]*#.)", 1).alias("module")).agg(F.count("*").alias("n"))


@register("next_edges", f"with s as (select distinct {_NUMBER} as number from part), k as (select number, lead(number) over (partition by split_part(number, '.', 1) order by number) as next from s) select number as src, next as dst from k where next is not null")
def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT edges between the sections of a chapter, in order."""
    chapter = Window.partitionBy(F.split("number", r"\.")[0]).orderBy("number")
    return _sections(spark, sf_dir).select(C("number").alias("src"), F.lead("number").over(chapter).alias("dst")).filter("dst is not null")
