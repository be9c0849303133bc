"""Context packing, confidence, overlays, incremental loads, time windows and dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import text as T
from ..functions.text import token_estimate
from ..operators import compression, overlay, packing
from ..registry import register
from ..tables import table

SLOTS = {"user": 600, "assistant": 900, "system": 200}
WEIGHTS = {"quality": 25, "long": 25, "short_tail": 15, "toxic": -15}


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    score = (F.length("text") % 97).cast("double")
    return turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("item_id"), F.col("role").alias("slot"), score.alias("score"), token_estimate(F.col("text")).alias("tokens"))


@register("slot_budget_pack")
def slot_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_items(spark, sf_dir), SLOTS, 1500)


@register(
    "running_budget",
    """with i as (select conv_id, turn, case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end as tokens from conversations),
    r as (select *, 400 - coalesce(sum(tokens) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as room from i)
    select conv_id, turn, least(tokens, room)::bigint as admitted from r where least(tokens, room) > 0""",
)
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumnRenamed("item_id", "step")
    return packing.running_budget(items, 400).select(F.col("query_id").alias("conv_id"), F.col("step").alias("turn"), "admitted")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("_n")).join(table(spark, sf_dir, "labels"), "doc_id")
    pair = lambda name, flag, share: F.struct(F.lit(name).alias("signal"), flag.alias("bool_value"), share.alias("num_value"))
    none, no_flag = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    each = F.array(pair("quality", F.col("quality") == 1, none), pair("long", no_flag, F.col("_n") / 4000.0), pair("short_tail", F.col("_n") < 500, none), pair("toxic", F.col("toxic") == 1, none), pair("unknown", F.lit(True), none))
    return docs.select(F.col("doc_id").alias("response_id"), F.explode(each).alias("_s")).select("response_id", "_s.*")


_CONFIDENCE = """with s as (select doc_id, greatest(0, least(100, 20 + case when quality = 1 then 25 else 0 end + trunc(25 * least(1.0, length(text) / 4000.0))::int + case when length(text) < 500 then 15 else 0 end
    - case when toxic = 1 then 15 else 0 end)) as score from documents join labels using (doc_id)), r as (select doc_id, score::bigint as score, case when score >= 80 then 'AUTO' when score >= 50 then 'QUICK' else 'FULL' end as route from s) """


@register("confidence_score", _CONFIDENCE + "select doc_id as response_id, score, route from r")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.confidence(_signals(spark, sf_dir), WEIGHTS)


@register("review_routing", _CONFIDENCE + "select route, count(*) as n, round(avg(score), 4) as mean_score from r group by 1")
def review_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence_score(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth order is changed, every fiftieth deleted, and as many are new."""
    own = _orders(spark, sf_dir).filter(F.col("o_orderkey") % 10 == 0)
    changed = own.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"), (F.col("o_orderkey") % 50 == 0).alias("deleted"))
    return changed.unionByName(own.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit(False).alias("deleted")))


_OVERLAY = """with p as (select o_orderkey, o_orderstatus, o_totalprice from orders),
    o as (select o_orderkey, 'X' as s, null::double as t, o_orderkey % 50 = 0 as deleted from p where o_orderkey % 10 = 0 union all select -o_orderkey - 1, 'N', 1.0, false from p where o_orderkey % 10 = 0) """


@register(
    "overlay_shadow",
    _OVERLAY + """select coalesce(o.o_orderkey, p.o_orderkey) as o_orderkey, coalesce(s, o_orderstatus) as o_orderstatus, coalesce(t, o_totalprice) as o_totalprice,
    case when o.o_orderkey is null then 'production' when p.o_orderkey is null then 'overlay' else 'shadow' end as origin from p full join o on o.o_orderkey = p.o_orderkey where not coalesce(deleted, false)""",
)
def overlay_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.shadow(_orders(spark, sf_dir), _overlay(spark, sf_dir), "o_orderkey")


@register(
    "overlay_diff",
    _OVERLAY + """, a as (select coalesce(o.o_orderkey, p.o_orderkey) as k, coalesce(s, o_orderstatus) as s2, coalesce(t, o_totalprice) as t2 from p full join o on o.o_orderkey = p.o_orderkey where not coalesce(deleted, false))
    select case when o_orderkey is null then 'added' when k is null then 'removed' when s2 is not distinct from o_orderstatus and t2 is not distinct from o_totalprice then 'unchanged' else 'modified' end as change, count(*) as n from p full join a on k = o_orderkey group by 1""",
)
def overlay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _orders(spark, sf_dir)
    return overlay.diff(before, overlay_shadow(spark, sf_dir).drop("origin"), "o_orderkey").groupBy("change").agg(F.count("*").alias("n"))


@register("overlay_delete", _OVERLAY + "select o_orderkey from p where o_orderkey not in (select o_orderkey from o where deleted)")
def overlay_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _overlay(spark, sf_dir).filter("deleted").select("o_orderkey")
    return _orders(spark, sf_dir).select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@register(
    "incremental_delta",
    """with n as (select o_orderkey as k, md5(o_orderstatus || o_totalprice::bigint) as h from orders where o_orderkey % 20 <> 0),
    b as (select o_orderkey as k, md5(case when o_orderkey % 7 = 0 then 'old' else o_orderstatus end || o_totalprice::bigint) as h from orders where o_orderkey % 11 <> 0)
    select case when b.k is null then 'ADDED' when n.k is null then 'DELETED' when n.h <> b.h then 'MODIFIED' else 'UNCHANGED' end as change_type, count(*) as n from n full join b on n.k = b.k group by 1""",
)
def incremental_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots compared by key and content hash."""
    orders = table(spark, sf_dir, "orders")
    price = F.floor(F.col("o_totalprice") + 0.5).cast("long").cast("string")
    snap = lambda df, status: df.select(F.col("o_orderkey").alias("path"), F.md5(F.concat(status, price)).alias("content_hash"))
    new = snap(orders.filter(F.col("o_orderkey") % 20 != 0), F.col("o_orderstatus"))
    old = snap(orders.filter(F.col("o_orderkey") % 11 != 0), F.when(F.col("o_orderkey") % 7 == 0, F.lit("old")).otherwise(F.col("o_orderstatus")))
    names = F.create_map(*(F.lit(x) for x in ("added", "ADDED", "removed", "DELETED", "modified", "MODIFIED", "unchanged", "UNCHANGED")))
    return overlay.diff(old, new, "path").groupBy(F.element_at(names, F.col("change")).alias("change_type")).agg(F.count("*").alias("n"))


@register("deletion_detect", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def deletion_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known keys that the newest load no longer has."""
    seen = table(spark, sf_dir, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@register(
    "merge_nodes",
    """with u as (select c_custkey + 1000 as k, case when c_custkey % 2 = 0 then c_name end as n, c_acctbal + 1 as b from customer)
    select coalesce(c_custkey, k) as c_custkey, coalesce(n, c_name) as c_name, round(coalesce(b, c_acctbal), 2) as c_acctbal from customer full join u on k = c_custkey""",
)
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    updates = own.select((F.col("c_custkey") + 1000).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return overlay.merge(own, updates, "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


@register("merge_edges", "select l_suppkey, count(*) as n_edges from (select distinct l_partkey, l_suppkey from lineitem) group by 1")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged by their ends: repeated relations count once."""
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("n_edges"))


@register(
    "rate_limit_moving_window",
    """select event_id, user_id, n_hour::bigint as n_hour, n_hour > 2 as limited from (select event_id, user_id, count(*) over (partition by user_id, event_type order by ts range between interval 3600 seconds preceding and current row) as n_hour from events)""",
)
def rate_limit_moving_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one key and tool in the hour up to each call; the limit is two."""
    return spark.sql(
        """select event_id, user_id, n_hour, n_hour > 2 as limited from (select event_id, user_id,
        count(*) over (partition by user_id, event_type order by ts range between interval 3600 seconds preceding and current row) as n_hour from {events})""",
        events=table(spark, sf_dir, "events"),
    )


@register("per_minute_volume", "select time_bucket(interval '1 minute', ts) as minute, count(*) as n, round(sum(value), 4) as total from events group by 1")
def per_minute_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register(
    "session_ttl",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '1 hour' then 0 else 1 end as opens from events),
    s as (select user_id, ts, sum(opens) over (partition by user_id order by ts, opens desc rows unbounded preceding) as k from g)
    select user_id, min(ts) as started, max(ts) as last_seen, count(*) as n from s group by user_id, k""",
)
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end an hour after their last event."""
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    return sessions.select("user_id", "started", "last_seen", "n")


@register(
    "latency_percentiles",
    "select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted by value first, so a hot type's percentiles weigh its distinct values."""
    counted = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("_n"))
    at = lambda q: F.round(F.percentile("value", q, F.col("_n")), 6)
    return counted.groupBy("event_type").agg(F.sum("_n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


_EDGES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 100.0]


@register("latency_histogram", "select event_type, " + " + ".join(f"(value > {e})::int" for e in _EDGES) + " as bucket, count(*) as n from events group by 1, 2")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = sum(((F.col("value") > e).cast("int") for e in _EDGES), F.lit(0))
    return table(spark, sf_dir, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@register("job_progress", "select user_id, count(*) as n, round(100.0 * count(*) filter (event_type = 'purchase') / count(*), 1) as percent_done from events group by 1")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("event_type") == "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(100.0 * done / F.count("*"), 1).alias("percent_done"))


@register("extractive_compression")
def extractive_compression(spark: SparkSession, sf_dir: str, most: int = 5, budget: int = 4000) -> DataFrame:
    """Each document's best sentences in their own order, and what of these fits one budget a language, in order of the ids."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return packing.take_in_order(cut(compression.compressed(docs, most, ("the",))), budget)


@register("single_queue_pack")
def single_queue_pack(spark: SparkSession, sf_dir: str, budget: int = 3000) -> DataFrame:
    """One queue for each source, shortest documents first."""
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull())
    items = docs.select(F.col("source").alias("query_id"), "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    order = F.format_string("%012d-%012d", "tokens", "doc_id")
    return packing.take_in_order(items.withColumn("place", order), budget, order="place").select("query_id", "doc_id", "tokens")
