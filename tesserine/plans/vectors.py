"""Nearest neighbours and the fusion of ranked lists.

The queries are all rows whose id is divisible by ``EVERY``, searched for among all
rows: packed blocks of queries meet packed blocks of vectors (``operators.nearest``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.nearest import nearest
from ..registry import register
from ..tables import table

EVERY = 50
K_RRF = 60


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter(F.col("vec_id") % EVERY == 0)


def best(spark: SparkSession, sf_dir: str, k: int, *by: str, among: DataFrame | None = None) -> DataFrame:
    """``query_id, vec_id, label, score, rank``: the ``k`` best of each group among the vectors, without the query itself."""
    every = points(spark, sf_dir)
    return top(nearest(every if among is None else among, query_points(spark, sf_dir), k, "label" in by), k, *by)


_SCORED = """s as (select q.vec_id as query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score
    from embeddings e, embeddings q where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)"""


def top(df: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` best of each group by score, then id, with their rank; the window's group limit runs before the shuffle."""
    window = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


@register("knn_cosine", f"with {_SCORED} select query_id, vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, 10, "query_id").select("query_id", "vec_id", "score")


@register("knn_filtered", f"with {_SCORED} select query_id, vec_id, label, score from s where label in (1, 2, 3) qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, 10, "query_id", among=points(spark, sf_dir).filter(F.col("label").isin(1, 2, 3))).select("query_id", "vec_id", F.col("label").cast("int").alias("label"), "score")


@register("knn_threshold", f"with {_SCORED} select query_id, vec_id, score from s where score >= 0.3 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, 5, "query_id").filter(F.col("score") >= 0.3).select("query_id", "vec_id", "score")


@register("knn_multi_collection", f"with {_SCORED} select query_id, label, vec_id, greatest(0, score) as score from s qualify row_number() over (partition by query_id, label order by score desc, vec_id) <= 4")
def knn_multi_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many of each collection as are wanted, negative similarities as 0."""
    return best(spark, sf_dir, 4, "query_id", "label").select("query_id", F.col("label").cast("int").alias("label"), "vec_id", F.greatest(F.lit(0.0), "score").alias("score"))


@register(
    "semantic_cache_probe",
    f"with {_SCORED}, best as (select query_id, vec_id, score from s where label = query_id % 3 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 1) select *, score >= 0.95 as hit from best",
)
def semantic_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entry with exactly matching metadata, and whether it is close enough to be served."""
    same = best(spark, sf_dir, 1, "query_id", "label").filter(F.col("label") == F.col("query_id") % 3)
    return same.select("query_id", "vec_id", "score", (F.col("score") >= 0.95).alias("hit"))


@register(
    "few_shot_retrieval",
    f"with {_SCORED} select query_id, vec_id, score from s join labels on doc_id = vec_id where quality = 1 and score >= 0.1 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 3",
)
def few_shot_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("vec_id"))
    near = best(spark, sf_dir, 3, "query_id", among=points(spark, sf_dir).join(good, "vec_id"))
    return near.filter(F.col("score") >= 0.1).select("query_id", "vec_id", "score")


def ranked_lists(spark: SparkSession, sf_dir: str, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists for each query: by vector, and a lexical stand-in (documents by length), both bounded by ``n``."""
    vector = best(spark, sf_dir, n, "query_id").select("query_id", F.col("vec_id").alias("id"), "score", "rank")
    lengths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("n_chars") / 1000.0).alias("score"))
    longest = F.broadcast(lengths.orderBy(F.desc("score"), "vec_id").limit(n))  # one list for all queries: the n longest documents
    listed = query_points(spark, sf_dir).select(F.col("vec_id").alias("query_id")).crossJoin(longest)
    graph = top(listed, n, "query_id").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec_id").alias("id"), F.round("score", 6).alias("score"), "rank")
    return graph, vector


_LISTS = f"""{_SCORED}, v as (select query_id, vec_id as id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 30),
    g as (select q as query_id, doc_id as id, round(n_chars / 1000.0, 6) as score, row_number() over (partition by q order by n_chars / 1000.0 desc, doc_id) as rank from documents, (select vec_id as q from embeddings where vec_id % 50 = 0) qualify rank <= 30)"""


def _fused(graph: DataFrame, vector: DataFrame, g: Column, v: Column) -> DataFrame:
    """Sum of both lists' parts for each query and id, tagged by where it was found."""
    parts = graph.select("query_id", "id", g.alias("g"), F.lit(None).cast("double").alias("v")).unionByName(vector.select("query_id", "id", F.lit(None).cast("double").alias("g"), v.alias("v")))
    summed = parts.groupBy("query_id", "id").agg(F.sum("g").alias("g"), F.sum("v").alias("v"))
    source = F.when(F.col("g").isNotNull() & F.col("v").isNotNull(), "hybrid").when(F.col("g").isNotNull(), "graph").otherwise("vector")
    return summed.select("query_id", "id", F.round(F.coalesce("g", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), 6).alias("score"), source.alias("source"))


_FUSE = """select query_id, id, round(coalesce(sum(g), 0) + coalesce(sum(v), 0), 6) as score,
    case when count(g) > 0 and count(v) > 0 then 'hybrid' when count(g) > 0 then 'graph' else 'vector' end as source from p group by 1, 2"""


@register("rrf_weighted", f"with {_LISTS}, p as (select query_id, id, 0.6 / (60 + rank) as g, null::double as v from g union all select query_id, id, null, 0.4 / (60 + rank) from v) {_FUSE}")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion, the graph list weighing alpha = 0.6."""
    graph, vector = ranked_lists(spark, sf_dir)
    return _fused(graph, vector, F.lit(0.6) / (K_RRF + F.col("rank")), F.lit(0.4) / (K_RRF + F.col("rank")))


@register(
    "blend_maxnorm",
    f"""with {_LISTS}, gm as (select *, max(score) over (partition by query_id) as m from g), vm as (select *, max(score) over (partition by query_id) as m from v),
    p as (select query_id, id, 0.6 * (case when m > 0 then score / m else score end) as g, null::double as v from gm union all select query_id, id, null, 0.4 * (case when m > 0 then score / m else score end) from vm) {_FUSE}""",
)
def blend_maxnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each list divided by its own maximum where that is positive, then blended."""
    graph, vector = ranked_lists(spark, sf_dir)
    most = F.max("score").over(Window.partitionBy("query_id"))
    normal = F.when(most > 0, F.col("score") / most).otherwise(F.col("score"))
    return _fused(graph.withColumn("_s", normal), vector.withColumn("_s", normal), 0.6 * F.col("_s"), 0.4 * F.col("_s"))


@register("blend_raw", f"with {_LISTS}, p as (select query_id, id, 0.6 * score as g, null::double as v from g union all select query_id, id, null, 0.4 * score from v) {_FUSE}")
def blend_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, vector = ranked_lists(spark, sf_dir)
    return _fused(graph, vector, 0.6 * F.col("score"), 0.4 * F.col("score"))


@register(
    "overlay_max_merge",
    f"with {_LISTS}, p as (select query_id, id, score * 0.6 + 0.05 as s from g union all select query_id, id, score * 0.4 + 0.05 from v) select query_id, id, round(max(s), 6) as score from p group by 1, 2",
)
def overlay_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of both scores for each id, not their sum."""
    graph, vector = ranked_lists(spark, sf_dir)
    parts = graph.select("query_id", "id", (F.col("score") * 0.6 + 0.05).alias("_s")).unionByName(vector.select("query_id", "id", (F.col("score") * 0.4 + 0.05).alias("_s")))
    return parts.groupBy("query_id", "id").agg(F.round(F.max("_s"), 6).alias("score"))


@register(
    "rrf_per_collection",
    f"""with {_SCORED}, r as (select query_id, vec_id, 1.0 / (60 + row_number() over (partition by query_id, label order by score desc, vec_id)) as s, row_number() over (partition by query_id, label order by score desc, vec_id) as k from s),
    f as (select * from r where k <= 10) select query_id, vec_id, round(s / max(s) over (partition by query_id), 6) as score from f""",
)
def rrf_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks inside each collection, from 1, divided by the query's largest score."""
    few = best(spark, sf_dir, 10, "query_id", "label").withColumn("_s", F.lit(1.0) / (K_RRF + F.col("rank")))
    return few.select("query_id", "vec_id", F.round(F.col("_s") / F.max("_s").over(Window.partitionBy("query_id")), 6).alias("score"))


@register(
    "must_include_guarantee",
    f"""with {_LISTS}, u as (select query_id, id, score, 'graph' as source from g union all select query_id, id, score, 'vector' from v),
    c as (select *, row_number() over (partition by query_id, source order by score desc, id) as r from u),
    k as (select *, case when source = 'graph' and r <= 5 then 0 else 1 end as class from c)
    select query_id, id, source, score from (select *, row_number() over (partition by query_id order by class, score desc, id, source) as place from k) where place <= 12""",
)
def must_include_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five graph hits are kept whatever their score; the rest compete for the remaining places."""
    graph, vector = ranked_lists(spark, sf_dir)
    both = graph.select("query_id", "id", "score", F.lit("graph").alias("source")).unionByName(vector.select("query_id", "id", "score", F.lit("vector").alias("source")))
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "id"))
    classed = both.withColumn("_c", F.when((F.col("source") == "graph") & (rank <= 5), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_c", F.desc("score"), "id", "source"))
    return classed.withColumn("_p", place).filter(F.col("_p") <= 12).select("query_id", "id", "source", "score")


@register("similar_patterns", f"with {_SCORED} select query_id, vec_id, score from s join embeddings q on q.vec_id = query_id where s.label = q.label and score >= 0.2 qualify row_number() over (partition by query_id order by score desc, s.vec_id) <= 5".replace("select query_id, vec_id, score", "select query_id, s.vec_id, score"))
def similar_patterns(spark: SparkSession, sf_dir: str, threshold: float = 0.2) -> DataFrame:
    """The five most similar patterns of the query's own module, above a threshold."""
    own = query_points(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("label").alias("_own"))
    near = best(spark, sf_dir, 5, "query_id", "label").join(F.broadcast(own), "query_id").filter(F.col("label") == F.col("_own"))
    return near.filter(F.col("score") >= threshold).select("query_id", "vec_id", "score")
