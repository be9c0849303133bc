"""Operator 12: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target in words.  Whole multiples of the source are taken as
complete epochs; what remains is filled with its documents in the order of
exponential keys scaled by quality weights (heavier documents tend to come first),
up to the budget.  The documents are sorted and summed up in ranges, so a source of
any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from .common import cut

WEIGHTS = (5, 2, 1)


def label_weights(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """``id_col, weight``: 4 for documents of good quality, 1 for the others; repeated labels are averaged, null labels and ids left out."""
    known = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(id_col).agg((1 + 3 * F.avg(quality_col)).alias("weight"))


def _level(sources: DataFrame, budget: int) -> float:
    """Words for each unit of weight once no source is above its cap; a few sums reach the driver in each round."""
    level = 0.0
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("share")
        held, free = sources.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("share")))).first()
        now = (budget - (held or 0)) / free if free else level
        if now <= level:
            return level
        level = now


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source, source_no, source_size, target`` from ``source, source_size``.

    Sources in the order of code points, null last, have ``weights`` in turn and share
    the sum of all sizes; none gets more than ``most`` times its own size, and what
    such sources leave is shared again by weight until none is above.
    """
    placed = running(sizes, [], [F.col("source").isNull(), F.col("source")], None, "ahead")
    turn = (F.col("ahead") % len(weights)).cast("int")
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    sources = cut(placed.select("source", F.col("ahead").alias("source_no"), "source_size", share.alias("share"), (F.col("source_size") * most).alias("cap")))
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    level = _level(sources, budget)
    return sources.select("source", "source_no", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("share")).alias("target"))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    few: int = 100_000,
) -> DataFrame:
    """What a mix of the sources takes of each document: ``id_col, source, size, source_size, target, taken``.

    ``size`` is the number of words (runs other than ASCII white space; null and empty
    texts: 0), ``target`` the words wanted of the document's source, ``taken`` the
    words that the mix takes, repeats counted: complete epochs of the source first,
    then documents by ascending key ``-ln(u) / weight``, u a hash of seed and id,
    up to the target rounded to whole words; the document at that mark gives only its first
    words, so a source's sum is its rounded target and no document gives more than
    ``most`` times its size.  ``quality`` has ``id_col, weight``; weights are held
    between 1 and 16, documents without one have 2.

    The same table gives the same mix however it is partitioned.  Rows that repeat an
    id stand side by side in the order, each counted; a null id is an id, a null
    source a source.  Sources without words have target 0.  An empty table gives no
    rows.  Other columns are ignored.  Texts are read once and not shuffled, only ids, sources and sizes are.
    """
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(2.0))
    else:
        judged = quality.select(F.col(id_col).alias("_id"), F.col("weight").cast("double").alias("weight"))
        rows = rows.join(judged, "_id", "left").withColumn("weight", F.coalesce("weight", F.lit(2.0)))
    rows = cut(rows)
    wanted = cut(targets(cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, most))
    named = wanted.withColumnRenamed("source", "_source")
    known = rows.join(F.broadcast(named) if named.count() <= few else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 12)
    chance = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)
    keyed = known.withColumn("_key", -F.log(chance) / F.least(F.greatest("weight", F.lit(1.0)), F.lit(16.0)))
    summed = running(cut(keyed.drop("weight")), ["source_no"], [F.asc("_key"), F.asc("_id"), F.asc("size")], "size", "_ahead")
    whole = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.call_function("div", whole, F.col("source_size"))).otherwise(0)
    rest = whole - rounds * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_ahead")))
    return summed.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", (rounds * F.col("size") + last).alias("taken"))
