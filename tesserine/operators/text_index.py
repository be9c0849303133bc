"""A kept inverted index over texts: posting blocks with bounds, updates by block, searches that skip blocks.

Postings are Parquet rows ``word, block, label, best, n, first, gaps, impacts``:
the documents of one range of ids (a block of ``WIDTH``) that have the word, as gaps
between ids, with an impact each and the greatest of these.  Files are folders by
bucket of words and sorted by word, so a search opens the buckets of its words alone
and row groups of other words are skipped by their statistics.  A block is the unit of
update: a changed document has all of its block's postings written anew in another segment, and
the table ``live`` says which segment holds a block, so document counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..sources.snapshots import Snapshots

WIDTH = 4096
#: Words named in the scan's filter; beyond that buckets alone are.
NAMED_WORDS = 5_000
_POSTING = "word string, block long, label string, n int, best int, first long, gaps array<int>, impacts array<int>"


def _bucket(word: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _postings(docs: DataFrame, words: Column, buckets: int) -> DataFrame:
    """Posting rows of documents ``id, text, label``; the group of a word in a block has at most ``WIDTH`` documents."""
    each = docs.select("id", "label", F.explode(words).alias("word")).groupBy("word", "label", "id").agg(F.count("*").alias("tf"))
    impact = F.floor(1000 * (1 + F.log("tf"))).cast("int")
    placed = each.select("word", "label", F.floor(F.col("id") / WIDTH).cast("long").alias("block"), F.struct("id", impact.alias("impact")).alias("d"))
    held = placed.groupBy("word", "block", "label").agg(F.sort_array(F.collect_list("d")).alias("d"))
    gaps = F.transform("d", lambda x, i: F.when(i == 0, F.lit(0)).otherwise((x["id"] - F.get("d", i - 1)["id"]).cast("int")))
    best = F.array_max(F.transform("d", lambda x: x["impact"]))
    rows = held.select("word", "block", "label", F.size("d").alias("n"), best.alias("best"), F.col("d")[0]["id"].alias("first"), gaps.alias("gaps"), F.transform("d", lambda x: x["impact"]).alias("impacts"))
    return rows.withColumn("bucket", _bucket("word", buckets)).repartitionByRange("bucket", "word", "block").sortWithinPartitions("bucket", "word", "block", "label")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each posting; ids from the blocks' first ids and gaps by one running sum over the batch."""
    for batch in batches:
        query, first, gaps, impacts, weight = (batch.column(k) for k in range(5))
        sizes = np.diff(gaps.offsets.to_numpy())
        total = np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        ids = total - np.repeat(total[starts] if len(total) else total, sizes) + np.repeat(first.to_numpy(), sizes)
        value = impacts.flatten().to_numpy().astype(np.int64) * np.repeat(weight.to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([query.take(pa.array(np.repeat(np.arange(batch.num_rows), sizes))), pa.array(ids), pa.array(value)], ["query", "id", "value"])


class TextIndex:
    """An index kept in the versions of a :class:`Snapshots` store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Snapshots(spark, root)

    def exists(self) -> bool:
        return "live" in self.store.tables()

    def _segments(self) -> list[str]:
        return sorted(n for n in self.store.tables() if n.startswith("segment-"))

    def build(self, docs: DataFrame, words: Column, buckets: int | None = None) -> None:
        """Index ``docs`` (``id`` long and not null, ``text``, ``label``) by the array ``words`` over ``text``; replaces what is there.

        There is a bucket for each million documents, eight at least, unless ``buckets`` says otherwise.
        """
        docs = docs.filter(F.col("id").isNotNull()).select("id", "text", F.coalesce("label", F.lit("")).alias("label"))
        n = docs.count()
        buckets = buckets or max(8, n // 1_000_000)
        live = docs.select(F.floor(F.col("id") / WIDTH).cast("long").alias("block"), "label").groupBy("block").agg(F.count("*").alias("docs"), F.count_distinct("label").alias("labels")).withColumn("segment", F.lit("segment-1"))
        self._publish({"segment-1": _postings(docs, words, buckets), "live": live}, (), buckets)

    def _publish(self, new: dict[str, DataFrame], keep: Iterable[str], buckets: int) -> None:
        """One new version, with the number of documents and blocks beside it."""
        (name,) = (n for n in new if n != "live")
        new["live"] = live = cut(new["live"])
        docs, blocks, labels = live.agg(F.sum("docs"), F.count("*"), F.max("labels")).first()
        self.store.stage(new, keep, {name: ["bucket"]}, {"buckets": buckets, "docs": docs or 0, "blocks": blocks, "labels": labels or 0})
        self.store.commit()

    def update(self, docs: DataFrame, words: Column, changed: DataFrame) -> None:
        """Index the blocks of the ids in ``changed`` anew from ``docs``, the whole new table; other blocks stay as they are.

        An id that ``docs`` no longer has is gone from the index.
        """
        docs = docs.filter(F.col("id").isNotNull()).select("id", "text", F.coalesce("label", F.lit("")).alias("label"))
        block = F.floor(F.col("id") / WIDTH).cast("long")
        touched = changed.select(block.alias("block")).distinct()
        now = docs.withColumn("block", block).join(touched, "block", "left_semi")
        name = f"segment-{(self.store.current() or 0) + 1}"
        live = self.store.read("live")
        fresh = now.groupBy("block").agg(F.count("*").alias("docs"), F.count_distinct("label").alias("labels")).withColumn("segment", F.lit(name))
        live = live.join(touched, "block", "left_anti").unionByName(fresh)
        buckets = self.store.facts()["buckets"]
        self._publish({name: _postings(now.drop("block"), words, buckets), "live": live}, self._segments(), buckets)

    def compact(self) -> None:
        """Write all live blocks as one segment again."""
        name = f"segment-{(self.store.current() or 0) + 1}"
        rows = self._live().drop("segment").repartitionByRange("bucket", "word", "block").sortWithinPartitions("bucket", "word", "block", "label")
        live = self.store.read("live").withColumn("segment", F.lit(name))
        self._publish({name: rows, "live": live}, (), self.store.facts()["buckets"])

    def _live(self) -> DataFrame:
        """Posting rows of all segments that are not superseded."""
        names = self._segments()
        parts = [self.store.read(n).withColumn("segment", F.lit(n)) for n in names]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows if len(names) == 1 else rows.join(self.store.read("live").select("block", "segment"), ["block", "segment"], "left_semi")

    def search(self, queries: DataFrame, k: int = 10, share: bool = False, factors: dict[str, float] | None = None, labels: list[str] | None = None, first_blocks: int = 64) -> DataFrame:
        """The ``k`` best documents of each query (``query``, ``words`` array): ``query, id, score``, ties to the smaller id.

        ``share``: the part of the query's distinct words that a document has.  Else the
        sum over the words of ``floor(1000 (1 + ln tf)) * floor(1000 ln(1 + N / df))``,
        in millionths, times the label's factor (``factors``, 1 for others), N and df
        counted over all live documents whatever ``labels`` (those searched) says.

        Only heads of posting rows are read at first.  A block's bound is the sum
        of its best impacts; each query's ``first_blocks`` of greatest bound give the score
        that its k-th hit reaches at least, and no block whose bound is below that has its
        postings read.  Nothing is lost: a bound is never below a score.
        """
        asked = queries.select("query", F.explode(F.array_distinct("words")).alias("word")).filter(F.col("word").isNotNull())
        asked = asked.withColumn("k", F.count("*").over(Window.partitionBy("query")))
        facts = self.store.facts()
        words = asked.select("word", _bucket("word", facts["buckets"]).alias("bucket")).distinct().limit(NAMED_WORDS + 1).collect()
        small = len(words) <= NAMED_WORDS
        rows = self._live()
        if small:
            rows = rows.filter(F.col("bucket").isin(sorted({r.bucket for r in words})) & F.col("word").isin(sorted(r.word for r in words)))
        if share:
            weight = F.lit(1).cast("long")
            heads = rows.select("word", "label", "block").withColumn("best", F.lit(1))
        else:
            n = facts["docs"]
            df = rows.groupBy("word").agg(F.sum("n").alias("_df"))
            asked = asked.join(df, "word")
            weight = F.floor(1000 * F.log(1 + F.lit(float(n)) / F.col("_df"))).cast("long")
            heads = rows.select("word", "label", "block", "best")
        if labels is not None:
            heads, rows = (x.filter(F.col("label").isin(labels)) for x in (heads, rows))
        asked = asked.withColumn("weight", weight)
        factor = F.lit(1.0)
        for label, by in (factors or {}).items():
            factor = F.when(F.col("label") == label, F.lit(float(by))).otherwise(factor)
        hint = F.broadcast if small else (lambda x: x)
        bounds = heads.join(hint(asked), "word").groupBy("query", "block", "label").agg((F.sum(F.col("best") * F.col("weight")) * factor).alias("bound"))

        def scored(chosen: DataFrame) -> DataFrame:
            wanted = chosen.select("query", "block", "label").join(hint(asked.select("query", "word", "weight")), "query")
            impacts = F.transform("gaps", lambda x: F.lit(1)) if share else F.col("impacts")
            met = rows.select("word", "block", "label", "first", "gaps", "impacts").join(wanted, ["word", "block", "label"])
            kind = queries.schema["query"].dataType.simpleString()
            hits = met.select(F.struct("query", "label").alias("query"), "first", "gaps", impacts.alias("impacts"), "weight").mapInArrow(_decoded, f"query struct<query: {kind}, label: string>, id long, value long")
            sums = hits.groupBy("query", "id").agg(F.sum("value").alias("value"))
            return sums.select("query.query", "query.label", "id", (F.col("value") * factor).alias("value"))

        def best(found: DataFrame) -> DataFrame:
            top = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("value"), "id"))
            return found.withColumn("_r", top).filter(F.col("_r") <= k)

        if facts["blocks"] * facts["labels"] <= first_blocks:  # no query has more
            both = best(scored(bounds))
        else:
            placed = bounds.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block", "label")))
            one = cut(best(scored(placed.filter(F.col("_place") <= first_blocks))))
            floor = one.filter(F.col("_r") == k).select("query", F.col("value").alias("_floor"))
            rest = placed.filter(F.col("_place") > first_blocks).join(floor, "query", "left").filter(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor")))
            both = best(one.drop("_r").unionByName(scored(rest)))
        if share:
            sizes = queries.select("query", F.size(F.array_distinct("words")).alias("_k"))
            return both.join(sizes, "query").select("query", "id", F.round(F.col("value") / F.col("_k"), 6).alias("score"))
        return both.select("query", "id", (F.col("value") / 1e6).alias("score"))
