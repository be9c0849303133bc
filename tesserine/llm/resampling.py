"""Operator 13: importance resampling towards a target distribution.

Word runs of documents and of target texts are hashed to buckets; a bucket's gain
is the log ratio of its shares in target and corpus.  Documents are weighed by
their mean gain and drawn by Gumbel keys.  Long texts are cut into chunks that
overlap by n - 1 words: a chunk owns the runs that start in it, so counts and
gains of chunks add up to those of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from .common import cut, release

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # after A-Z are lower-cased
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def chunks(text: bytes, longest: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(words owned, bytes) of the chunks of a lower-cased text: about ``size`` bytes up to a word's end, then the next ``longest - 1`` words as carry."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        upto = end
        for word in islice(_WORD.finditer(text, end), longest - 1):
            upto = word.end()
        yield sum(1 for _ in _WORD.finditer(text, at, end)), text[at:upto]
        at = end


def hashes(words: list[bytes], owned: int, longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` words that start at one of the first ``owned`` words."""
    runs = [np.fromiter(map(crc32, words[:owned]), dtype=np.int64)]
    for n in range(2, longest + 1):
        runs.append(np.array([crc32(b" ".join(words[i : i + n])) for i in range(min(owned, len(words) - n + 1))], dtype=np.int64))
    return np.concatenate(runs) % buckets


def _pieces(rows: DataFrame, longest: int, size: int) -> DataFrame:
    """``_id, _row, _owned, _part``: texts of up to ``size`` bytes as they are, where they are; longer ones (with a row number) in chunks dealt to all tasks.

    ``_owned`` is -1 for a whole text: all its words are its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for no, (owned, part) in enumerate(chunks(batch.column(2)[k].as_py().lower(), longest, size)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([no], pa.int64()), pa.array([owned], pa.int64()), pa.array([part], pa.binary())], ["_id", "_row", "_no", "_owned", "_part"])

    kind = rows.schema["_id"].dataType.simpleString()
    length = F.coalesce(F.octet_length("_text"), F.lit(0))
    short = rows.filter(length <= size).select("_id", F.lit(None).cast("long").alias("_row"), F.lit(-1).cast("long").alias("_owned"), F.coalesce("_text", F.lit("")).cast("binary").alias("_part"))
    long = rows.filter(length > size).select("_id", F.monotonically_increasing_id().alias("_row"), F.col("_text").cast("binary"))
    parts = long.mapInArrow(run, f"_id {kind}, _row long, _no long, _owned long, _part binary").repartition("_row", "_no")
    return short.unionByName(parts.drop("_no"))


def _owned_buckets(owned: int, part: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    words = _WORD.findall(part.lower())
    owned = len(words) if owned < 0 else owned
    return owned, hashes(words, owned, longest, buckets)


def bucket_counts(texts: DataFrame, longest: int, buckets: int, size: int) -> DataFrame:
    """``bucket, n``: features of all rows ``_id, _text`` in each bucket; a task sums up what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                sums += np.bincount(_owned_buckets(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), longest, buckets)[1], minlength=buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(sums[there], pa.int64())], ["bucket", "n"])

    found = _pieces(texts, longest, size).select("_owned", "_part").mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, target_counts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of every bucket: a thousand times the log ratio of the shares in target and corpus, one added to each count, rounded down."""
    every = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(counts.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target_counts.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    total, wanted = counts.agg(F.sum("n")).first()[0] or 0, target_counts.agg(F.sum("n")).first()[0] or 0
    more = lambda c: (F.col(c) + 1).cast("double")
    ratio = more("t") * F.lit(float(total + buckets)) / (more("s") * F.lit(float(wanted + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, table: np.ndarray, longest: int, size: int) -> DataFrame:
    """``_id, n_words, n_features, gain`` of every row ``_id, _text``; only chunks of long texts are shuffled."""
    buckets, shared = len(table), docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sums = []
            for k in range(batch.num_rows):
                owned, found = _owned_buckets(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), longest, buckets)
                sums.append((owned, len(found), int(shared.value[found].sum())))
            columns = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)] if sums else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "_row", "n_words", "n_features", "gain"])

    each = _pieces(docs, longest, size).mapInArrow(run, f"_id {kind}, _row long, n_words long, n_features long, gain long")
    each = cut(each)
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")]
    whole = each.filter(F.col("_row").isNotNull()).groupBy("_row").agg(F.first("_id").alias("_id"), *sums).drop("_row")
    return each.filter(F.col("_row").isNull()).drop("_row").unionByName(whole)


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    chunk_bytes: int = 262_144,
) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words so that they resemble ``target``: ``id_col, n_features, weight, score, rank``.

    Words are runs of a-z (A-Z lower-cased), digits and characters beyond ASCII;
    features all runs of 1 to ``longest`` words, repeats counted.  ``weight`` is the
    floored mean gain of a document's features (0 without any), ``score`` adds a Gumbel
    key from a hash of seed and id, ``rank`` (1, 2, 3 ...) is the place among those
    drawn, null for the others; ties go to the smaller id.

    Null and empty texts have no features and are never drawn.  Rows that repeat an id
    share its key and are ranked each; a null id hashes as an empty one and comes first in
    ties.  An empty table gives no rows, an empty target leaves gains that only
    disfavour frequent buckets.  Other columns are ignored.  Texts are read twice (counts, then weights) and only chunks of texts
    beyond ``chunk_bytes`` are shuffled; the broadcast gains are ``buckets`` numbers.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    wanted = target.select(F.lit(0).cast("long").alias("_id"), F.col(target_text_col).alias("_text"))
    counts, target_counts = (cut(bucket_counts(x, longest, buckets, chunk_bytes)) for x in (rows, wanted))
    table = np.zeros(buckets, dtype=np.int64)
    for bucket, gain in gains(counts, target_counts, buckets).collect():  # as many as there are buckets
        table[bucket] = gain
    weighed = weigh(rows, table, longest, chunk_bytes)

    n, total = F.col("n_features"), F.col("gain")
    mean = F.when(n > 0, F.call_function("div", total - F.pmod(total, F.greatest(n, F.lit(1))), F.greatest(n, F.lit(1)))).otherwise(0)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 8)
    chance = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = cut(weighed.select("_id", "n_words", "n_features", mean.cast("long").alias("weight"), (mean + F.floor(-1000 * F.log(-F.log(chance)))).cast("long").alias("score")))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = running(able, [], [F.desc("score"), F.asc("_id"), F.asc("n_features"), F.asc("weight")], None, "_ahead")
    place = F.when(F.col("_ahead") < drawn, F.col("_ahead") + 1)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("_ahead", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("_id").alias(id_col), "n_features", "weight", "score", place.alias("rank"))
