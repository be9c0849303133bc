"""A corpus pipeline of five operators: each stage reads what its predecessor wrote.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import common, decontaminate, near_dedup, sentencepiece_codec, substring_dedup, toxicity
from tesserine.llm.queries import PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of ``documents``, ``n_chars`` being the text's present length."""
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not in ``ids``; those with a null id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs, model)
    return _without(docs, judged.filter(F.col("predicted") == 1))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    grouped = near_dedup.near_duplicates(docs)
    return _without(docs, grouped.filter(~F.col("kept")))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that also start earlier go; a document that loses none keeps its text as it is.

    A document that loses all its words goes.
    """
    cut = substring_dedup.dedup(docs, carry=("lang", "source"))
    rest = cut.filter((F.col("n_removed") == 0) | (F.col("kept") != ""))
    return _documents(rest.withColumnRenamed("text_after", "text"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark passage go."""
    return _without(docs, decontaminate.overlaps(docs, common.table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, with its text decoded from them."""
    coded = sentencepiece_codec.encode_decode(docs, public_tokenizers.path(PIECE_MODEL))
    return coded.select("doc_id", "ids", "n_tokens", "decoded")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_copies),
    ("substring_dedup", remove_repeats),
    ("decontamination", remove_benchmark),
    ("sentencepiece", encode),
]

#: Learned scores, similarity classes and model-dependent merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet to the shared folder and read again.

    A stage's folder goes when the next one is written; the last one is the result.
    """
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, path = common.table(spark, sf_dir, "documents").select(*COLUMNS), ""
    for k, (name, stage) in enumerate(STAGES):
        before, path = path, f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return docs
