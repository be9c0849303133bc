"""Best sentences of documents, against the same rules as expressions."""

import random

from pyspark.sql import functions as F

from tesserine import registry
from tesserine.functions import text as T
from tesserine.operators import compression

PIECES = [
    "the register", "Struct", "macros", "a (b)", "# x", "ASIL", "MISRAx", "éISO", "ISOé", "vs.", "Dr.", "éDr.", "éMr.", "́Mr.", "²etc.", "éi.e.g.", "i.e.", "_vs.", "Jr. ", "enum", "ENUḾ", "!enum", "ſtruct", "İ", "THE", "tHé",
    "end.", "end!", "end?\n", "end.\t ", "end. ", "a\x1cb", "c\x0bd", "\x01", "\x02", " ", "  ", "", "{", ";", "word", "mot", "ünï", "日本", "𝒳y", "no.5",
]


def odd_texts():
    rnd = random.Random(5)
    texts = ["", " ", "\n", ".", ". . .", "one", "One. Two. Three. Four. Five. Six.", "a. " * 3000, "#a. #b. c# d. e. f. g. (h)", "\x02".join("abcdefgh"), "Mr. A. etc. B! vs. C? D e.g. E. F. G. H."]
    texts += ["".join(rnd.choice(PIECES) + rnd.choice([" ", " ", " ", ". ", "! ", "", "\n"]) for _ in range(rnd.choice([5, 30, 120]))) for _ in range(400)]
    return texts


def by_expressions(docs, most, terms):
    ranked = F.transform(T.sentences(F.col("text")), lambda s, i: F.struct((-T.sentence_score(s, terms)).alias("minus"), i.alias("place"), s.alias("sentence")))
    chosen = F.transform(F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, most), lambda x: F.struct(x["place"], x["sentence"]))), lambda x: x["sentence"])
    rows = docs.filter("text is not null").select("lang", "doc_id", F.array_join(chosen, " ").alias("c"))
    return {tuple(r) for r in rows.select("lang", "doc_id", T.token_estimate(F.col("c")), F.md5("c")).collect()}


def test_best_sentences_equal_the_expressions(spark, small):
    odd = spark.createDataFrame([(k, t, None if k % 7 == 0 else "en") for k, t in enumerate(odd_texts() + [None])], "doc_id long, text string, lang string")
    for docs, most in ((odd, 5), (odd, 1), (spark.read.parquet(f"{small}/documents.parquet"), 5)):
        got = [tuple(r) for r in compression.compressed(docs, most, ("the",)).collect()]
        assert len(got) == len(set(got)) and set(got) == by_expressions(docs, most, ("the",))


def test_compression_reads_the_documents_once(spark, small):
    registry.load()
    plan = registry.queries()["extractive_compression"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "regexp" not in plan  # only what one pass has left: ids, sizes and sums
