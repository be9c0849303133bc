"""Chunks of code and records as vectors, index expansion, coverage verdicts and mentions with long runs."""

from pyspark.sql import functions as F

from tesserine.functions.vectors import hash_embedding
from tesserine.plans.traversals import mentions
from tesserine.sources import parsers, vector_ingest
from tesserine.sources.c_source import c_findings
from tesserine.sources.snapshots import Snapshots

CODE = "uint8 G;\nstatic uint8 f(uint8 a)\n{\n  g(a);\n  AdcSFR->CLC.U = 1;\n  return a;\n}\nvoid g(uint8 b) { h(); }\n"


def test_code_becomes_points_and_only_changes_are_embedded(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/v")
    files = lambda text: spark.createDataFrame([("a.c", text), ("none.c", None)], "file string, text string")
    chunks = lambda text: vector_ingest.code_chunks(c_findings(files(text)), files(text), "adc")
    rows = {r.payload["name"]: r for r in chunks(CODE).collect()}
    assert rows["f"].document == "Function: f\nModule: adc\nFile: a.c\nReturns: uint8\nParameters: a\nCalls: g\nRegisters: WRITE CLC\n" + "\n".join(CODE.split("\n")[1:7])
    assert rows["f"].payload == {"type": "function", "name": "f", "file": "a.c", "module": "adc", "line": "2", "static": "true"} and set(rows) == {"f", "g"}
    assert vector_ingest.upsert(store, "code", chunks(CODE)) == {"kept": 0, "embedded": 2, "removed": 0}
    first = {r.payload["name"]: r for r in store.read("code").collect()}
    want = spark.createDataFrame([(rows["g"].document,)], "d string").select(hash_embedding(F.col("d"))).first()[0]
    assert first["g"].embedding == want and len(want) == 384
    other = vector_ingest.record_chunks(spark.createDataFrame([("R1", 4, None), (None, 1, "x"), ("R1", 4, None)], "name string, address int, note string"), "register", "adc", "name", "address", "note")
    assert [(r.document, r.payload["type"]) for r in other.collect()] == [("[register] R1\naddress: 4", "register")]
    functions = F.col("payload")["type"] == "function"
    assert vector_ingest.upsert(store, "code", other, scope=F.col("payload")["type"] == "register") == {"kept": 0, "embedded": 1, "removed": 0}
    changed = CODE.replace("h();", "h(); k();").replace("uint8 G;\n", "uint8 G;\n\n")
    assert vector_ingest.upsert(store, "code", chunks(CODE), scope=functions) == {"kept": 2, "embedded": 0, "removed": 0}
    assert vector_ingest.upsert(store, "code", chunks(changed), scope=functions) == {"kept": 1, "embedded": 1, "removed": 0}
    assert vector_ingest.upsert(store, "code", chunks("void g(uint8 b) { }"), scope=functions)["removed"] == 1
    assert sorted(r.payload["name"] for r in store.read("code").collect()) == ["R1", "g"]


def test_index_letters_expand(spark):
    rows = spark.createDataFrame([("CXPI_CHx_CTL1 (x=0-2)", "Channel x of max x1"), ("GTM_TOMi_CHn (i = 0 to 1)", "i and n"), ("PLAIN", "x stays"), (None, None)], "name string, text string")
    got = sorted(((r.name, r.text, r["index"]) for r in parsers.expand_rows(rows, "name", "text").collect()), key=str)
    assert got == sorted([("CXPI_CH0_CTL1", "Channel 0 of max x1", 0), ("CXPI_CH1_CTL1", "Channel 1 of max x1", 1), ("CXPI_CH2_CTL1", "Channel 2 of max x1", 2), ("GTM_TOM0_CHn", "0 and n", 0), ("GTM_TOM1_CHn", "1 and n", 1), ("PLAIN", "x stays", None), (None, None, None)], key=str)


def test_coverage_verdicts(spark):
    rows = spark.createDataFrame([("a", 10, 8), ("b", 3, 2), ("c", 4, 1), ("d", 0, 0)], "source string, n_lines int, n_hit int")
    assert [(r.source, r.percent, r.verdict) for r in parsers.coverage_verdict(rows).orderBy("source").collect()] == [("a", 80.0, "PASS"), ("b", 66.67, "WARNING"), ("c", 25.0, "FAIL"), ("d", 0.0, "FAIL")]


def test_mentions_inside_long_runs(spark):
    names = spark.createDataFrame([("ab_c", "m"), ("a_very_long_name", "m"), ("ab_c", "n"), (None, "m")], "name string, scope string")
    texts = spark.createDataFrame([(1, "x" * 20_000 + "ab_cx", "m"), (2, "see a_very_long_name, ab_", "m"), (3, "ab_c", "k"), (4, None, "m")], "id int, text string, scope string")
    assert sorted(tuple(r) for r in mentions(texts, names, ("id",), "text", "scope").collect()) == [(1, "ab_c"), (2, "a_very_long_name")]
    assert mentions(texts, names.limit(0), ("id",), "text", "scope").collect() == []
