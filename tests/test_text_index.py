"""The kept inverted index and the versioned store it lives in."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserine.operators import text_index
from tesserine.operators.text_index import TextIndex
from tesserine.sources.snapshots import Snapshots, detect, fingerprint


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def split(text):
    return F.filter(F.split(F.col(text), " "), lambda w: w != "")


def corpus(n, seed=0):
    """Ids over several blocks with gaps between them, in three labels; a frequent word, rare ones and empty texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i * 37 + rnd.randrange(30), " ".join(["the"] * rnd.randrange(4) + rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rnd.randrange(12))) if i % 23 else None, rnd.choice(["a", "b", None])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, label string")


def plain(rows, queries, k, share=False, factors=None, labels=None):
    counts = {i: (Counter(t.split()), lab or "") for i, t, lab in rows if t}
    n = len(rows)
    df = Counter(w for c, _ in counts.values() for w in c)
    out = set()
    for q, words in queries:
        words, scores = set(words or ()), {}
        for i, (c, lab) in counts.items():
            met = [w for w in words if w in c]
            if met and (labels is None or lab in labels):
                if share:
                    scores[i] = round(len(met) / len(words), 6)
                else:
                    scores[i] = sum(math.floor(1000 * (1 + math.log(c[w]))) * math.floor(1000 * math.log(1 + n / df[w])) for w in met) * (factors or {}).get(lab, 1.0) / 1e6
        out |= {(q, i, round(s, 6)) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]}
    return out


QUERIES = [(1, ["the", "w0", "w5", "w5"]), (2, ["w40", "w41"]), (3, ["the"]), (4, ["absent"]), (5, []), (6, None), (7, ["w1", "w2", "w3", "w59", "the"])]


def asked(spark):
    return spark.createDataFrame(QUERIES, "query long, words array<string>")


def found(df):
    return {(r.query, r.id, round(r.score, 6)) for r in df.collect()}


def test_searches_equal_a_scan(spark, folder, monkeypatch):
    monkeypatch.setattr(text_index, "WIDTH", 512)
    rows = corpus(400)
    index = TextIndex(spark, folder)
    assert not index.exists()
    index.build(frame(spark, rows), split("text"))
    for k, blocks in ((3, 1), (10, 2), (500, 4)):
        assert found(index.search(asked(spark), k=k, first_blocks=blocks)) == plain(rows, QUERIES, k)
        assert found(index.search(asked(spark), k=k, share=True, first_blocks=blocks)) == plain(rows, QUERIES, k, share=True)
    assert found(index.search(asked(spark), k=5, factors={"b": 0.3})) == plain(rows, QUERIES, 5, factors={"b": 0.3})
    assert found(index.search(asked(spark), k=5, labels=["b", ""])) == plain(rows, QUERIES, 5, labels=["b", ""])


def test_updates_touch_blocks_and_keep_counts(spark, folder, monkeypatch):
    monkeypatch.setattr(text_index, "WIDTH", 512)
    rows = corpus(300, 1)
    index = TextIndex(spark, folder)
    index.build(frame(spark, rows), split("text"))
    rnd = random.Random(5)
    for turn in range(3):
        changed = {rows[k][0] for k in rnd.sample(range(len(rows)), 3)}
        rows = [(i, f"the changed{turn} w5" if i % 2 else t, lab) if i in changed else (i, t, lab) for i, t, lab in rows if not (i in changed and i % 3 == 0)] + [(20_000 + turn, "w40 new", "a")]
        index.update(frame(spark, rows), split("text"), spark.createDataFrame([(i,) for i in [*changed, 20_000 + turn]], "id long"))
        assert found(index.search(asked(spark), k=8, first_blocks=1)) == plain(rows, QUERIES, 8)
    written = index.store.read(f"segment-{index.store.current()}").select("block").distinct().count()
    assert written <= 4 < index.store.read("segment-1").select("block").distinct().count()
    index.compact()
    index.store.vacuum()
    assert len(index._segments()) == 1
    assert found(index.search(asked(spark), k=8)) == plain(rows, QUERIES, 8)


def test_search_reads_only_buckets_and_words_of_the_queries(spark, folder):
    index = TextIndex(spark, folder)
    index.build(frame(spark, corpus(200)), split("text"), buckets=16)
    one = spark.createDataFrame([(1, ["w40"])], "query long, words array<string>")
    plan = index.search(one, k=3)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "bucket" in line]
    assert scans and all("PartitionFilters: [" in s and "bucket" in s.split("PartitionFilters:")[1].split("PushedFilters")[0] for s in scans)
    assert all("word" in s.split("PushedFilters:")[1].split("ReadSchema")[0] for s in scans)
    assert any("gaps" not in s.split("ReadSchema:")[1] for s in scans)


def test_empty_index(spark, folder):
    index = TextIndex(spark, folder)
    index.build(frame(spark, []), split("text"))
    assert index.search(asked(spark)).collect() == []
    assert index.search(asked(spark), share=True).collect() == []


def files(spark, *rows):
    return spark.createDataFrame(rows, "path string, content_hash string")


def delta(df):
    return sorted((r.path, r.change_type) for r in df.collect())


def test_state_is_pending_until_commit(spark, folder):
    store = Snapshots(spark, folder)
    assert (store.current(), store.pending(), store.commit()) == (None, None, None)
    first = files(spark, ("a", "1"), ("b", "1"))
    assert delta(detect(store, first)) == [("a", "ADDED"), ("b", "ADDED")]
    assert delta(detect(store, first)) == [("a", "ADDED"), ("b", "ADDED")]  # not committed: found again
    assert store.commit() == 1
    assert delta(detect(store, first)) == []
    store.discard()
    second = files(spark, ("a", "2"), ("c", "1"), ("b", "1"))
    also = spark.createDataFrame([("b",)], "path string")
    assert delta(detect(store, second, also)) == [("a", "MODIFIED"), ("b", "MODIFIED"), ("c", "ADDED")]
    assert store.read("files").filter("path = 'c'").count() == 0
    assert store.commit() == 2
    assert delta(detect(store, files(spark, ("c", "1")))) == [("a", "DELETED"), ("b", "DELETED")]
    store.reset()
    assert store.read("files") is None and store.tables() == {}
    assert delta(detect(store, files(spark, ("c", "1")))) == [("c", "ADDED")]


def test_a_run_killed_between_the_phases_leaves_the_old_state(spark, folder, monkeypatch):
    store = Snapshots(spark, folder)
    detect(store, files(spark, ("a", "1")))
    store.commit()
    detect(store, files(spark, ("a", "2"), ("b", "1")))
    assert store.pending() == 2
    again = Snapshots(spark, folder)  # a new process after the crash
    assert again.current() == 1 and [tuple(r) for r in again.read("files").collect()] == [("a", "1")]
    assert delta(detect(again, files(spark, ("a", "3")))) == [("a", "MODIFIED")]  # replay replaces what was staged
    assert again.commit() == 2 and [tuple(r) for r in again.read("files").collect()] == [("a", "3")]
    monkeypatch.setattr(Snapshots, "_write", lambda self, name, content: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        detect(again, files(spark, ("z", "9")))  # dies inside phase one, after the tables
    monkeypatch.undo()
    assert again.pending() is None and again.commit() is None and again.current() == 2
    assert [tuple(r) for r in again.read("files").collect()] == [("a", "3")]
    assert [tuple(r) for r in again.read("files", 1).collect()] == [("a", "1")]


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    before = fingerprint(spark, path)
    assert before == fingerprint(spark, path)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert before != fingerprint(spark, path)
