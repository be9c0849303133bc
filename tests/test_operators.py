"""Operators on small fixtures, against results worked out by hand or by brute force."""

import pandas as pd

from tesserine.operators import chunking, dataflow, overlay, packing, traversal
from tesserine.sources import files, incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_reach_leaves_cycles(spark):
    links = frame(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("A", "D")], "src string, dst string")
    found = traversal.reach(frame(spark, [("A",)], "node string"), links, most=2).collect()
    assert {(r.node, r.depth) for r in found} == {("B", 1), ("D", 1), ("C", 2)}


def test_shortest_paths_take_least_of_ties(spark):
    links = frame(spark, [("A", "C"), ("A", "B"), ("B", "D"), ("C", "D")], "src string, dst string")
    found = traversal.shortest_paths(frame(spark, [("A",)], "node string"), frame(spark, [("D",)], "node string"), links, most=4).collect()
    assert [(r.length, r.path) for r in found] == [(2, ["A", "B", "D"])]


def test_levels_leave_cycles_without_level(spark):
    nodes = frame(spark, [(x,) for x in "abcxy"], "node string")
    links = frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r.node: r.level for r in traversal.levels(nodes, links, most=9).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_pack_skips_and_gives_spare_room_to_full_slots():
    items = pd.DataFrame({"item_id": [1, 2, 3, 4], "slot": ["a", "a", "a", "b"], "score": [9.0, 8.0, 7.0, 1.0], "tokens": [60, 50, 40, 5]})
    assert packing.pack_group(items, {"a": 100, "b": 100}, 1000)["item_id"].tolist() == [1, 2, 3, 4]
    assert packing.pack_group(items, {"a": 100, "b": 5}, 1000)["item_id"].tolist() == [1, 3, 4]


def test_confidence_weights_and_routes(spark):
    weights = {"api_verified": 20, "call_order_valid": 25, "config_valid": 15, "is_safety_critical": -15}
    rows = [("r", s, True, None) for s in ("api_verified", "call_order_valid", "config_valid")] + [("s", "is_safety_critical", None, 0.5)]
    got = {r.response_id: (r.score, r.route) for r in packing.confidence(frame(spark, rows, "response_id string, signal string, bool_value boolean, num_value double"), weights).collect()}
    assert got == {"r": (80, "AUTO"), "s": (13, "FULL")}


def test_shadow_diff_and_merge(spark):
    prod = frame(spark, [(1, "a", 1), (2, "b", 2), (3, "c", None)], "k int, v string, n int")
    over = frame(spark, [(2, "B", None, False), (3, None, None, True), (4, "d", 4, False)], "k int, v string, n int, deleted boolean")
    got = {tuple(r) for r in overlay.shadow(prod, over, "k").collect()}
    assert got == {(1, "a", 1, "production"), (2, "B", 2, "shadow"), (4, "d", 4, "overlay")}
    assert {tuple(r) for r in overlay.diff(prod, overlay.shadow(prod, over, "k").drop("origin"), "k").collect()} == {(1, "unchanged"), (2, "modified"), (3, "removed"), (4, "added")}
    updates = over.drop("deleted")
    once = overlay.merge(prod, updates, "k")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in overlay.merge(once, updates, "k").collect()} == {(1, "a", 1), (2, "B", 2), (3, "c", None), (4, "d", 4)}


def test_propagation_stops_at_dispatchers(spark):
    calls = frame(spark, [("p", "d", None), ("d", "x", "1"), ("d", "y", "2"), ("d", "z", None), ("p", "h", None), ("h", "i", None)], "caller string, callee string, case_label string")
    accesses = frame(spark, [("x", "X"), ("i", "I"), ("d", "D"), ("p", "D"), ("z", "Z")], "node string, target string").selectExpr("node", "target", "'m' as member", "'READ' as access_type", "null as context", "null as branch_id")
    got = {tuple(r) for r in dataflow.propagate(frame(spark, [("p",), ("d",)], "node string"), calls, accesses).select("node", "target", "depth").collect()}
    assert got == {("p", "I", 2), ("d", "Z", 1)}  # of a dispatcher that starts, only calls outside of cases are followed
    registers = frame(spark, [("x", "R", "READ", "F"), ("p", "R", "READ", None), ("i", "S", "WRITE", "U")], "node string, register string, access_type string, field string")
    got = {tuple(r) for r in dataflow.propagate_registers(frame(spark, [("p",), ("d",)], "node string"), calls, registers).collect()}
    assert got == {("p", "R", "READ", None, False), ("p", "S", "WRITE", "U", True), ("d", "R", "READ", "F", True)}


def test_reachable_branches(spark):
    arguments = frame(spark, [("a", "f", "1"), ("b", "f", None)], "caller string, callee string, value string")
    branches = frame(spark, [("f", "1", "one"), ("f", "2", "two")], "callee string, value string, branch string")
    assert {tuple(r) for r in dataflow.reachable_branches(arguments, branches).collect()} == {("a", "f", "one"), ("b", "f", "one"), ("b", "f", "two")}


def test_chunks_cover_text_and_carry_a_tail():
    text = "\n".join(f"paragraph {k} " + "x" * 40 for k in range(30))
    chunks = chunking.split_paragraphs(text, 200, 30)
    assert all(len(c) <= 200 for c in chunks)
    assert all(b.startswith(a[-30:]) for a, b in zip(chunks, chunks[1:], strict=False))
    assert all(any(f"paragraph {k} " in c for c in chunks) for k in range(30))
    assert chunking.split_paragraphs("", 10, 2) == []


def test_sections_parents_and_merging(spark):
    docs = frame(spark, [(1, "intro\n# a\nx\ny\n# b"), (2, None)], "id int, text string")
    got = [(r.id, r.section_no, r.title, r.body) for r in chunking.sections(docs, "id", "text", "^#").orderBy("id", "section_no").collect()]
    assert got == [(1, 0, None, "intro"), (1, 1, "# a", "x\ny"), (1, 2, "# b", ""), (2, 0, None, "")]
    heads = frame(spark, [(1, "1"), (1, "1.2"), (1, "1.2.3"), (1, "4.5")], "doc int, number string")
    assert {r.number: r.parent for r in chunking.parents(heads, "doc", "number").collect()} == {"1": None, "1.2": "1", "1.2.3": "1.2", "4.5": None}
    chunks = frame(spark, [(1, 1, "a" * 200), (1, 2, "b"), (1, 3, "c"), (1, 4, "d" * 150)], "doc int, no int, text string")
    assert [r.text for r in chunking.merge_small(chunks, "doc", "no", "text", 120, 2000).orderBy("no").collect()] == ["a" * 200 + "\nb\nc", "d" * 150]


def test_parsers(spark, tmp_path):
    (tmp_path / "a.md").write_text("before\n# One\ntext\n## Two ##\nmore\n")
    got = [(r.section_no, r.level, r.title, r.body) for r in files.markdown_sections(spark, str(tmp_path / "a.md")).orderBy("section_no").collect()]
    assert got == [(0, None, None, "before"), (1, 1, "One", "text"), (2, 2, "Two", "more")]
    (tmp_path / "b.c").write_text('#include "lib/x.h"\n#define LIMIT 5\nstatic int add(int a, int b)\n{\n  return sum(a, b);\n}\n')
    code = str(tmp_path / "b.c")
    assert [(r.line_no, r.name, r.parameters, r.is_static) for r in files.c_functions(spark, code).collect()] == [(3, "add", "int a, int b", True)]
    assert {(r.line_no, r.callee) for r in files.c_calls(spark, code).collect()} == {(3, "add"), (5, "sum")}
    assert [(r.include, r.basename) for r in files.c_includes(spark, code).collect()] == [("lib/x.h", "x.h")]
    assert [(r.name, r.value) for r in files.c_defines(spark, code).collect()] == [("LIMIT", "5")]
    (tmp_path / "r.xml").write_text('<testsuite><testcase name="t1" classname="s" time="0.5"/><testcase name="t2" classname="s" time="1"><failure message="no">x</failure></testcase></testsuite>')
    assert {(r.name, r.status, r.duration_ms, r.message) for r in files.test_reports(spark, str(tmp_path / "r.xml")).collect()} == {("t1", "passed", 500, None), ("t2", "failed", 1000, "no")}
    (tmp_path / "w.json").write_text('[{"id": 1, "documentKey": "K-1", "fields": {"name": "n", "description": "<p>some <b>text</b></p>", "status": "10"}}]')
    item = files.work_items(spark, str(tmp_path / "w.json"), {"status": {"10": "open"}}).first()
    assert (item.document_key, item.description, item.status) == ("K-1", "some text", "open")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in files.listing(spark, str(tmp_path)).collect()}
    assert kinds == {"a.md": "markdown", "b.c": "source", "r.xml": "xml", "w.json": "json"}


def test_incremental_changes(spark):
    before = frame(spark, [("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    after = frame(spark, [("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert {(r.path, r.change_type) for r in incremental.changes(before, after).collect()} == {("b", "MODIFIED"), ("c", "DELETED"), ("d", "ADDED")}
    assert incremental.changes(after, after).count() == 0
    listed = frame(spark, [("a",)], "path string")
    assert {(r.path, r.change_type) for r in incremental.changes(after, after, listed).collect()} == {("a", "MODIFIED")}
    assert incremental.changes(before.limit(0), after).count() == 3


def test_nearest_equals_brute_force_over_several_blocks(spark, monkeypatch):
    import numpy as np

    from tesserine.operators import nearest

    monkeypatch.setattr(nearest, "POINTS", 64)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    vectors = np.random.default_rng(5).standard_normal((300, 8)).round(2)
    vectors[100:160] = vectors[3]  # a hot vector: ties go by id
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(vectors)] + [(300, None, [0.0] * 8)]
    points = spark.createDataFrame(rows, "vec_id long, label long, vector array<double>").repartition(3)
    found = nearest.nearest(points, points.filter("vec_id % 50 = 0"), 4, by_label=True).collect()
    unit = np.array([r[2] for r in rows])
    got, want = {}, {}
    for r in found:
        got.setdefault((r.query_id, r.label), []).append((-r.score, r.vec_id))
    for q in range(0, 301, 50):
        scores = nearest.cosines(unit, unit[q : q + 1])[0]
        for i, label, _ in rows:
            if i != q:
                want.setdefault((q, label), []).append((-scores[i], i))
    assert {k: sorted(v)[:4] for k, v in got.items()} == {k: sorted(v)[:4] for k, v in want.items()}


def test_whole_query_sets_hold_every_fiftieth_row(spark, small):
    from tesserine import registry

    registry.load()
    for key in ("knn_cosine", "knn_multi_collection", "rrf_weighted"):
        ids = {r.query_id for r in registry.queries()[key](spark, small).select("query_id").distinct().collect()}
        assert ids == set(range(0, 500, 50))


def test_sentences_and_their_scores(spark):
    from pyspark.sql import functions as F

    from tesserine.functions import text as T

    docs = frame(spark, [("See Dr. Smith, e.g. the other one. The end of the day! No. 5 vs. the rest etc. of the lot? Yes.",), (None,), (" ",), ("The register is set by ASIL rules; a (b).",)], "text string")
    got = [r[0] for r in docs.select(T.sentences(F.col("text"))).collect()]
    assert got == [["See Dr. Smith, e.g. the other one.", "The end of the day!", "No.", "5 vs. the rest etc. of the lot?", "Yes."], None, [], ["The register is set by ASIL rules; a (b)."]]
    scores = docs.select(F.transform(T.sentences(F.col("text")), lambda s: T.sentence_score(s, ("the",))).alias("s")).collect()
    assert scores[0].s == [1.0, 1.0, -0.3, 1.0, -0.3] and scores[3].s == [2.5]


def test_pack_bounds_its_groups_and_equals_the_whole_group(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    n = 4000
    items = pd.DataFrame({"query_id": np.where(np.arange(n) % 3, 1, np.arange(n) % 40), "item_id": np.arange(n), "slot": rng.choice(["a", "b", "c"], n), "score": rng.integers(0, 50, n) * 1.0, "tokens": rng.choice([0, 0, 7, 30, 45, 300], n)})
    budgets = {"a": 100, "b": 150, "d": 80}
    for cap in (60, 1000):
        want = {(q, i) for q, own in items.groupby("query_id") for i in packing.pack_group(own, budgets, cap)["item_id"]}
        got = packing.pack(spark.createDataFrame(items), budgets, cap).collect()
        assert len(got) == len(want) and {(r.query_id, r.item_id) for r in got} == want
    whole = packing.fill_slots

    def bounded(group, budgets):
        assert len(group) < 300
        return whole(group, budgets)

    monkeypatch.setattr(packing, "fill_slots", bounded)
    packing.pack(spark.createDataFrame(items), budgets, 60).collect()


def test_mentions_are_substrings_of_the_same_scope(spark):
    from tesserine.plans.traversals import mentions

    texts = spark.createDataFrame([(1, "a", "see x_0007y, N_14 and pre_x_1499y9"), (2, "a", None), (3, "b", "x_0007y"), (4, "a", "x_7 x_0007")], "k long, scope string, text string")
    names = spark.createDataFrame([(f"x_{i:04}y", "a") for i in range(1500)] + [("x_1499y", "a"), (None, "a"), ("n_14", "a")], "name string, scope string")
    assert {tuple(r) for r in mentions(texts, names, ("k",), "text", "scope").collect()} == {(1, "x_0007y"), (1, "x_1499y")}
    assert mentions(texts, names.limit(0), ("k",), "text", "scope").count() == 0


def test_overlays_with_repeated_keys(spark):
    prod = frame(spark, [(1, "a", 1), (2, "b", 2)], "k int, v string, ts int")
    over = frame(spark, [(1, "x", 5), (1, "y", 4), (3, "z", 1)], "k int, v string, ts int")
    assert {(r.k, r.v, r.origin) for r in overlay.shadow(prod, over, "k").collect()} == {(1, "y", "shadow"), (2, "b", "production"), (3, "z", "overlay")}
    assert {(r.k, r.v) for r in overlay.merge(prod, over, "k").collect()} == {(1, "y"), (2, "b"), (3, "z")}
    assert {(r.k, r.v) for r in overlay.merge_edges(prod, over, "k", by="ts").collect()} == {(1, "x"), (2, "b"), (3, "z")}


def test_lookups_push_keys_into_their_scans(spark, small):
    """No look-up reads a table whole, and lineitem is scanned only for parts and suppliers that are asked for."""
    from tesserine import registry

    registry.load()
    for key, lines in (("node_lookup", 0), ("neighbors_out", 0), ("neighbors_in", 1), ("neighbors_both", 1), ("batch_enrich", 1)):
        plan = registry.queries()[key](spark, small)._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
        assert scans and all("PushedFilters: [In(" in line or "PushedFilters: [Or(" in line or "EqualTo(" in line for line in scans), (key, scans)
        assert sum("lineitem" in line for line in scans) == lines, key


def test_hash_embeddings_and_name_ids(spark):
    import hashlib
    import uuid

    from pyspark.sql import functions as F

    from tesserine.functions import vectors

    texts = ["", "a", "größe", "long " * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vectors.hash_embedding(F.col("t")).alias("v"), vectors.name_uuid(F.col("t")).alias("u")).collect()
    for r in rows:
        seed, want = r.t.encode(), []
        while len(want) < 384:
            seed = hashlib.sha384(seed).digest()
            want += [b / 255 for b in seed]
        size = sum(x * x for x in want) ** 0.5
        assert max(abs(a - b / size) for a, b in zip(r.v, want, strict=True)) < 1e-12
        assert r.u == str(uuid.uuid5(uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), r.t))


def test_single_queue_equals_row_by_row(spark):
    import random

    rnd = random.Random(4)
    rows = [(k % 3, k, rnd.choice([0, 1, 5, 9, 30, 200])) for k in range(300)]
    items = frame(spark, rows, "query_id int, item_id int, tokens int")
    want = set()
    for q in range(3):
        left = 100
        for _, k, size in (r for r in rows if r[0] == q):
            if size <= left:
                left -= size
                want.add((q, k))
    assert {(r.query_id, r.item_id) for r in packing.take_in_order(items, 100).collect()} == want
