"""Ownership deletes, orders, JSON in noise, splitting of large texts and the rotating log, against plain Python."""

import json
import os
import random

import pytest

from tesserine.functions.json_text import first_object, object_in
from tesserine.operators import chunking, ordering, ownership
from tesserine.streaming import telemetry


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nodes_go_when_all_their_owners_are_gone(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        owns = {(rnd.randrange(k), k) for k in range(3, 60) for _ in range(rnd.randint(1, 3)) if k} | {(70, 71), (71, 70), (0, 70), (5, 5), (None, 3)}
        roots = {0, 1, rnd.randrange(3, 30)}
        real = [(a, b) for a, b in owns if a is not None and a != b]
        gone, grew = set(roots), True
        while grew:
            fresh = {b for _, b in real if b not in gone and all(a in gone for a, c in real if c == b)}
            gone, grew = gone | fresh, bool(fresh)
        got = ownership.gone_with(frame(spark, [(r,) for r in [*roots, 0]], "node long"), frame(spark, sorted(owns, key=str) * 2, "owner long, owned long")).collect()
        assert sorted(r.node for r in got) == sorted(gone)
    assert ownership.gone_with(frame(spark, [], "node long"), frame(spark, [(1, 2)], "owner long, owned long")).collect() == []


def test_only_partitions_that_lose_rows_are_written(spark, tmp_path):
    path = str(tmp_path / "edges")
    rows = [(i, i % 7, f"m{i % 5}") for i in range(100)]
    frame(spark, rows, "src long, dst long, module string").write.partitionBy("module").parquet(path)
    stamp = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = stamp()
    gone = {3, 8, *(i for i in range(100) if i % 5 == 4)} - {4, 6}
    gone = {g for g in gone if g > 6}
    touched = ownership.delete_rows(path, frame(spark, [(g,) for g in gone], "node long"), ("src", "dst"), "module")
    left = {tuple(r) for r in spark.read.parquet(path).select("src", "dst", "module").collect()}
    assert left == {r for r in rows if r[0] not in gone and r[1] not in gone}
    assert touched == sorted({r[2] for r in rows if r[0] in gone or r[1] in gone})
    after = stamp()
    assert all(after[f] == t for f, t in before.items() if not any(f"module={m}/" in f for m in touched))
    assert ownership.delete_rows(path, frame(spark, [(-1,)], "node long"), ("src", "dst"), "module") == []
    ownership.delete_rows(path, frame(spark, [(r[0],) for r in left if r[2] == "m0"], "node long"), ("src",), "module")
    assert not os.path.exists(f"{path}/module=m0")


def plain_order(functions, needs):
    of = {f: {n for x, n in needs if x == f and n in functions} for f in functions}
    degree = {f: len(d) for f, d in of.items()}
    queue = [f for f in functions if not degree[f]]
    out = []
    while queue:
        at = queue.pop(0)
        out.append(at)
        for other in functions:
            if at in of[other]:
                degree[other] -= 1
                if not degree[other]:
                    queue.append(other)
    return out + [f for f in functions if f not in out]


def test_order_equals_a_queue(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        names = [f"f{i}" for i in range(30)]
        rnd.shuffle(names)
        needs = [(rnd.choice(names), rnd.choice([*names, "outside"])) for _ in range(18 + 10 * seed)] + [("f3", "f4")] * 2
        got = ordering.suggest_order(frame(spark, [(n, k) for k, n in enumerate(names)], "node string, place int"), frame(spark, needs, "node string, need string")).collect()
        assert [r.node for r in sorted(got, key=lambda r: r.position)] == plain_order(names, needs)
        assert sorted(r.position for r in got) == list(range(30))
    assert ordering.suggest_order(frame(spark, [], "node string, place int"), frame(spark, [("a", "b")], "node string, need string")).collect() == []


def decoded(text):
    """The first object by trying a decoder at every brace."""
    for at in (i for i, c in enumerate(text) if c == "{"):
        try:
            return text[at : json.JSONDecoder().raw_decode(text, at)[1]]
        except ValueError:
            pass
    return None


def test_json_objects_in_noise(spark):
    rnd = random.Random(1)
    parts = ["{", "}", '"', "\\", '\\"', '"k"', ":", "1", ",", " ", "[", "]", '{"a": 1}', '{"b": {"c": "}"}}', '"x{y"', "word", "```", "null", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [None, "", "{" * 300, '{"a": ' * 200, json.dumps({"d": [{"e": 'q"{'}]}) + "}"]
    for text in texts:
        assert object_in(text) == (decoded(text) if text else None)
    rows = frame(spark, list(enumerate(texts[-60:])), "i int, t string").select("i", first_object("t").alias("o")).collect()
    assert {r.i: r.o for r in rows} == {i: object_in(t) for i, t in enumerate(texts[-60:])}


def test_large_texts_are_split_within_the_bound():
    rnd = random.Random(2)
    for seed in range(60):
        lines = [rnd.choice(["# head", "## sub", "### deep", "", "", "word " * rnd.randint(1, 30), "x" * rnd.randint(1, 300), "#no head"]) for _ in range(rnd.randint(0, 80))]
        text, most = "\n".join(lines), rnd.choice([20, 100, 400])
        spans = chunking.split_large(text, most)
        assert "".join(text[a:b] for a, b in spans) == text
        assert all(0 < b - a <= most for a, b in spans)
        lapped = chunking.split_large(text, most, 7)
        assert all(b - a <= most for a, b in lapped) and set(range(len(text))) == {i for a, b in lapped for i in range(a, b)}
    text = "# a\n" + "one " * 10 + "\n## b\n" + "two " * 30 + "\n\n" + "three " * 20 + "\n# c\nend"
    pieces = [text[a:b] for a, b in chunking.split_large(text, 160)]
    assert [p.split("\n")[0] for p in pieces] == ["# a", "## b", ("three " * 20), "# c"]
    with pytest.raises(ValueError):
        chunking.split_large("x", 5, 5)


def test_sections_at_the_chosen_depth(spark):
    text = "# 1 Intro\nx\n# 2 Api\n### 2.1.1 f\nbody f\n## 2.1 Calls\ny\n## 2.2 Types\n# 1 Intro\nlonger text\n"
    assert [(h[1], h[3]) for h in chunking.headings(text)] == [("1", 1), ("2", 1), ("2.1.1", 3), ("2.1", 2), ("2.2", 2), ("1", 1)]
    assert [(n, text[a:b].strip()) for n, _, a, b in chunking.at_depth(text)] == [("2", text[text.index("# 2") : text.rindex("# 1")].strip()), ("1", "# 1 Intro\nlonger text")]
    assert [n for n, *_ in chunking.at_depth(text, 2)] == ["2.1", "2.2"]
    plain = "# a\n## b\n## c\n# d\n## e\ntext"
    assert [(h[1], h[3]) for h in chunking.headings(plain)] == [("1", 1), ("1.1", 2), ("1.2", 2), ("2", 1), ("2.1", 2)]
    heads = chunking.headings(plain)
    assert chunking.split_depth(heads, len(plain)) == 2 and chunking.split_depth(heads, len(plain), 14) == 1 and chunking.split_depth([], 9) == 2
    rows = chunking.depth_sections(frame(spark, [(1, plain), (2, None), (3, "no heads")], "id int, t string"), "id", "t").collect()
    assert [(r.id, r.number, r.title, r.content) for r in rows] == [(1, "1.1", "b", "## b"), (1, "1.2", "c", "## c"), (1, "2.1", "e", "## e\ntext")]


def test_log_rotates_and_repeats_no_epoch(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "ts double, method string, query string"
    write = telemetry.log_each_batch(path, most_bytes=400, most_chars=5)
    assert telemetry.newest(spark, path, 3, schema).collect() == []
    batch = lambda e: frame(spark, [(e + k / 10, f"m{e}", "long query text") for k in range(4)], schema).coalesce(1)
    for epoch in (0, 0, 1, 1, 2):
        write(batch(epoch), epoch)
    got = [(r.ts, r.query) for r in telemetry.newest(spark, path, 5, schema).collect()]
    assert got == [(2.3, "long "), (2.2, "long "), (2.1, "long "), (2.0, "long "), (1.3, "long ")]
    write(batch(2), 2)  # the epoch runs again after a crash
    assert telemetry.newest(spark, path, 100, schema).count() == 12
    for epoch in range(3, 12):
        write(batch(epoch), epoch)
    generations = {p[0] for p in telemetry._parts(spark, path)}
    assert len(generations) <= 2 and min(generations) > 0
    assert [r.ts for r in telemetry.newest(spark, path, 2, schema).collect()] == [11.3, 11.2]


def test_exports_of_a_part_and_in_pages(spark, tmp_path):
    from pyspark.sql import functions as F

    from tesserine.operators.patterns import Graph
    from tesserine.sources import exports

    g = Graph(frame(spark, [("a", "X", 'q"uote'), ("b", "X", None), ("c", "Y", "n"), ("d", "Y", "n")], "id string, label string, name string"), frame(spark, [("a", "R", "b"), ("c", "R", "b"), ("c", "S", "d"), ("a", "R", "gone")], "src string, rel string, dst string"))
    part = exports.subgraph(g, frame(spark, [("a",)], "id string"), 1)
    lines = sorted(r.line for r in exports.graph_lines(part, ("name",)).collect())
    assert [json.loads(x) for x in lines] == [{"type": "edge", "src": "a", "rel": "R", "dst": "b"}, {"type": "node", "id": "a", "label": "X", "name": 'q"uote'}, {"type": "node", "id": "b", "label": "X"}]
    assert {r.id for r in exports.subgraph(g, frame(spark, [("a",)], "id string"), 3).nodes.collect()} == set("abcd")
    exports.write_lines(exports.graph_lines(g), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() == 8
    rows = spark.range(250).select((F.col("id") * 3).alias("vec_id"))
    exports.write_pages(rows.repartition(5), str(tmp_path / "v"), [F.asc("vec_id")], 10, pages_per_folder=10)
    back = spark.read.json(str(tmp_path / "v"))
    assert {(r.vec_id, r.page, r.place, r.folder) for r in back.collect()} == {(k * 3, k // 10, k % 10, k // 100) for k in range(250)}
