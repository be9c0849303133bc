"""Every builder against a row-by-row build in Python, on random rows with nulls, repeats and dangling ends."""

import random

import pytest

from tesserine.operators.build import build
from tesserine.plans.builders import BUILDERS


def made(spec, seed):
    """Random sources with the columns that a specification names; some keys are shared between columns, so edges meet."""
    rnd, lists = random.Random(seed), {(e.source, e.dst[1]) for e in spec.edges if e.dst[1].endswith("s") and e.dst[1] not in ("status",)}
    columns = {}
    for rule in (*spec.nodes, *spec.edges):
        own = columns.setdefault(rule.source, set())
        own.update(rule.props)
        own.update({rule.key} if hasattr(rule, "key") else {rule.src[1], rule.dst[1]})
        own.update({rule.where[0]} if rule.where else ())
    values = {rule.where for rule in (*spec.nodes, *spec.edges) if rule.where}
    out = {}
    for source, names in columns.items():
        rows = []
        for _ in range(25):
            row = {}
            for name in sorted(names):
                fixed = [v for k, v in sorted(values) if k == name]
                value = rnd.choice([*fixed, "other"]) if fixed else rnd.choice([None, *"abcdefg"])
                row[name] = [rnd.choice([None, *"abcdefg"]) for _ in range(rnd.randint(0, 3))] if (source, name) in lists else value
            rows.append(row)
        out[source] = (rows, ", ".join(f"{n} {'array<string>' if (source, n) in lists else 'string'}" for n in sorted(names)))
    return out


def brute(spec, sources):
    nodes, edges = {}, {}
    for rule in spec.nodes:
        given = {}
        for row in sources[rule.source][0]:
            if row[rule.key] is not None and (rule.where is None or row[rule.where[0]] == rule.where[1]):
                own = given.setdefault(f"{rule.label}:{row[rule.key]}", {})
                for p in rule.props:
                    if row[p] is not None:
                        own[p] = max(own.get(p, ""), str(row[p]))
        for key, props in given.items():
            nodes.setdefault(key, {}).update(props)
    for rule in spec.edges:
        for row in sources[rule.source][0]:
            if rule.where and row[rule.where[0]] != rule.where[1]:
                continue
            far = row[rule.dst[1]]
            for end in far if isinstance(far, list) else [far]:
                key = (f"{rule.src[0]}:{row[rule.src[1]]}", rule.rel, f"{rule.dst[0]}:{end}")
                if key[0] in nodes and key[2] in nodes:
                    own = edges.setdefault(key, {})
                    for p in rule.props:
                        if row[p] is not None:
                            own[p] = max(own.get(p, ""), row[p])
    return nodes, edges


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_builder_equals_row_by_row(spark, name):
    spec = BUILDERS[name]
    sources = made(spec, len(name))
    frames = {k: spark.createDataFrame([tuple(r[c] for c in sorted(r)) for r in rows], schema) for k, (rows, schema) in sources.items()}
    g = build(spec, frames)
    nodes, edges = brute(spec, sources)
    assert {r.id: dict(r.props) for r in g.nodes.collect()} == nodes
    assert {(r.src, r.rel, r.dst): dict(r.props) for r in g.edges.collect()} == edges


def test_the_newest_property_wins(spark):
    from tesserine.operators.build import Node, Spec

    rows = [("a", "9", "2024-01-01 00:00:00"), ("a", "10", "2024-03-01 00:00:00"), ("a", None, "2025-01-01 00:00:00"), ("b", "x", None), ("b", "y", None), (None, "z", None)]
    frame = spark.createDataFrame(rows, "key string, version string, changed string")
    spec = Spec((Node("Item", "items", "key", ("version",), newest="changed"),))
    assert {r.key: dict(r.props) for r in build(spec, {"items": frame}).nodes.collect()} == {"a": {"version": "10"}, "b": {"version": "y"}}


def test_functions_use_the_types_of_their_signatures(spark):
    functions = spark.createDataFrame([("f", "a.c", "inline", ["State", "uint8"]), ("g", "a.c", "State", [])], "name string, file string, kind string, types array<string>")
    empty = lambda schema: spark.createDataFrame([], schema)
    sources = {
        "functions": functions, "types": spark.createDataFrame([("State", "struct")], "name string, kind string"), "registers": empty("name string, address string"), "fields": empty("name string, low string, high string, register string"),
        "calls": empty("caller string, callee string, place string"), "accesses": empty("function string, register string, access string"),
    }
    g = build(BUILDERS["relaxed_parsers"], sources)
    assert [(r.src, r.rel, r.dst) for r in g.edges.collect()] == [("Function:f", "USES_TYPE", "Struct:State")]


def test_test_specification_from_its_sheets(spark):
    from tesserine.plans.builders import specification_sources

    rows = [
        ("d/spec.xlsx", "Functional", "T1", "check Adc_Init and Adc_Read twice", "auto", "PRQ-1; PRQ-2,PRQ-9", "{G1} {G7}", None, "open"), ("d/spec.xlsx", "Config tests", "T2", "values", None, "PRQ-1", None, " AdcMax ", "done"),
        ("d/spec.xlsx", "Timing", "T3", "WCET", None, "PRQ-1", None, "Adc_Read", None), ("d/spec.xlsx", "Static interface", "T4", None, None, "PRQ-2", None, "Adc_Read", None), ("d/spec.xlsx", "Functional", None, "no id", None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "path string, sheet string, test_id string, objective string, method string, requirement string, design string, target string, status string")
    items = spark.createDataFrame([("PRQ-1",), ("PRQ-2",)], "key string")
    elements = spark.createDataFrame([("{G1}", "Adc_Init", "EA_Function"), ("{G2}", "Adc_Read", "EA_Function"), ("{G3}", "AdcMax", "EA_ConfigParameter")], "element_id string, name string, label string")
    g = build(BUILDERS["test_specification"], specification_sources(frame, "ADC", items, elements))
    got = {(r.src.split(":")[1], r.rel, r.dst.split(":")[1]) for r in g.edges.collect()}
    checks = {("T1", "PRQ-1"), ("T1", "PRQ-2"), ("T2", "PRQ-1"), ("T4", "PRQ-2")}
    valid = {("T1", "{G1}"), ("T1", "{G2}")}
    assert got == {(a, "TS_VERIFIES", b) for a, b in checks} | {(a, "TS_VALIDATES_EA", b) for a, b in valid} | {(b, "TRACES_TO", a) for a, b in valid} | {("T2", "TS_TESTS_CONFIG_ELEMENT", "{G3}"), ("T3", "TS_MEASURES_TIMING_OF", "{G2}")} | {
        (t, "TS_BELONGS_TO_MODULE", "ADC") for t in ("T1", "T2", "T3", "T4")
    } | {("spec.xlsx", "TS_CONTAINS_TESTCASE", t) for t in ("T1", "T2", "T3", "T4")}
    assert {r.label for r in g.nodes.filter("key like 'T%'").collect()} == {"TS_FunctionalTestCase", "TS_ConfigTestCase", "TS_StaticTestCase", "TS_WCETTestCase"}
