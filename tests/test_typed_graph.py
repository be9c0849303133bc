"""Patterns over the kept graph read the labels and relationships that they name, with keys pushed to Parquet."""

import re

import pytest

from tesserine import registry
from tesserine.plans.typed_graph import typed_graph

registry.load()


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan parquet" in line]


@pytest.mark.parametrize(
    ("key", "most", "pushed"),
    [
        ("template_prqs_for_shrq", 3, "EqualTo(key,SHRQ-5)"),
        ("template_full_traceability", 7, "EqualTo(key,SHRQ-3)"),
        ("template_release_scope", 3, "EqualTo(name,2.0)"),
        ("template_stakeholder_requirements", 3, "StringContains(name,AM)"),
        ("template_module_requirements", 3, "EqualTo(name,M2)"),
        ("template_ea_functions_for_module", 3, "EqualTo(name,M1)"),
    ],
)
def test_keyed_templates_push_their_key(spark, small, key, most, pushed):
    found = scans(registry.queries()[key](spark, small))
    assert 0 < len(found) <= most
    assert any(pushed in s for s in found)
    parts = [re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", s).group(1) for s in found]
    assert sum("rel" in p for p in parts) >= 1
    assert sum("label" in p or "rel" in p for p in parts) >= len(parts) - (key in ("template_release_scope", "template_module_requirements"))


def test_the_graph_is_written_once(spark, small):
    first, again = typed_graph(spark, small, "A"), typed_graph(spark, small, "A")
    assert sorted(first.nodes.inputFiles()) == sorted(again.nodes.inputFiles())
    assert first.edges.filter("rel = 'RAISED_BY'").count() == 25
