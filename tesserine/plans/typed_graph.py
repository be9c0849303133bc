"""The input tables as a typed V-model graph: requirements, design, tests, registers and diagrams.

One projection text serves Spark and the DuckDB oracles.  Nodes have ``id, label,
name, module, key, kind, status, note, seq, asil``; edges ``src, rel, dst, mark, seq``.
Modules are M0 to M4; a part is a design element, an order a test or a verification
step, a customer a product requirement, a nation a stakeholder requirement or a diagram.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import shared_folder
from ..operators.patterns import Graph
from ..sources.snapshots import Snapshots, fingerprint
from ..tables import table

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _text(prefix: str, key: str) -> str:
    return f"'{prefix}' || cast({key} as string)"


def _node(source: str, label: str, prefix: str, own: str, where: str = "", /, **columns: str) -> str:
    kinds = {"name": "string", "module": "string", "key": "string", "kind": "string", "status": "string", "note": "string", "seq": "bigint", "asil": "bigint"}
    rest = ", ".join(f"cast({columns.get(c, 'null')} as {t}) as {c}" for c, t in kinds.items())
    return f"select {_text(prefix, own)} as id, {label} as label, {rest} from {{{source}}}{' where ' + where if where else ''}"


def _edge(rel: str, source: str, src: tuple[str, str], dst: tuple[str, str], where: str = "", mark: str = "null", seq: str = "null") -> str:
    return f"select {_text(*src)} as src, '{rel}' as rel, {_text(*dst)} as dst, cast({mark} as string) as mark, cast({seq} as bigint) as seq from {{{source}}}{' where ' + where if where else ''}"


def _pick(key: str, n: int, *labels: str) -> str:
    return f"case {key} % {n} " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(labels[:-1])) + f" else '{labels[-1]}' end"


_DECADE = "cast((p_partkey - p_partkey % 10) / 10 as bigint) % 5"
_ASIL = "case {0} % 3 when 0 then null when 1 then 348 else 349 end"
_DESIGN = _pick("p_partkey", 10, "EA_DataType", "EA_ConfigContainer", "EA_ConfigParameter", "EA_ErrorCode", "EA_DesignDecision", "EA_SourceFile", "EA_MemorySection", "EA_Function")
_CODE = _pick("p_partkey", 10, "DataType", "Parameter", "Operation", "ProgrammingSequence", "SequenceStep", "SequenceDiagram", "HwConstraint", "Function")
_TEST = _pick("o_orderkey", 8, "TS_FunctionalTestCase", "TS_ConfigTestCase", "TS_WCETTestCase", "TS_StaticTestCase", "VerificationStep")
_RUN = _pick("o_orderkey", 4, "TestResult", "TestSpecification")
_DIAGRAM = _pick("c_nationkey", 3, "EA_ActivityNode", "EA_SeqParticipant", "EA_State")
_MODULE = "'M' || cast({0} % 5 as string)"

_SHARED_NODES = [_node("region", "'MCALModule'", "M", "r_regionkey", name=_text("M", "r_regionkey"), module=_text("M", "r_regionkey"))]
NODES_A = " union all ".join([
    *_SHARED_NODES,
    _node("region", "'Stakeholder'", "SH", "r_regionkey", name="r_name"),
    _node("region", "'SoftwareRelease'", "R", "r_regionkey", "r_regionkey < 3", name="cast(r_regionkey + 1 as string) || '.0'"),
    _node("region", "'TS_TestSpecDocument'", "T", "r_regionkey", name=_text("spec_", "r_regionkey"), module=_text("M", "r_regionkey")),
    _node("nation", "'StakeholderRequirement'", "N", "n_nationkey", name="n_name", key=_text("SHRQ-", "n_nationkey"), asil=_ASIL.format("n_nationkey")),
    _node("nation", "'EA_Requirement'", "ER", "n_nationkey", name="n_name"),
    _node("nation", "'EA_Diagram'", "D", "n_nationkey", name=_text("diagram_", "n_nationkey"), module=_MODULE.format("n_regionkey"), kind=_pick("n_nationkey", 3, "activity", "sequence", "state"), seq="n_nationkey * 2"),
    _node("customer", "'ProductRequirement'", "C", "c_custkey", name="c_name", module=_MODULE.format("c_custkey"), key=_text("PRQ-", "c_custkey"), status="case when c_acctbal < 0 then 'open' else 'approved' end", asil=_ASIL.format("c_nationkey")),
    _node("customer", _DIAGRAM, "A", "c_custkey", name=_text("step_", "c_custkey"), kind="c_mktsegment", seq="c_custkey"),
    _node("supplier", _pick("s_suppkey", 4, "EA_HwPeripheral", "EA_Register"), "S", "s_suppkey", name="s_name", module=_MODULE.format("s_suppkey"), seq="s_suppkey"),
    _node("part", _DESIGN, "P", "p_partkey", name=_text("item_", "p_partkey"), module=_text("M", _DECADE), kind="p_type", note="p_name", seq="p_size"),
    _node("orders", _TEST, "O", "o_orderkey", name=_text("test_", "o_orderkey"), module=_MODULE.format("o_orderkey"), key=_text("TC-", "o_orderkey"), kind="o_orderpriority", status="o_orderstatus", seq="o_orderkey"),
    _node("lineitem", "'VerificationReport'", "V", "l_orderkey", "l_linenumber = 1", name=_text("report_", "l_orderkey"), status="l_returnflag"),
])
EDGES_A = " union all ".join([
    _edge("DERIVES_FROM", "customer", ("C", "c_custkey"), ("N", "c_nationkey")),
    _edge("VERIFIED_BY", "orders", ("C", "o_custkey"), ("O", "o_orderkey"), "o_orderkey % 8 >= 4"),
    _edge("HAS_RESULT", "lineitem", ("O", "l_orderkey"), ("V", "l_orderkey"), "l_linenumber = 1"),
    _edge("BELONGS_TO_MODULE", "customer", ("C", "c_custkey"), ("M", "c_custkey % 5")),
    _edge("RAISED_BY", "nation", ("N", "n_nationkey"), ("SH", "n_regionkey")),
    _edge("TARGETED_FOR", "customer", ("C", "c_custkey"), ("R", "c_custkey % 3")),
    _edge("EA_BELONGS_TO_MODULE", "part", ("P", "p_partkey"), ("M", _DECADE)),
    _edge("EA_BELONGS_TO_MODULE", "supplier", ("S", "s_suppkey"), ("M", "s_suppkey % 5")),
    _edge("EA_BELONGS_TO_MODULE", "nation", ("D", "n_nationkey"), ("M", "n_regionkey % 5")),
    _edge("EA_IMPLEMENTS", "part", ("P", "p_partkey"), ("ER", "p_size % 25"), "p_partkey % 10 <> 3"),
    _edge("EA_DEPENDS_ON", "part", ("P", "p_partkey"), ("P", "p_partkey - p_partkey % 10 + 3"), "p_partkey % 10 > 6"),
    _edge("EA_DEPENDS_ON", "part", ("P", "p_partkey"), ("P", "p_partkey - p_partkey % 10"), "p_partkey % 10 > 7"),
    _edge("EA_CALLS", "part", ("P", "p_partkey"), ("P", "p_partkey + 10"), "p_partkey % 10 > 6"),
    _edge("EA_CALLS", "part", ("P", "p_partkey"), ("P", "p_partkey + 1"), "p_partkey % 10 in (7, 8)"),
    _edge("EA_EXTERNAL_DEP", "part", ("P", "p_partkey"), ("P", "p_partkey + 20"), "p_partkey % 10 = 8"),
    _edge("EA_ACCESSES_REGISTER", "lineitem", ("P", "l_partkey"), ("S", "l_suppkey"), "l_partkey % 10 > 6 group by l_partkey, l_suppkey", "min(l_returnflag)"),
    _edge("EA_AGGREGATES", "part", ("P", "p_partkey"), ("P", "p_partkey + 1"), "p_partkey % 10 = 1"),
    _edge("EA_AGGREGATES", "supplier", ("S", "s_suppkey - s_suppkey % 4"), ("S", "s_suppkey"), "s_suppkey % 4 > 0"),
    _edge("TS_BELONGS_TO_MODULE", "orders", ("O", "o_orderkey"), ("M", "o_orderkey % 5"), "o_orderkey % 8 < 4"),
    _edge("TS_VERIFIES", "orders", ("O", "o_orderkey"), ("C", "o_custkey"), "o_orderkey % 8 < 4"),
    _edge("TS_VALIDATES_EA", "lineitem", ("O", "l_orderkey"), ("P", "l_partkey"), "l_linenumber <= 2 and l_orderkey % 8 = 0"),
    _edge("TS_TESTS_CONFIG_ELEMENT", "lineitem", ("O", "l_orderkey"), ("P", "l_partkey"), "l_linenumber <= 2 and l_orderkey % 8 = 1"),
    _edge("TS_MEASURES_TIMING_OF", "lineitem", ("O", "l_orderkey"), ("P", "l_partkey"), "l_linenumber = 1 and l_orderkey % 8 = 2"),
    _edge("TS_CONTAINS_TESTCASE", "orders", ("T", "o_orderkey % 5"), ("O", "o_orderkey"), "o_orderkey % 8 < 4"),
    _edge("PART_OF", "customer", ("A", "c_custkey"), ("D", "c_nationkey")),
    _edge("EA_CONTROL_FLOW", "orders", ("A", "o_custkey"), ("A", "o_orderkey % 97"), "", "o_orderpriority"),
    _edge("EA_SEQ_MESSAGE", "orders", ("A", "o_custkey"), ("A", "o_orderkey % 89"), "", "o_orderpriority", "o_orderkey"),
    _edge("EA_STATE_TRANSITION", "orders", ("A", "o_custkey"), ("A", "o_orderkey % 83"), "", "o_orderstatus"),
    _edge("APPEARS_IN", "part", ("P", "p_partkey"), ("D", "p_size % 25")),
])
NODES_B = " union all ".join([
    *_SHARED_NODES,
    _node("region", "'HardwareSubModule'", "H", "r_regionkey", name="r_name", module=_text("M", "r_regionkey"), kind="cast(r_regionkey * 4096 as string)"),
    _node("region", "'AccessMode'", "AM", "r_regionkey", name="r_name"),
    _node("nation", "'Mechanism'", "N", "n_nationkey", name="n_name"),
    _node("customer", "'Requirement'", "C", "c_custkey", name="c_name", module=_MODULE.format("c_custkey"), key=_text("REQ-", "c_custkey")),
    _node("customer", "'Error'", "E", "c_custkey", "c_custkey % 10 = 0", name=_text("error_", "c_custkey"), note="c_mktsegment"),
    _node("supplier", "'HardwareRegister'", "S", "s_suppkey", name="s_name", module=_MODULE.format("s_suppkey"), kind="cast(s_suppkey * 4 as string)"),
    _node("supplier", "'RegisterField'", "F", "s_suppkey", name=_text("field_", "s_suppkey"), kind="cast(s_suppkey % 8 as string)", note="s_name"),
    _node("part", _CODE, "P", "p_partkey", name=_text("item_", "p_partkey"), module=_MODULE.format("p_partkey"), kind="p_type", note="p_name", status="p_brand", seq="p_size"),
    _node("orders", _RUN, "O", "o_orderkey", name=_text("test_", "o_orderkey"), key=_text("T-", "o_orderkey"), status="o_orderstatus"),
])
EDGES_B = " union all ".join([
    _edge("IMPLEMENTS", "part", ("P", "p_partkey"), ("C", "p_partkey % 100"), "p_partkey % 10 > 6"),
    _edge("TRACES_TO", "orders", ("O", "o_orderkey"), ("C", "o_custkey"), "o_orderkey % 4 > 0"),
    _edge("VERIFIES", "orders", ("O", "o_orderkey"), ("O", "o_orderkey + 1"), "o_orderkey % 4 = 0"),
    _edge("DEPENDS_ON", "part", ("P", "p_partkey"), ("P", "p_partkey + 10"), "p_partkey % 10 > 6"),
    _edge("DEPENDS_ON", "part", ("P", "p_partkey"), ("P", "p_partkey + 1"), "p_partkey % 10 in (7, 8)"),
    _edge("FOLLOWS_SEQUENCE", "lineitem", ("O", "l_orderkey"), ("P", "l_partkey"), "l_linenumber = 1"),
    _edge("HAS_FIELD", "supplier", ("S", "s_suppkey"), ("F", "s_suppkey")),
    _edge("HAS_FIELD", "supplier", ("S", "s_suppkey - s_suppkey % 2"), ("F", "s_suppkey"), "s_suppkey % 2 = 1"),
    _edge("HAS_ACCESS_TYPE", "supplier", ("F", "s_suppkey"), ("AM", "s_suppkey % 5")),
    _edge("HAS_PARAMETER", "part", ("P", "p_partkey"), ("P", "p_partkey - p_partkey % 10 + 1"), "p_partkey % 10 > 6"),
    _edge("OF_TYPE", "part", ("P", "p_partkey"), ("P", "p_partkey - 1"), "p_partkey % 10 = 1"),
    _edge("DETECTED_BY", "customer", ("E", "c_custkey"), ("N", "c_nationkey"), "c_custkey % 10 = 0"),
    _edge("HAS_CONSTRAINT", "part", ("S", "p_size % 10"), ("P", "p_partkey"), "p_partkey % 10 = 6"),
    _edge("HAS_CONSTRAINT", "part", ("F", "p_size % 9"), ("P", "p_partkey"), "p_partkey % 10 = 6"),
    _edge("HAS_CONSTRAINT", "part", ("P", "p_partkey - 2"), ("P", "p_partkey"), "p_partkey % 10 = 6"),
    _edge("HAS_STEP", "part", ("P", "p_partkey - 1"), ("P", "p_partkey"), "p_partkey % 10 = 4"),
    _edge("HAS_STEP", "part", ("P", "p_partkey + 9"), ("P", "p_partkey"), "p_partkey % 10 = 4"),
    _edge("STEP_OPERATION", "part", ("P", "p_partkey"), ("P", "p_partkey - 2"), "p_partkey % 20 = 4"),
    _edge("STEP_USES_REGISTER", "part", ("P", "p_partkey"), ("S", "p_size % 10"), "p_partkey % 10 = 4", "p_brand"),
    _edge("ACCESSES_REGISTER", "lineitem", ("P", "l_partkey"), ("S", "l_suppkey"), "l_partkey % 10 > 6 group by l_partkey, l_suppkey", "min(l_returnflag)"),
    _edge("BITFIELD_CONTROLS", "part", ("F", "p_size % 10"), ("P", "p_partkey"), "p_partkey % 10 = 2"),
    _edge("REALIZES_SEQUENCE", "part", ("P", "p_partkey"), ("P", "p_partkey - p_partkey % 10 + 3"), "p_partkey % 10 > 6"),
    _edge("PART_OF_SUBMODULE", "supplier", ("S", "s_suppkey"), ("H", "s_suppkey % 5"), "", "cast(s_suppkey * 16 as string)"),
])


def _projected(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text})


def typed_graph(spark: SparkSession, sf_dir: str, profile: str) -> Graph:
    """The strict (``A``) or relaxed (``B``) profile's graph, kept as Parquet in the shared folder.

    Nodes are folders by label, relationships folders by type, so a pattern reads the labels and types that it names and nothing
    else, and conditions on keys, names and ids reach Parquet.  The graph is written
    when the tables' files are new or changed, and read from then on.
    """
    mark = hashlib.md5("".join(fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in _TABLES).encode()).hexdigest()
    store = Snapshots(spark, f"{shared_folder(spark)}/graph-{profile}-{mark}")
    if store.current() is None:
        nodes, edges = (_projected(spark, sf_dir, text) for text in ((NODES_A, EDGES_A) if profile == "A" else (NODES_B, EDGES_B)))
        placed = nodes.repartitionByRange("label", "key", "name", "id").sortWithinPartitions("label", "key", "name", "id")
        typed = edges.repartitionByRange("rel", "src", "dst").sortWithinPartitions("rel", "src", "dst")
        store.stage({"nodes": placed, "edges": typed}, partition_by={"nodes": ["label"], "edges": ["rel"]})
        store.commit()
    return Graph(store.read("nodes").select("id", "label", "name", "module", "key", "kind", "status", "note", "seq", "asil"), store.read("edges").select("src", "rel", "dst", "mark", "seq"))


def sql_graph(profile: str) -> str:
    """The same as common table expressions ``n`` and ``e`` for an oracle, each computed once."""
    nodes, edges = (NODES_A, EDGES_A) if profile == "A" else (NODES_B, EDGES_B)
    return f"with n as materialized ({nodes}), e as materialized ({edges}) ".format(**{t: t for t in _TABLES})
