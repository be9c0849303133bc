"""The 48 named query templates, each a function of a graph and its parameters.

``TEMPLATES_A`` (strict profile) and ``TEMPLATES_B`` (relaxed profile) map names to
functions ``(graph, **parameters)``; any graph with the columns of
:mod:`typed_graph` will do.  Results are not sorted, but for their list columns; callers order
what they show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import Graph, listed
from ..registry import register
from .typed_graph import sql_graph, typed_graph

TEMPLATES_A: dict[str, Callable[..., DataFrame]] = {}
TEMPLATES_B: dict[str, Callable[..., DataFrame]] = {}
C = F.col
_SET = "coalesce((select string_agg(distinct {value}, ', ' order by {value}) from e join n x on x.id = e.{far} where e.{near} = {start}.id and e.rel = '{rel}'{more}), '')"


def _set(start: str, rel: str, value: str = "x.name", back: bool = False, more: str = "") -> str:
    """SQL of a gathered list."""
    return _SET.format(start=start, rel=rel, value=value, near="dst" if back else "src", far="src" if back else "dst", more=f" and {more}" if more else "")


def template(profile: str, sql: str, **example: object):
    """Keep ``fn(graph, **parameters)`` under its name, and register it with example parameters; ``sql`` is the rest of its oracle."""

    def keep(fn: Callable[..., DataFrame]):
        (TEMPLATES_A if profile == "A" else TEMPLATES_B)[fn.__name__] = fn

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(typed_graph(spark, sf_dir, profile), **example)

        register(f"template_{fn.__name__}", sql_graph(profile) + sql)(run)
        return fn

    return keep


def _of_module(g: Graph, alias: str, module: str, *labels: str, rel: str = "EA_BELONGS_TO_MODULE") -> DataFrame:
    return g.hop(g.scan(alias, *labels), alias, rel, "m", "MCALModule", name=module)


# Strict profile: requirements and releases.


@template(
    "A",
    "select n.key as shrq, p.key as prq, s.name as step, r.name as report from n join e a on a.dst = n.id and a.rel = 'DERIVES_FROM' join n p on p.id = a.src join e b on b.src = p.id and b.rel = 'VERIFIED_BY' join n s on s.id = b.dst join e c on c.src = s.id and c.rel = 'HAS_RESULT' join n r on r.id = c.dst where n.label = 'StakeholderRequirement' and n.key = 'SHRQ-3'",
    shrq_id="SHRQ-3",
)
def full_traceability(g: Graph, shrq_id: str) -> DataFrame:
    rows = g.hop(g.scan("s", "StakeholderRequirement", key=shrq_id), "s", "DERIVES_FROM", "p", "ProductRequirement", back=True)
    rows = g.hop(g.hop(rows, "p", "VERIFIED_BY", "v", "VerificationStep"), "v", "HAS_RESULT", "r", "VerificationReport")
    return rows.select(C("s.key").alias("shrq"), C("p.key").alias("prq"), C("v.name").alias("step"), C("r.name").alias("report"))


@template("A", "select p.key as prq, p.name from n join e on e.dst = n.id and rel = 'DERIVES_FROM' join n p on p.id = e.src where n.key = 'SHRQ-5' and n.label = 'StakeholderRequirement'", shrq_id="SHRQ-5")
def prqs_for_shrq(g: Graph, shrq_id: str) -> DataFrame:
    return g.hop(g.scan("p", "ProductRequirement"), "p", "DERIVES_FROM", "s", "StakeholderRequirement", key=shrq_id).select(C("p.key").alias("prq"), "p.name")


@template("A", "select key as prq from n where label = 'ProductRequirement' and not exists (select 1 from e join n v on v.id = e.dst where e.src = n.id and rel = 'VERIFIED_BY' and v.label = 'VerificationStep')")
def uncovered_prqs(g: Graph) -> DataFrame:
    return g.without(g.scan("p", "ProductRequirement"), "p", "VERIFIED_BY", "VerificationStep").select(C("p.key").alias("prq"))


@template("A", "select n.key, n.name from n join e on e.src = n.id and rel = 'BELONGS_TO_MODULE' where e.dst = 'M2'", module="M2")
def module_requirements(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "n", module, rel="BELONGS_TO_MODULE").select("n.key", "n.name")


@template("A", "select key, label, asil from n where label in ('StakeholderRequirement', 'ProductRequirement') and asil is not null and asil <> 348", none=348)
def safety_requirements(g: Graph, none: int) -> DataFrame:
    """Requirements with a safety level other than the code for none."""
    return g.scan("r", "StakeholderRequirement", "ProductRequirement", where=C("asil").isNotNull() & (C("asil") != none)).select("r.key", "r.label", "r.asil")


@template("A", "select n.key as shrq, s.name as stakeholder from n join e on e.src = n.id and rel = 'RAISED_BY' join n s on s.id = e.dst where s.name like '%AM%'", stakeholder_name="AM")
def stakeholder_requirements(g: Graph, stakeholder_name: str) -> DataFrame:
    return g.hop(g.scan("s", "StakeholderRequirement"), "s", "RAISED_BY", "h", "Stakeholder", where=C("name").contains(stakeholder_name)).select(C("s.key").alias("shrq"), C("h.name").alias("stakeholder"))


@template("A", "select n.key, n.name from n join e on e.src = n.id and rel = 'TARGETED_FOR' join n r on r.id = e.dst where r.name = '2.0'", version="2.0")
def release_scope(g: Graph, version: str) -> DataFrame:
    return g.hop(g.scan("n"), "n", "TARGETED_FOR", "r", "SoftwareRelease", name=version).select("n.key", "n.name")


# Strict profile: design.

_IN = "from n join e on e.src = n.id and e.rel = 'EA_BELONGS_TO_MODULE' join n m on m.id = e.dst and m.label = 'MCALModule' where m.name = '{}' and n.label = '{}'"


@template("A", f"select n.kind, n.name {_IN.format('M1', 'EA_Function')}", module="M1")
def ea_functions_for_module(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "f", module, "EA_Function").select("f.kind", "f.name")


@template(
    "A",
    f"select n.name, {_set('n', 'EA_IMPLEMENTS')} as requirements, {_set('n', 'EA_DEPENDS_ON')} as dependencies, {_set('n', 'EA_CALLS', more='x.label = ' + repr('EA_Function'))} as calls, {_set('n', 'EA_ACCESSES_REGISTER', more='x.label = ' + repr('EA_Register'))} as registers_accessed from n where label = 'EA_Function' and name = 'item_18'",
    func_name="item_18",
)
def ea_function_detail(g: Graph, func_name: str) -> DataFrame:
    rows = g.gather(g.scan("f", "EA_Function", name=func_name), "f", "EA_IMPLEMENTS", "name", "requirements", "EA_Requirement")
    rows = g.gather(g.gather(rows, "f", "EA_DEPENDS_ON", "name", "dependencies"), "f", "EA_CALLS", "name", "calls", "EA_Function")
    rows = g.gather(rows, "f", "EA_ACCESSES_REGISTER", "name", "registers_accessed", "EA_Register")
    return rows.select("f.name", *(listed(c).alias(c) for c in ("requirements", "dependencies", "calls", "registers_accessed")))


@template("A", "select x.name as error_code, x.note as description from n join e on e.src = n.id and rel = 'EA_DEPENDS_ON' join n x on x.id = e.dst and x.label = 'EA_ErrorCode' where n.name = 'item_28'", func_name="item_28")
def ea_function_error_codes(g: Graph, func_name: str) -> DataFrame:
    return g.hop(g.scan("f", "EA_Function", name=func_name), "f", "EA_DEPENDS_ON", "e", "EA_ErrorCode").select(C("e.name").alias("error_code"), C("e.note").alias("description"))


@template("A", f"select n.name as type_name, n.kind as type_kind, n.note as description {_IN.format('M0', 'EA_DataType')}", module="M0")
def ea_datatypes_for_module(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "d", module, "EA_DataType").select(C("d.name").alias("type_name"), C("d.kind").alias("type_kind"), C("d.note").alias("description"))


@template("A", f"select n.name as container, {_set('n', 'EA_AGGREGATES', more='x.label = ' + repr('EA_ConfigParameter'))} as parameters {_IN.format('M3', 'EA_ConfigContainer')}", module="M3")
def ea_config_for_module(g: Graph, module: str) -> DataFrame:
    rows = g.gather(_of_module(g, "c", module, "EA_ConfigContainer"), "c", "EA_AGGREGATES", "name", "parameters", "EA_ConfigParameter")
    return rows.select(C("c.name").alias("container"), listed("parameters").alias("parameters"))


@template(
    "A",
    f"select n.name as parameter, c.name as parent_container, {_set('n', 'EA_IMPLEMENTS')} as requirements from n left join (select e.dst, x.name from e join n x on x.id = e.src where rel = 'EA_AGGREGATES') c on c.dst = n.id where n.label = 'EA_ConfigParameter' and n.name = 'item_12'",
    parameter="item_12",
)
def ea_config_parameter_detail(g: Graph, parameter: str) -> DataFrame:
    rows = g.hop(g.scan("p", "EA_ConfigParameter", name=parameter), "p", "EA_AGGREGATES", "c", back=True, optional=True)
    rows = g.gather(rows, "p", "EA_IMPLEMENTS", "name", "requirements", "EA_Requirement")
    return rows.select(C("p.name").alias("parameter"), C("c.name").alias("parent_container"), listed("requirements").alias("requirements"))


@template("A", f"select n.name as decision, n.note as description {_IN.format('M1', 'EA_DesignDecision')}", module="M1")
def ea_design_decisions_for_module(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "d", module, "EA_DesignDecision").select(C("d.name").alias("decision"), C("d.note").alias("description"))


@template("A", f"select n.name as file, n.kind as file_kind {_IN.format('M2', 'EA_SourceFile')}", module="M2")
def ea_files_for_module(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "s", module, "EA_SourceFile").select(C("s.name").alias("file"), C("s.kind").alias("file_kind"))


@template("A", f"select n.name as section, n.note as description {_IN.format('M4', 'EA_MemorySection')}", module="M4")
def ea_memory_sections_for_module(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "s", module, "EA_MemorySection").select(C("s.name").alias("section"), C("s.note").alias("description"))


@template("A", f"select n.name as peripheral, {_set('n', 'EA_AGGREGATES')} as registers {_IN.format('M0', 'EA_HwPeripheral')}", module="M0")
def ea_hw_peripherals_for_module(g: Graph, module: str) -> DataFrame:
    rows = g.gather(_of_module(g, "h", module, "EA_HwPeripheral"), "h", "EA_AGGREGATES", "name", "registers", "EA_Register")
    return rows.select(C("h.name").alias("peripheral"), listed("registers").alias("registers"))


_PAIR = "from n join e on e.src = n.id and e.rel = '{}' join n x on x.id = e.dst where n.module = '{}'"


@template("A", f"select n.name as caller, x.name as callee, n.kind as caller_kind, x.kind as callee_kind {_PAIR.format('EA_CALLS', 'M1')} and n.label = 'EA_Function' and x.label = 'EA_Function'", module="M1")
def ea_call_graph(g: Graph, module: str) -> DataFrame:
    rows = g.hop(g.scan("a", "EA_Function", module=module), "a", "EA_CALLS", "b", "EA_Function")
    return rows.select(C("a.name").alias("caller"), C("b.name").alias("callee"), C("a.kind").alias("caller_kind"), C("b.kind").alias("callee_kind"))


@template("A", f"select n.name as function_name, x.name as external_dep, x.module as provider_module {_PAIR.format('EA_EXTERNAL_DEP', 'M2')} and n.label = 'EA_Function' and x.label = 'EA_Function'", module="M2")
def ea_external_dependencies(g: Graph, module: str) -> DataFrame:
    rows = g.hop(g.scan("f", "EA_Function", module=module), "f", "EA_EXTERNAL_DEP", "x", "EA_Function")
    return rows.select(C("f.name").alias("function_name"), C("x.name").alias("external_dep"), C("x.module").alias("provider_module"))


@template("A", f"select n.label as element_type, n.name as element_name, x.name as requirement {_PAIR.format('EA_IMPLEMENTS', 'M3')} and x.label = 'EA_Requirement'", module="M3")
def ea_requirement_traceability(g: Graph, module: str) -> DataFrame:
    rows = g.hop(g.scan("n", module=module), "n", "EA_IMPLEMENTS", "r", "EA_Requirement")
    return rows.select(C("n.label").alias("element_type"), C("n.name").alias("element_name"), C("r.name").alias("requirement"))


OVERVIEW = {"functions": "EA_Function", "data_types": "EA_DataType", "config_parameters": "EA_ConfigParameter", "config_containers": "EA_ConfigContainer", "design_decisions": "EA_DesignDecision", "source_files": "EA_SourceFile", "memory_sections": "EA_MemorySection", "diagrams": "EA_Diagram"}


@template(
    "A",
    "select m.name as module, " + ", ".join(f"count(distinct case when x.label = '{v}' then x.id end) as {k}" for k, v in OVERVIEW.items())
    + " from n m left join e on e.dst = m.id and e.rel = 'EA_BELONGS_TO_MODULE' left join n x on x.id = e.src where m.label = 'MCALModule' and m.name = 'M1' group by 1",
    module="M1",
)
def ea_module_overview(g: Graph, module: str) -> DataFrame:
    """Eight counts from one pass over the module's members, instead of eight optional matches that multiply."""
    rows = g.hop(g.scan("m", "MCALModule", name=module), "m", "EA_BELONGS_TO_MODULE", "x", *OVERVIEW.values(), back=True, optional=True)
    return rows.groupBy(C("m.name").alias("module")).agg(*(F.count_distinct(F.when(C("x.label") == v, C("x.id"))).alias(k) for k, v in OVERVIEW.items()))


@template("A", f"select n.name as diagram, n.kind as type, n.seq as elements {_IN.format('M2', 'EA_Diagram')}", module="M2")
def ea_diagrams_for_module(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "d", module, "EA_Diagram").select(C("d.name").alias("diagram"), C("d.kind").alias("type"), C("d.seq").alias("elements"))


def _flows(g: Graph, diagram: str, part: str, rel: str, value: F.Column) -> DataFrame:
    rows = g.hop(g.scan("p", part), "p", "PART_OF", "d", "EA_Diagram", name=diagram)
    return g.gather(rows, "p", rel, value, "_flows", part)


_DIAGRAM = "from n join e p on p.src = n.id and p.rel = 'PART_OF' join n d on d.id = p.dst where d.name = '{}' and n.label = '{}'"


@template("A", f"select n.name as node_name, n.kind as node_type, n.seq, {_set('n', 'EA_CONTROL_FLOW', 'x.name || chr(58) || e.mark', more='x.label = ' + repr('EA_ActivityNode'))} as flows {_DIAGRAM.format('diagram_3', 'EA_ActivityNode')}", diagram="diagram_3")
def ea_activity_diagram_flow(g: Graph, diagram: str) -> DataFrame:
    rows = _flows(g, diagram, "EA_ActivityNode", "EA_CONTROL_FLOW", F.concat_ws(":", "x.name", "r.mark"))
    return rows.select(C("p.name").alias("node_name"), C("p.kind").alias("node_type"), "p.seq", listed("_flows").alias("flows"))


@template("A", f"select n.name as participant, n.kind as type, {_set('n', 'EA_SEQ_MESSAGE', 'x.name || chr(58) || e.mark || chr(58) || cast(e.seq as string)', more='x.label = ' + repr('EA_SeqParticipant'))} as messages {_DIAGRAM.format('diagram_4', 'EA_SeqParticipant')}", diagram="diagram_4")
def ea_sequence_diagram(g: Graph, diagram: str) -> DataFrame:
    rows = _flows(g, diagram, "EA_SeqParticipant", "EA_SEQ_MESSAGE", F.concat_ws(":", "x.name", "r.mark", C("r.seq").cast("string")))
    return rows.select(C("p.name").alias("participant"), C("p.kind").alias("type"), listed("_flows").alias("messages"))


@template("A", f"select n.name as state, n.kind as type, {_set('n', 'EA_STATE_TRANSITION', 'x.name || chr(58) || e.mark', more='x.label = ' + repr('EA_State'))} as transitions {_DIAGRAM.format('diagram_5', 'EA_State')}", diagram="diagram_5")
def ea_statechart_diagram(g: Graph, diagram: str) -> DataFrame:
    rows = _flows(g, diagram, "EA_State", "EA_STATE_TRANSITION", F.concat_ws(":", "x.name", "r.mark"))
    return rows.select(C("p.name").alias("state"), C("p.kind").alias("type"), listed("_flows").alias("transitions"))


@template("A", "select n.label, n.name, n.kind as stereotype from n join e on e.src = n.id and rel = 'APPEARS_IN' join n d on d.id = e.dst where d.name = 'diagram_6'", diagram="diagram_6")
def ea_diagram_elements(g: Graph, diagram: str) -> DataFrame:
    return g.hop(g.scan("x"), "x", "APPEARS_IN", "d", "EA_Diagram", name=diagram).select("x.label", "x.name", C("x.kind").alias("stereotype"))


# Strict profile: tests.


@template("A", "select n.label as test_type, n.key as test_id, n.kind as method, n.status from n join e on e.src = n.id and rel = 'TS_BELONGS_TO_MODULE' where e.dst = 'M1'", module="M1")
def ts_all_tests_for_module(g: Graph, module: str) -> DataFrame:
    return _of_module(g, "t", module, rel="TS_BELONGS_TO_MODULE").select(C("t.label").alias("test_type"), C("t.key").alias("test_id"), C("t.kind").alias("method"), "t.status")


@template("A", f"select n.key as test_id, {_set('n', 'TS_VERIFIES', 'x.key')} as verified_prqs, {_set('n', 'TS_VALIDATES_EA')} as validated_ea_elements from n where label = 'TS_FunctionalTestCase' and key = 'TC-16'", test_id="TC-16")
def ts_functional_test_detail(g: Graph, test_id: str) -> DataFrame:
    rows = g.gather(g.scan("t", "TS_FunctionalTestCase", key=test_id), "t", "TS_VERIFIES", "key", "verified_prqs", "ProductRequirement")
    rows = g.gather(rows, "t", "TS_VALIDATES_EA", "name", "validated_ea_elements")
    return rows.select(C("t.key").alias("test_id"), listed("verified_prqs").alias("verified_prqs"), listed("validated_ea_elements").alias("validated_ea_elements"))


@template("A", "select n.label as test_type, n.key as test_id, n.kind as method from n join e on e.src = n.id and rel = 'TS_VERIFIES' join n p on p.id = e.dst where p.key = 'PRQ-8'", prq_id="PRQ-8")
def ts_tests_for_prq(g: Graph, prq_id: str) -> DataFrame:
    rows = g.hop(g.scan("p", "ProductRequirement", key=prq_id), "p", "TS_VERIFIES", "t", back=True)
    return rows.select(C("t.label").alias("test_type"), C("t.key").alias("test_id"), C("t.kind").alias("method"))


@template("A", "select n.key as prq_id, n.name, n.status from n join e on e.src = n.id and rel = 'BELONGS_TO_MODULE' where e.dst = 'M3' and n.label = 'ProductRequirement' and n.id not in (select dst from e where rel = 'TS_VERIFIES')", module="M3")
def ts_untested_prqs(g: Graph, module: str) -> DataFrame:
    return g.without(_of_module(g, "p", module, "ProductRequirement", rel="BELONGS_TO_MODULE"), "p", "TS_VERIFIES", back=True).select(C("p.key").alias("prq_id"), "p.name", "p.status")


@template("A", f"select n.kind as element_type, {_set('n', 'TS_VERIFIES', 'x.key')} as verified_prqs, {_set('n', 'TS_TESTS_CONFIG_ELEMENT')} as tested_config from n where label = 'TS_ConfigTestCase' and key = 'TC-17'", test_id="TC-17")
def ts_config_test_traceability(g: Graph, test_id: str) -> DataFrame:
    rows = g.gather(g.scan("t", "TS_ConfigTestCase", key=test_id), "t", "TS_VERIFIES", "key", "verified_prqs", "ProductRequirement")
    rows = g.gather(rows, "t", "TS_TESTS_CONFIG_ELEMENT", "name", "tested_config")
    return rows.select(C("t.kind").alias("element_type"), listed("verified_prqs").alias("verified_prqs"), listed("tested_config").alias("tested_config"))


@template("A", "select n.key as test_id, n.kind as config, n.seq as data_point, n.status as scenario from n join e on e.src = n.id and rel = 'TS_MEASURES_TIMING_OF' join n f on f.id = e.dst and f.label = 'EA_Function' where f.name = 'item_108'", func_name="item_108")
def ts_wcet_for_function(g: Graph, func_name: str) -> DataFrame:
    rows = g.hop(g.scan("w", "TS_WCETTestCase"), "w", "TS_MEASURES_TIMING_OF", "f", "EA_Function", name=func_name)
    return rows.select(C("w.key").alias("test_id"), C("w.kind").alias("config"), C("w.seq").alias("data_point"), C("w.status").alias("scenario"))


@template(
    "A",
    f"select n.key as shrq_id, p.key as prq_id, p.name as prq_name, {_set('p', 'TS_VERIFIES', 'x.key || chr(58) || x.label', back=True)} as test_cases from n join e d on d.dst = n.id and d.rel = 'DERIVES_FROM' join n p on p.id = d.src where n.key = 'SHRQ-7' and n.label = 'StakeholderRequirement'",
    shrq_id="SHRQ-7",
)
def ts_full_v_model_traceability(g: Graph, shrq_id: str) -> DataFrame:
    rows = g.hop(g.scan("s", "StakeholderRequirement", key=shrq_id), "s", "DERIVES_FROM", "p", "ProductRequirement", back=True)
    rows = g.gather(rows, "p", "TS_VERIFIES", F.concat_ws(":", "x.key", "x.label"), "test_cases", back=True)
    return rows.select(C("s.key").alias("shrq_id"), C("p.key").alias("prq_id"), C("p.name").alias("prq_name"), listed("test_cases").alias("test_cases"))


_KINDS = {"functional": "TS_FunctionalTestCase", "config": "TS_ConfigTestCase", "static": "TS_StaticTestCase", "wcet": "TS_WCETTestCase"}


@template(
    "A",
    "select n.name as document, " + ", ".join(f"count(case when t.label = '{v}' then 1 end) as {k}" for k, v in _KINDS.items())
    + ", count(t.id) as total_linked from n left join e on e.src = n.id and rel = 'TS_CONTAINS_TESTCASE' left join n t on t.id = e.dst where n.label = 'TS_TestSpecDocument' and n.module = 'M2' group by 1",
    module="M2",
)
def ts_testspec_overview(g: Graph, module: str) -> DataFrame:
    rows = g.hop(g.scan("d", "TS_TestSpecDocument", module=module), "d", "TS_CONTAINS_TESTCASE", "t", optional=True)
    return rows.groupBy(C("d.name").alias("document")).agg(*(F.count_if(C("t.label") == v).alias(k) for k, v in _KINDS.items()), F.count("t.id").alias("total_linked"))


@template(
    "A",
    "select count(*) as total_prqs, count(case when k > 0 then 1 end) as covered, count(case when k = 0 then 1 end) as uncovered from (select n.id, (select count(*) from e where e.dst = n.id and rel = 'TS_VERIFIES') as k from n join e on e.src = n.id and rel = 'BELONGS_TO_MODULE' where e.dst = 'M4' and n.label = 'ProductRequirement')",
    module="M4",
)
def ts_coverage_summary(g: Graph, module: str) -> DataFrame:
    rows = g.tally(_of_module(g, "p", module, "ProductRequirement", rel="BELONGS_TO_MODULE"), "p", "TS_VERIFIES", "_k", back=True)
    return rows.agg(F.count("*").alias("total_prqs"), F.count_if(C("_k") > 0).alias("covered"), F.count_if(C("_k") == 0).alias("uncovered"))


# Relaxed profile.


@template("B", "select n.name, n.kind from n join e on e.src = n.id and rel = 'IMPLEMENTS' join n r on r.id = e.dst where n.label = 'Function' and r.key = 'REQ-8'", req_id="REQ-8")
def functions_for_requirement(g: Graph, req_id: str) -> DataFrame:
    return g.hop(g.scan("f", "Function"), "f", "IMPLEMENTS", "r", "Requirement", key=req_id).select("f.name", "f.kind")


@template("B", "select key from n where label = 'Requirement' and id not in (select e.dst from e join n t on t.id = e.src where rel = 'TRACES_TO' and t.label = 'TestSpecification')")
def uncovered_requirements(g: Graph) -> DataFrame:
    return g.without(g.scan("r", "Requirement"), "r", "TRACES_TO", "TestSpecification", back=True).select("r.key")


@template(
    "B",
    "select t.name as result, s.name as test, r.key as requirement, f.name as function from n r join e a on a.dst = r.id and a.rel = 'TRACES_TO' join n s on s.id = a.src and s.label = 'TestSpecification' join e b on b.dst = s.id and b.rel = 'VERIFIES' join n t on t.id = b.src and t.label = 'TestResult' join e c on c.dst = r.id and c.rel = 'IMPLEMENTS' join n f on f.id = c.src and f.label = 'Function' where r.key = 'REQ-7'",
    req_id="REQ-7",
)
def traceability_chain(g: Graph, req_id: str) -> DataFrame:
    rows = g.hop(g.scan("r", "Requirement", key=req_id), "r", "TRACES_TO", "s", "TestSpecification", back=True)
    rows = g.hop(g.hop(rows, "s", "VERIFIES", "t", "TestResult", back=True), "r", "IMPLEMENTS", "f", "Function", back=True)
    return rows.select(C("t.name").alias("result"), C("s.name").alias("test"), C("r.key").alias("requirement"), C("f.name").alias("function"))


@template(
    "B",
    ", d as (select src, dst from e where rel = 'DEPENDS_ON'), w as (select d.dst as id, 1 as k from d join n on n.id = d.src and n.label = 'Function' and n.name = 'item_17'), x as (select id from w union select d.dst from w join d on d.src = w.id union select c.dst from w join d on d.src = w.id join d c on c.src = d.dst) select distinct n.name from x join n using (id) where n.label = 'Function'",
    func_name="item_17",
    most=3,
)
def function_dependencies(g: Graph, func_name: str, most: int = 3) -> DataFrame:
    """Functions that are reached over one to ``most`` dependencies; one join for each hop, distinct after each."""
    links = g.edges.filter(C("rel") == "DEPENDS_ON").select("src", "dst")
    front, found = g.scan("f", "Function", name=func_name).select(C("f.id").alias("src")), None
    for _ in range(most):
        front = front.join(links, "src").select(C("dst").alias("src")).distinct()
        found = front if found is None else found.union(front)
    return found.distinct().join(g.scan("d", "Function"), C("src") == C("d.id")).select("d.name").distinct()


@template("B", "select s.note as steps, s.kind as participants from n join e on e.src = n.id and rel = 'FOLLOWS_SEQUENCE' join n s on s.id = e.dst and s.label = 'SequenceDiagram' where n.label = 'TestSpecification'")
def test_sequence(g: Graph, test_id: str | None = None) -> DataFrame:
    """The sequence that a test follows; without ``test_id``, of all tests."""
    tests = g.scan("t", "TestSpecification", **({} if test_id is None else {"key": test_id}))
    return g.hop(tests, "t", "FOLLOWS_SEQUENCE", "s", "SequenceDiagram").select(C("s.note").alias("steps"), C("s.kind").alias("participants"))


test_sequence.__test__ = False  # a template, not a test


@template(
    "B",
    "select f.name as field, f.kind as bits, a.name as access, f.note as description from n join e h on h.src = n.id and h.rel = 'HAS_FIELD' join n f on f.id = h.dst join e t on t.src = f.id and t.rel = 'HAS_ACCESS_TYPE' join n a on a.id = t.dst where n.label = 'HardwareRegister' and n.name = 'Supplier#000000004'",
    reg_name="Supplier#000000004",
)
def register_fields(g: Graph, reg_name: str) -> DataFrame:
    rows = g.hop(g.hop(g.scan("h", "HardwareRegister", name=reg_name), "h", "HAS_FIELD", "f", "RegisterField"), "f", "HAS_ACCESS_TYPE", "a", "AccessMode")
    return rows.select(C("f.name").alias("field"), C("f.kind").alias("bits"), C("a.name").alias("access"), C("f.note").alias("description"))


@template(
    "B",
    "select p.name as param, t.label as type_kind, t.name as type_name from n join e a on a.src = n.id and a.rel = 'HAS_PARAMETER' join n p on p.id = a.dst and p.label = 'Parameter' join e b on b.src = p.id and b.rel = 'OF_TYPE' join n t on t.id = b.dst where n.label = 'Function' and n.name = 'item_38'",
    func_name="item_38",
)
def function_type_graph(g: Graph, func_name: str) -> DataFrame:
    rows = g.hop(g.hop(g.scan("f", "Function", name=func_name), "f", "HAS_PARAMETER", "p", "Parameter"), "p", "OF_TYPE", "t")
    return rows.select(C("p.name").alias("param"), C("t.label").alias("type_kind"), C("t.name").alias("type_name"))


@template("B", "select n.name as error, m.name as mechanism, n.note as description from n join e on e.src = n.id and rel = 'DETECTED_BY' join n m on m.id = e.dst where n.label = 'Error'")
def error_detection(g: Graph) -> DataFrame:
    return g.hop(g.scan("e", "Error"), "e", "DETECTED_BY", "m", "Mechanism").select(C("e.name").alias("error"), C("m.name").alias("mechanism"), C("e.note").alias("description"))


_LIMIT = "x.kind || chr(58) || x.status || chr(58) || cast(x.seq as string)"


@template(
    "B",
    f"select n.name as register, {_set('n', 'HAS_CONSTRAINT', _LIMIT)} as reg_constraints, coalesce((select string_agg(distinct f.name || chr(58) || {_LIMIT}, ', ' order by f.name || chr(58) || {_LIMIT}) from e h join n f on f.id = h.dst join e c on c.src = f.id and c.rel = 'HAS_CONSTRAINT' join n x on x.id = c.dst where h.src = n.id and h.rel = 'HAS_FIELD'), '') as field_constraints from n where label = 'HardwareRegister' and module = 'M2' and name = 'Supplier#000000002'",
    module="M2",
    reg_name="Supplier#000000002",
)
def hw_constraints_for_register(g: Graph, module: str, reg_name: str) -> DataFrame:
    limit = lambda *more: F.concat_ws(":", *more, "x.kind", "x.status", C("x.seq").cast("string"))
    own = g.scan("h", "HardwareRegister", module=module, name=reg_name)
    rows = g.gather(own, "h", "HAS_CONSTRAINT", limit(), "_own", "HwConstraint")
    fields = g.hop(g.hop(own, "h", "HAS_FIELD", "f", "RegisterField"), "f", "HAS_CONSTRAINT", "x", "HwConstraint")
    fields = fields.groupBy(C("h.id").alias("_id")).agg(F.array_sort(F.collect_set(limit("f.name"))).alias("_fields"))
    rows = rows.join(fields, C("h.id") == C("_id"), "left")
    return rows.select(C("h.name").alias("register"), listed("_own").alias("reg_constraints"), F.coalesce(listed("_fields"), F.lit("")).alias("field_constraints"))


@template(
    "B",
    f"select n.name as sequence, s.seq as step_order, s.name as step_name, s.kind as step_type, o.name as operation, r.label as target_label, r.name as target_name, u.mark as access, {_set('s', 'HAS_CONSTRAINT', 'x.kind || chr(58) || x.status')} as constraints from n join e h on h.src = n.id and h.rel = 'HAS_STEP' join n s on s.id = h.dst left join e p on p.src = s.id and p.rel = 'STEP_OPERATION' left join n o on o.id = p.dst left join e u on u.src = s.id and u.rel = 'STEP_USES_REGISTER' left join n r on r.id = u.dst where n.label = 'ProgrammingSequence' and n.name = 'item_23'",
    sequence_name="item_23",
)
def programming_sequence_for(g: Graph, sequence_name: str, module: str | None = None) -> DataFrame:
    chosen = {"name": sequence_name} | ({} if module is None else {"module": module})
    rows = g.hop(g.scan("p", "ProgrammingSequence", **chosen), "p", "HAS_STEP", "s", "SequenceStep")
    rows = g.hop(rows, "s", "STEP_OPERATION", "o", "Operation", optional=True)
    rows = g.hop(rows, "s", "STEP_USES_REGISTER", "r", edge="u", optional=True)
    rows = g.gather(rows, "s", "HAS_CONSTRAINT", F.concat_ws(":", "x.kind", "x.status"), "constraints", "HwConstraint")
    return rows.select(
        C("p.name").alias("sequence"), C("s.seq").alias("step_order"), C("s.name").alias("step_name"), C("s.kind").alias("step_type"), C("o.name").alias("operation"),
        C("r.label").alias("target_label"), C("r.name").alias("target_name"), C("u.mark").alias("access"), listed("constraints").alias("constraints"),
    )


@template(
    "B",
    "select n.name as function, r.name as register, a.mark as access, coalesce((select string_agg(distinct f.name || chr(58) || o.name, ', ' order by f.name || chr(58) || o.name) from e h join n f on f.id = h.dst join e b on b.src = f.id and b.rel = 'BITFIELD_CONTROLS' join n o on o.id = b.dst where h.src = r.id and h.rel = 'HAS_FIELD'), '') as controls from n left join e a on a.src = n.id and a.rel = 'ACCESSES_REGISTER' left join n r on r.id = a.dst where n.label = 'Function' and n.name = 'item_59'",
    func_name="item_59",
)
def function_register_access_chain(g: Graph, func_name: str) -> DataFrame:
    rows = g.hop(g.scan("f", "Function", name=func_name), "f", "ACCESSES_REGISTER", "h", "HardwareRegister", edge="a", optional=True)
    fields = g.hop(g.hop(g.scan("k", "HardwareRegister"), "k", "HAS_FIELD", "b", "RegisterField"), "b", "BITFIELD_CONTROLS", "o", "Operation")
    fields = fields.groupBy(C("k.id").alias("_id")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "b.name", "o.name"))).alias("_controls"))
    rows = rows.join(fields, C("h.id") == C("_id"), "left")
    return rows.select(C("f.name").alias("function"), C("h.name").alias("register"), C("a.mark").alias("access"), F.coalesce(listed("_controls"), F.lit("")).alias("controls"))


@template(
    "B",
    f"""select n.key as requirement, {_set('n', 'IMPLEMENTS', back=True)} as functions, {_set('n', 'TRACES_TO', 'x.key', back=True, more="x.label = 'TestSpecification'")} as test_specs,
    coalesce((select string_agg(distinct r.key || ':' || r.status, ', ' order by r.key || ':' || r.status) from e t join n x on x.id = t.src and x.label = 'TestSpecification' join e v on v.dst = x.id and v.rel = 'VERIFIES' join n r on r.id = v.src and r.label = 'TestResult' where t.dst = n.id and t.rel = 'TRACES_TO'), '') as results,
    coalesce((select string_agg(distinct p.name, ', ' order by p.name) from e i join e z on z.src = i.src and z.rel = 'REALIZES_SEQUENCE' join n p on p.id = z.dst and p.label = 'ProgrammingSequence' where i.dst = n.id and i.rel = 'IMPLEMENTS'), '') as sequences from n where label = 'Requirement' and key = 'REQ-9'""",
    req_id="REQ-9",
)
def requirement_to_test_to_code(g: Graph, req_id: str) -> DataFrame:
    """Four lists, each gathered on its own, so optional matches never multiply."""
    own = g.scan("r", "Requirement", key=req_id)
    rows = g.gather(g.gather(own, "r", "IMPLEMENTS", "name", "functions", "Function", back=True), "r", "TRACES_TO", "key", "test_specs", "TestSpecification", back=True)
    runs = g.hop(g.hop(own, "r", "TRACES_TO", "s", "TestSpecification", back=True), "s", "VERIFIES", "t", "TestResult", back=True)
    runs = runs.groupBy(C("r.id").alias("_run")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "t.key", "t.status"))).alias("_results"))
    steps = g.hop(g.hop(own, "r", "IMPLEMENTS", "f", "Function", back=True), "f", "REALIZES_SEQUENCE", "p", "ProgrammingSequence")
    steps = steps.groupBy(C("r.id").alias("_step")).agg(F.array_sort(F.collect_set("p.name")).alias("_sequences"))
    rows = rows.join(runs, C("r.id") == C("_run"), "left").join(steps, C("r.id") == C("_step"), "left")
    empty = F.lit("")
    return rows.select(C("r.key").alias("requirement"), listed("functions").alias("functions"), listed("test_specs").alias("test_specs"), F.coalesce(listed("_results"), empty).alias("results"), F.coalesce(listed("_sequences"), empty).alias("sequences"))


@template("B", f"select n.name as submodule, n.kind as base, {_set('n', 'PART_OF_SUBMODULE', 'x.name || chr(58) || e.mark || chr(58) || x.kind', back=True)} as registers from n where label = 'HardwareSubModule' and module = 'M3'", module="M3")
def submodule_register_map(g: Graph, module: str) -> DataFrame:
    rows = g.gather(g.scan("m", "HardwareSubModule", module=module), "m", "PART_OF_SUBMODULE", F.concat_ws(":", "x.name", "r.mark", "x.kind"), "registers", "HardwareRegister", back=True)
    return rows.select(C("m.name").alias("submodule"), C("m.kind").alias("base"), listed("registers").alias("registers"))
