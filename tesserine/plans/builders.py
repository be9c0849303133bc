"""Specifications of the graph builders, one for each family of inputs, over the parsers' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import Edge, Node, Spec, build
from ..registry import register
from ..tables import table

_MODULE = Node("Module", "items", "module")
_MODULE_OF_TESTS = Node("Module", "tests", "module")
#: Kinds of test cases and their labels.
TEST_KINDS = {"functional": "TS_FunctionalTestCase", "config": "TS_ConfigTestCase", "static": "TS_StaticTestCase", "wcet": "TS_WCETTestCase"}

BUILDERS: dict[str, Spec] = {
    "requirements": Spec(
        (Node("StakeholderRequirement", "items", "key", ("name", "status", "asil"), ("type", "shrq")), Node("ProductRequirement", "items", "key", ("name", "status", "asil"), ("type", "prq")), Node("VerificationStep", "items", "key", ("name", "status"), ("type", "pvs")), Node("Folder", "folders", "key", ("name",)), _MODULE),
        (Edge("DERIVES_FROM", "relations", ("ProductRequirement", "source"), ("StakeholderRequirement", "target")), Edge("VERIFIED_BY", "relations", ("ProductRequirement", "source"), ("VerificationStep", "target")), Edge("BELONGS_TO_MODULE", "items", ("ProductRequirement", "key"), ("Module", "module"))),
    ),
    "hierarchy": Spec((Node("Folder", "folders", "key", ("name",)),), (Edge("CHILD_OF", "folders", ("Folder", "key"), ("Folder", "parent")),)),
    "modules": Spec((_MODULE, Node("Requirement", "items", "key", ("name",))), (Edge("BELONGS_TO_MODULE", "items", ("Requirement", "key"), ("Module", "module")),)),
    "relaxed_json": Spec((Node("Requirement", "items", "key", ("name", "status")), Node("Function", "functions", "name", ("file", "kind"))), (Edge("IMPLEMENTS", "functions", ("Function", "name"), ("Requirement", "requirements")),)),
    "relaxed_parsers": Spec(
        (Node("Function", "functions", "name", ("file", "kind")), Node("Struct", "types", "name", ("kind",)), Node("HardwareRegister", "registers", "name", ("address",)), Node("RegisterField", "fields", "name", ("low", "high"))),
        (Edge("DEPENDS_ON", "calls", ("Function", "caller"), ("Function", "callee"), ("place",)), Edge("HAS_FIELD", "fields", ("HardwareRegister", "register"), ("RegisterField", "name")), Edge("ACCESSES_REGISTER", "accesses", ("Function", "function"), ("HardwareRegister", "register"), ("access",)), Edge("USES_TYPE", "functions", ("Function", "name"), ("Struct", "types"))),
    ),
    "test_specification": Spec(
        (Node("TS_Document", "tests", "document"), _MODULE_OF_TESTS, *(Node(label, "tests", "test_id", ("objective", "status"), ("kind", kind)) for kind, label in TEST_KINDS.items()), Node("ProductRequirement", "items", "key"), Node("EA_Element", "elements", "element_id", ("name", "label"))),
        (
            *(Edge("TS_VERIFIES", "tests", (TEST_KINDS[k], "test_id"), ("ProductRequirement", "requirements")) for k in ("functional", "config", "static")),
            *(Edge("TS_VALIDATES_EA", "design_links", (label, "test_id"), ("EA_Element", "element_id"), ("by",)) for label in TEST_KINDS.values()),
            *(Edge("TRACES_TO", "design_links", ("EA_Element", "element_id"), (label, "test_id")) for label in TEST_KINDS.values()),
            Edge("TS_TESTS_CONFIG_ELEMENT", "config_links", (TEST_KINDS["config"], "test_id"), ("EA_Element", "element_id")),
            Edge("TS_MEASURES_TIMING_OF", "timing_links", (TEST_KINDS["wcet"], "test_id"), ("EA_Element", "element_id")),
            *(Edge("TS_BELONGS_TO_MODULE", "tests", (label, "test_id"), ("Module", "module")) for label in TEST_KINDS.values()),
            *(Edge("TS_CONTAINS_TESTCASE", "tests", ("TS_Document", "document"), (label, "test_id")) for label in TEST_KINDS.values()),
        ),
    ),
    "source_code": Spec(
        (Node("SRC_SourceFile", "files", "path", ("hash",)), Node("SRC_Function", "functions", "name", ("kind",)), Node("SRC_Macro", "macros", "name", ("value",)), Node("SRC_DataType", "types", "name", ("kind",)), Node("SRC_GlobalVariable", "globals", "name", ("kind",)), Node("SRC_Register", "registers", "name")),
        (Edge("DEFINED_IN", "functions", ("SRC_Function", "name"), ("SRC_SourceFile", "file")), Edge("CALLS", "calls", ("SRC_Function", "caller"), ("SRC_Function", "callee"), ("place",)), Edge("INCLUDES", "files", ("SRC_SourceFile", "path"), ("SRC_SourceFile", "includes")), Edge("USES_GLOBAL", "accesses", ("SRC_Function", "function"), ("SRC_GlobalVariable", "variable"), ("access",)), Edge("ACCESSES_REGISTER", "accesses", ("SRC_Function", "function"), ("SRC_Register", "register"), ("access",))),
    ),
    "register_headers": Spec((Node("SFR_File", "files", "path"), Node("SFR_Register", "registers", "name", ("address",)), Node("SFR_Bitfield", "fields", "name", ("low", "high"))), (Edge("DEFINED_IN", "registers", ("SFR_Register", "name"), ("SFR_File", "file")), Edge("HAS_BITFIELD", "fields", ("SFR_Register", "register"), ("SFR_Bitfield", "name")))),
    "uml": Spec((Node("EA_Element", "elements", "id", ("name", "kind")), Node("EA_Diagram", "diagrams", "id", ("name", "kind"))), (Edge("EA_CONNECTS", "connectors", ("EA_Element", "source"), ("EA_Element", "target"), ("kind",)), Edge("APPEARS_IN", "diagrams", ("EA_Diagram", "id"), ("EA_Element", "members")))),
    "variants": Spec((Node("ALM_Requirement", "items", "key", ("name", "status")), Node("ALM_TestCase", "tests", "test_id", ("status",))), (Edge("VERIFIES", "tests", ("ALM_TestCase", "test_id"), ("ALM_Requirement", "requirements")),)),
    "xml_configuration": Spec((Node("ConfigContainer", "parameters", "container"), Node("ConfigParameter", "parameters", "name", ("value",))), (Edge("HAS_PARAMETER", "parameters", ("ConfigContainer", "container"), ("ConfigParameter", "name")), Edge("REFERS_TO", "parameters", ("ConfigParameter", "name"), ("ConfigContainer", "reference")))),
    "interchange_manual": Spec((Node("ManualSection", "sections", "id", ("name",)), Node("ManualRegister", "registers", "name", ("address",))), (Edge("NEXT", "sections", ("ManualSection", "id"), ("ManualSection", "next")), Edge("DESCRIBES", "sections", ("ManualSection", "id"), ("ManualRegister", "registers")))),
    "boundary_values": Spec((Node("BV_Parameter", "boundaries", "parameter", ("least", "most")), Node("BV_Api", "boundaries", "api"), Node("BV_Test", "boundaries", "test_id")), (Edge("OF_API", "boundaries", ("BV_Parameter", "parameter"), ("BV_Api", "api")), Edge("TESTED_BY", "boundaries", ("BV_Parameter", "parameter"), ("BV_Test", "test_id")))),
    "test_data": Spec((Node("TD_Parameter", "data", "parameter"), Node("TD_Config", "data", "config"), Node("TD_Mode", "data", "mode")), (Edge("SET_IN", "data", ("TD_Parameter", "parameter"), ("TD_Config", "config"), ("value",)), Edge("IN_MODE", "data", ("TD_Config", "config"), ("TD_Mode", "mode")))),
    "config_map": Spec((Node("Config", "support", "config"), Node("Device", "support", "device")), (Edge("SUPPORTED_ON", "support", ("Config", "config"), ("Device", "device"), (), ("supported", "yes")),)),
    "datasheet_pins": Spec((Node("Device", "pins", "device"), Node("Port", "pins", "port"), Node("Pin", "pins", "pin", ("buffer",)), Node("PinFunction", "pins", "function")), (Edge("HAS_PORT", "pins", ("Device", "device"), ("Port", "port")), Edge("HAS_PIN", "pins", ("Port", "port"), ("Pin", "pin")), Edge("CAN_BE", "pins", ("Pin", "pin"), ("PinFunction", "function")))),
    "test_scripts": Spec((Node("ScriptFunction", "functions", "name", ("file",)), Node("TestCase", "tests", "test_id", ("status",))), (Edge("RUNS", "scripts", ("ScriptFunction", "function"), ("TestCase", "test_id")), Edge("CALLS", "calls", ("ScriptFunction", "caller"), ("ScriptFunction", "callee"), ("place",)))),
}


def specification_sources(rows: DataFrame, module: str, items: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    """The sources of the test specification's builder from rows of its sheets.

    ``rows``: ``path, sheet, test_id, objective, method, requirement, design, target,
    status`` (references as text, separated by commas, semicolons or blanks).  The kind is told by the sheet's or
    method's name, functional without any word.  A test validates design ``elements`` (``element_id, name,
    label``) by their id among its references, or by their name as a word of its objective; a configuration test's
    and a timing test's target is an element's name.
    """
    said = F.lower(F.concat_ws(" ", "sheet", "method"))
    kind = F.when(said.contains("wcet") | said.contains("timing"), "wcet").when(said.contains("config"), "config").when(said.contains("static") | said.contains("interface"), "static").otherwise("functional")
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;]+"), lambda x: x != "")
    tests = rows.filter(F.col("test_id").isNotNull()).select("test_id", "objective", "status", F.regexp_extract("path", r"([^/]*)$", 1).alias("document"), F.lit(module).alias("module"), kind.alias("kind"), listed("requirement").alias("requirements"), listed("design").alias("_design"), F.trim("target").alias("_target"))
    by_id = tests.select("test_id", F.explode("_design").alias("element_id")).join(elements.select("element_id"), "element_id", "left_semi").withColumn("by", F.lit("id"))
    words = tests.select("test_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("objective", F.lit("")), F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    by_name = words.join(elements.select("element_id", "name"), "name").select("element_id", "test_id", F.lit("name").alias("by"))
    aimed = tests.join(elements.select("element_id", F.col("name").alias("_target")), "_target").select("test_id", "kind", "element_id")
    return {
        "tests": tests.drop("_design", "_target"), "items": items, "elements": elements, "design_links": by_id.select("element_id", "test_id", "by").unionByName(by_name),
        "config_links": aimed.filter("kind = 'config'").drop("kind"), "timing_links": aimed.filter("kind = 'wcet'").drop("kind"),
    }


@register(
    "graph_build",
    """with p as (select distinct cast(o_custkey as varchar) as k from orders), n as (select 'Customer' as label, count(*) as n from (select distinct c_custkey from customer) union all select 'Order', count(*) from (select distinct o_orderkey from orders) union all select 'Module', count(distinct c_mktsegment) from customer),
    e as (select 'PLACED_BY' as label, count(*) as n from (select distinct o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer)) union all select 'BELONGS_TO_MODULE', count(*) from (select distinct c_custkey, c_mktsegment from customer where c_mktsegment is not null) union all select 'RELATED', count(*) from (select distinct o_custkey, o_orderkey % 100 from orders where o_custkey in (select c_custkey from customer) and o_orderkey % 100 in (select c_custkey from customer)))
    select * from n union all select * from e""",
)
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph built from a specification, counted by label and relationship."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.array((F.col("o_orderkey") % 100).cast("string")).alias("near"))
    sources = {"customers": table(spark, sf_dir, "customer"), "orders": orders}
    spec = Spec(
        (Node("Customer", "customers", "c_custkey", ("c_name",)), Node("Order", "orders", "o_orderkey", ("o_orderstatus",)), Node("Module", "customers", "c_mktsegment")),
        (Edge("PLACED_BY", "orders", ("Order", "o_orderkey"), ("Customer", "o_custkey")), Edge("BELONGS_TO_MODULE", "customers", ("Customer", "c_custkey"), ("Module", "c_mktsegment")), Edge("RELATED", "orders", ("Customer", "o_custkey"), ("Customer", "near"))),
    )
    g = build(spec, sources)
    return g.nodes.groupBy("label").agg(F.count("*").alias("n")).union(g.edges.groupBy("rel").agg(F.count("*").alias("n")))
