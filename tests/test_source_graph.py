"""From C files to the graph: what one file says, and what only all of them do."""

from pyspark.sql import functions as F

from tesserine.operators.source_graph import source_graph
from tesserine.sources.c_source import c_findings, findings

HEADER = """typedef struct { uint8 mode; Adc_Regs *regs; } Adc_State;
typedef struct { uint8 level; } Adc_Regs;
#define ADC_MAX (4u)
"""
MAIN = """#include "Adc.h"
#include <Std.h>
static Adc_State Adc_kState[ADC_MAX];
uint32 Adc_Count = 0u;
extern uint8 Other;
void Proto(uint8 x);
/* [cover parentID={AAAA-01}] */
static void Adc_lSet(uint8 Id, const Adc_State *S)
{
    Adc_State *p = &Adc_kState[Id];
    if (Id == 0u) { p->mode = 1u; Adc_kState[0].mode = 2u; }
    else if (1u == Id) Adc_kState[Id].regs->level |= 2u;
    else { Adc_Count++; }
    AdcSFR->CLC.U = Adc_Count;
}
/* [cover parentID={BBBB-02}] */
FUNC(void, ADC_CODE) Adc_Init(void) { uint8 Adc_Count = 0; (void)Adc_lSet(1u, NULL_PTR); Adc_Count = 1; Spi_Send(Adc_kState[0].mode); }
void Adc_Main(uint8 Job) { switch (Job) { case ADC_A: Adc_lSet(Job, NULL_PTR); break; default: Spi_Send(2); } }
"""
OTHER = """#include "src/Adc.h"
static void Adc_lSet(void) { }
uint8 Spi_Send(uint8 Data) { Spi_Buffer = Data; y = DRV_SFRREAD(1, SpiSFR->CH[i].CFG.U); Adc_lSet(); return Spi_Buffer; }
uint8 Spi_Buffer;
"""


def test_findings_of_a_file():
    rows = findings(MAIN)
    of = lambda kind, *fields: [tuple(r[f] for f in fields) for r in rows if r["kind"] == kind]
    assert of("function", "name", "detail", "flag", "line", "end") == [("Adc_lSet", "Id;S", True, 8, 15), ("Adc_Init", "", False, 17, 17), ("Adc_Main", "Job", False, 18, 18)]
    assert of("include", "name", "line") == [("Adc.h", 1), ("Std.h", 2)] and of("global", "name", "value", "flag") == [("Adc_kState", "Adc_State", True), ("Adc_Count", "uint32", False)]
    assert of("branch", "name", "value", "detail", "branch", "position", "flag") == [("B1", "0u", "==", "C1", 0, False), ("B2", "1u", "==", "C1", 0, False), ("B3", None, None, "C1", None, True)]
    assert ("p->mode", "WRITE", "B1") in of("use", "name", "value", "branch") and ("Adc_kState[Id].regs->level", "READ_WRITE", "B2") in of("use", "name", "value", "branch")
    assert ("Adc_Count", "READ", "B0") in of("use", "name", "value", "branch") and ("Adc_Count", "READ_WRITE", "B3") in of("use", "name", "value", "branch")
    assert of("call", "owner", "name", "value") == [("Adc_Init", "Adc_lSet", None), ("Adc_Init", "Spi_Send", None), ("Adc_Main", "Adc_lSet", "ADC_A"), ("Adc_Main", "Spi_Send", "default")]
    assert of("constant", "owner", "name", "position", "value") == [("Adc_Init", "Adc_lSet", 0, "1u"), ("Adc_Init", "Adc_lSet", 1, "NULL_PTR"), ("Adc_Main", "Adc_lSet", 1, "NULL_PTR"), ("Adc_Main", "Spi_Send", 0, "2")]
    assert of("register", "owner", "name", "value", "line") == [("Adc_lSet", "CLC", "WRITE", 14)] and of("cover", "name", "owner") == [("AAAA-01", "Adc_lSet"), ("BBBB-02", "Adc_Init")]
    assert [(r["owner"], r["name"], r["value"]) for r in findings(HEADER) if r["kind"] == "member"] == [("Adc_State", "mode", "uint8"), ("Adc_State", "regs", "Adc_Regs"), ("Adc_Regs", "level", "uint8")]
    for broken in ("", "{", "}", "void f( {", "if (", 'void f(void) { if (x', "/* open", "case:", "typedef struct {", "a = {1, 2};", "void f(void) { else } "):
        findings(broken)


def test_graph_of_a_source_tree(spark):
    files = spark.createDataFrame([("src/Adc.h", HEADER), ("src/Adc.c", MAIN), ("src/Spi.c", OTHER), ("src/none.c", None)], "file string, text string")
    given = {
        "registers": spark.createDataFrame([("ADC_CLC", "adc"), ("SPI_CH0_CFG", "spi")], "name string, module string"), "designs": spark.createDataFrame([("Adc_Init",), ("Adc_DeInit",)], "name string"),
        "requirements": spark.createDataFrame([("AAAA-01",), ("CCCC-03",)], "guid string"),
    }
    g = source_graph(c_findings(files), "adc", **given)
    assert {(r.label, r.key) for r in g.nodes.filter("label in ('Function', 'SourceFile', 'Register')").collect()} == {
        ("SourceFile", "src/Adc.h"), ("SourceFile", "src/Adc.c"), ("SourceFile", "src/Spi.c"), ("Function", "src/Adc.c:Adc_lSet"), ("Function", "Adc_Init"), ("Function", "Adc_Main"), ("Function", "src/Spi.c:Adc_lSet"), ("Function", "Spi_Send"),
        ("Register", "ADC_CLC"), ("Register", "CH_CFG"), ("Register", "SPI_CH0_CFG"),
    }
    edges = g.edges.select("rel", F.regexp_replace("src", "^[A-Za-z]+:", "").alias("a"), F.regexp_replace("dst", "^[A-Za-z]+:", "").alias("b"), "props").collect()
    of = lambda rel, *props: {(r.a, r.b, *(r.props.get(p) for p in props)) for r in edges if r.rel == rel}
    assert of("CALLS", "cases") == {("Adc_Init", "src/Adc.c:Adc_lSet", ""), ("Adc_Init", "Spi_Send", ""), ("Adc_Main", "src/Adc.c:Adc_lSet", "ADC_A"), ("Adc_Main", "Spi_Send", "default"), ("Spi_Send", "src/Spi.c:Adc_lSet", "")}
    assert of("INCLUDES") == {("src/Adc.c", "src/Adc.h"), ("src/Spi.c", "src/Adc.h")} and of("IMPLEMENTS") == {("Adc_Init", "Adc_Init")} and of("COVERS") == {("src/Adc.c:Adc_lSet", "AAAA-01")}
    assert len(of("DEFINED_IN")) == 5 + 2 + 1 + 3 and of("HAS_GLOBAL") == {("src/Adc.c", "src/Adc.c:Adc_kState"), ("src/Adc.c", "src/Adc.c:Adc_Count"), ("src/Spi.c", "src/Spi.c:Spi_Buffer")}
    state, count, buffer = "src/Adc.c:Adc_kState", "src/Adc.c:Adc_Count", "src/Spi.c:Spi_Buffer"
    assert of("USES_GLOBAL", "member", "access_type", "contexts") == {
        ("src/Adc.c:Adc_lSet", state, "", "READ", "DIRECT"), ("src/Adc.c:Adc_lSet", state, "mode", "WRITE", "ALIAS,DIRECT"), ("src/Adc.c:Adc_lSet", state, "regs.level", "READ_WRITE", "DIRECT"), ("src/Adc.c:Adc_lSet", count, "", "READ_WRITE", "DIRECT"),
        ("Adc_Init", state, "mode", "READ", "DIRECT"), ("Adc_Init", state, "regs.level", "READ_WRITE", "CALLEE_PROPAGATED"), ("Spi_Send", buffer, "", "READ_WRITE", "DIRECT"),
    }
    assert of("ACCESSES_REGISTER", "access_type", "propagated") == {
        ("src/Adc.c:Adc_lSet", "ADC_CLC", "WRITE", "false"), ("Adc_Init", "ADC_CLC", "WRITE", "true"), ("Adc_Main", "ADC_CLC", "WRITE", "true"), ("Spi_Send", "CH_CFG", "READ", "false"), ("Adc_Init", "CH_CFG", "READ", "true"), ("Adc_Main", "CH_CFG", "READ", "true"),
    }
