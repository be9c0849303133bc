"""Parsers on small files of each kind."""

import zipfile

from pyspark.sql import functions as F

from tesserine.sources import parsers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_restructured_text(spark, tmp_path):
    path = put(tmp_path, "a.rst", "lead\n\nTitle\n=====\n\nbody one\n\nPart\n----\nbody two\n====\n")
    got = [(r.section_no, r.title, r.mark, r.body) for r in parsers.restructured_sections(spark, path).orderBy("section_no").collect()]
    assert got == [(0, None, None, "lead"), (1, "Title", "=", "body one"), (2, "Part", "-", "body two\n====")]


def test_diagrams(spark, tmp_path):
    path = put(tmp_path, "a.puml", '@startuml\nparticipant "My App" as App\nactor User\nUser -> App : start(1)\nApp --> User: ok\nUser <- App : again\nnote left: x\n@enduml\n')
    assert [(r.sender, r.receiver, r.message) for r in parsers.sequence_messages(spark, path).orderBy("line_no").collect()] == [("User", "App", "start(1)"), ("App", "User", "ok"), ("App", "User", "again")]
    assert {(r.kind, r.name, r.alias) for r in parsers.participants(spark, path).collect()} == {("participant", "My App", "App"), ("actor", "User", None)}


def test_register_headers(spark, tmp_path):
    path = put(tmp_path, "r.h", "typedef struct\n{\n  unsigned int EN:1;  /**< \\brief [0:0] Enable bit (rw) */\n  unsigned int reserved_1:3;\n  unsigned int MODE:4; /* [7:4] Mode (r) */\n} REG_A_Bits;\n#define REG_A /*lint*/ (*(volatile REG_A_Bits*)0xF0001000u)\n")
    assert [(r.register, r.field, r.low, r.high, r.access, r.description) for r in parsers.register_fields(spark, path).orderBy("low").collect()] == [("REG_A_Bits", "EN", 0, 0, "rw", "Enable bit"), ("REG_A_Bits", "MODE", 4, 7, "r", "Mode")]
    assert [(r.register, r.address) for r in parsers.register_addresses(spark, path).collect()] == [("REG_A", 0xF0001000)]


def test_documentation_comments(spark, tmp_path):
    path = put(tmp_path, "d.h", "/**\n * @brief Adds two.\n * @param[in] a first\n * @param b second\n * @return the sum\n */\nstatic int add(int a, int b);\n/** nothing */\nint x;\n")
    assert [(r.name, r.brief, r.parameters, r.returns) for r in parsers.documented_functions(spark, path).collect()] == [("add", "Adds two.", ["a", "b"], "the sum")]


def test_coverage_reports(spark, tmp_path):
    lcov = put(tmp_path, "c.info", "SF:a.c\nDA:1,5\nDA:2,0\nend_of_record\nSF:b.c\nDA:1,1\nend_of_record\n")
    assert {(r.source, r.n_lines, r.n_hit, r.share) for r in parsers.coverage_lcov(spark, lcov).collect()} == {("a.c", 2, 1, 0.5), ("b.c", 1, 1, 1.0)}
    gcov = put(tmp_path, "a.c.gcov", "        -:    0:Source:a.c\n        -:    1:/* x */\n        5:    2:f();\n    #####:    3:g();\n")
    assert [(r.source, r.n_lines, r.n_hit) for r in parsers.coverage_gcov(spark, gcov).collect()] == [("a.c", 2, 1)]
    xml = put(tmp_path, "c.xml", '<coverage><class filename="a.c"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></coverage>')
    assert [(r.source, r.n_lines, r.n_hit) for r in parsers.coverage_xml(spark, xml).collect()] == [("a.c", 2, 1)]
    json = put(tmp_path, "c.json", '{"files": [{"file": "a.c", "lines": [{"line_number": 1, "count": 3}, {"line_number": 2, "count": 0}]}]}')
    assert [(r.source, r.n_lines, r.n_hit) for r in parsers.coverage_json(spark, json).collect()] == [("a.c", 2, 1)]


def test_logs_and_tables(spark, tmp_path):
    log = put(tmp_path, "l.log", "cc -c a.c\na.c:3:7: warning: unused x [-Wunused]\nb.c:9: error: no such thing\n")
    assert {(r.file, r.line, r.column, r.severity, r.message, r.rule) for r in parsers.compiler_messages(spark, log).collect()} == {("a.c", 3, 7, "warning", "unused x", "-Wunused"), ("b.c", 9, None, "error", "no such thing", None)}
    md = put(tmp_path, "t.md", "text\n\n| Pin | Name |\n|---|:--|\n| 1 | P0.[0..1] |\n| 2 | VSS |\n\n| A |\n|--|\n| x |\n")
    assert [dict(r.cells) for r in parsers.markdown_tables(spark, md).orderBy("line_no").collect()] == [{"Pin": "1", "Name": "P0.[0..1]"}, {"Pin": "2", "Name": "VSS"}, {"A": "x"}]
    names = spark.createDataFrame([("P0.[0..2]",), ("VSS",), (None,)], "n string")
    assert [r[0] for r in names.select(parsers.expand_indexed(F.col("n"))).collect()] == [["P0.0", "P0.1", "P0.2"], ["VSS"], [None]]
    one, two = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a")], [(1, "b"), (2, "c"), (2, "c")]))
    assert {tuple(r) for r in parsers.merge_unique(one, two, "k").collect()} == {(1, "a"), (2, "c")}


def test_nested_xml_and_models(spark, tmp_path):
    xml = put(tmp_path, "c.arxml", "<ROOT><CONTAINER><SHORT-NAME>Adc</SHORT-NAME><PARAM><SHORT-NAME>Rate</SHORT-NAME><VALUE>5</VALUE></PARAM></CONTAINER></ROOT>")
    assert ("/ROOT/Adc/Rate/VALUE", "VALUE", "5") in {(r.element, r.kind, r.value) for r in parsers.xml_elements(spark, xml).collect()}
    xmi = put(tmp_path, "m.xmi", '<X xmlns:xmi="u"><packagedElement xmi:id="a" xmi:type="uml:Class" name="A"/><packagedElement xmi:id="b" xmi:type="uml:Class" name="B"/><connector xmi:idref="c"><source xmi:idref="a"/><target xmi:idref="b"/></connector></X>')
    model = parsers.uml_model(spark, xmi)
    assert {(r.id, r.kind, r.name, r.source, r.target) for r in model.collect()} == {("a", "uml:Class", "A", None, None), ("b", "uml:Class", "B", None, None), ("c", "connector", None, "a", "b")}
    assert {tuple(r) for r in parsers.model_statistics(model).collect()} == {("uml:Class", 2, 2), ("connector", 1, 0)}


def test_zipped_formats(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.reqifz", "w") as z:
        z.writestr("a.reqif", '<REQ-IF><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="d" LONG-NAME="Text"/><SPEC-OBJECT IDENTIFIER="o1"><ATTRIBUTE-VALUE-STRING THE-VALUE="must"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>d</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING></SPEC-OBJECT><SPEC-OBJECT-REF>o1</SPEC-OBJECT-REF></REQ-IF>')
    assert [(r.document, r.id, r.place, dict(r.fields)) for r in parsers.requirement_archives(spark, str(tmp_path / "r.reqifz")).collect()] == [("a.reqif", "o1", 0, {"Text": "must"})]
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Tests" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Test case ID</t></si><si><r><t>Sta</t></r><r><t>tus</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>done</t></is></c></row><row r="3"><c r="B3"><v>x</v></c></row></sheetData></worksheet>')
    assert [(r.row_no, r.cells) for r in parsers.sheet_rows(spark, str(tmp_path / "t.xlsx")).collect()][1] == (2, ["7", None, "done"])
    got = parsers.sheet_table(spark, str(tmp_path / "t.xlsx"), parsers.TEST_SPEC).collect()
    assert [(r.sheet, r.test_id, r.status, r.objective) for r in got] == [("Tests", "7", "done", None)]
