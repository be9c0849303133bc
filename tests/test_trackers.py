"""Tracker records, simulator reports and paged documents from fixtures."""

import json

from tesserine.sources import paged, trackers

SRS = """/*! @page srs
 * @uid{REQ-1, Enable the module}
 *  @uid_litem{Description}
 *  The module shall be enabled
 *  by one call.
 *  @uid_litem{Rationale}
 *  Not this.
 *  @uid_fw_trace
 *   - @tr{Ifx_enable}: Function for enabling.
 *   - \\tr{ Ifx_clock } clock
 * @enduid
 * outside @tr{No_thing}
 * \\uid{REQ-2,Second}
 * @enduid
 */
"""


def test_srs_blocks(spark, tmp_path):
    (tmp_path / "a.dox").write_text(SRS)
    assert sorted((r.id, r.name, r.description) for r in trackers.srs_requirements(spark, str(tmp_path / "a.dox")).collect()) == [("REQ-1", "Enable the module", "The module shall be enabled by one call."), ("REQ-2", "Second", "Second")]
    assert sorted((r.requirement_id, r.function, r.description) for r in trackers.srs_traces(spark, str(tmp_path / "a.dox")).collect()) == [("REQ-1", "Ifx_clock", "clock"), ("REQ-1", "Ifx_enable", "Function for enabling")]


def test_simulator_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<Report><TestCase name="a"><Result>passed</Result><Duration>1.5</Duration></TestCase><TestCase name="b" verdict="NOK" duration_ms="20"><Description>why</Description></TestCase>'
        '<TestCase name="c"><Result status="Abort"/><Time>x</Time><ErrorMessage> crash </ErrorMessage><Description>d</Description></TestCase><Test result="odd"/></Report>'
    )
    got = sorted((r.test_name, r.status, r.duration_ms, r.message) for r in trackers.simulator_results(spark, str(tmp_path / "r.xml")).collect())
    assert got == [("a", "PASS", 1500, None), ("b", "FAIL", 20, "why"), ("c", "ERROR", 0, "crash"), ("unknown", "UNKNOWN", 0, None)]


def test_test_cases_with_steps_and_links(spark, tmp_path):
    cases = [
        {"id": "T-1", "title": "one", "status": "open", "steps": [{"description": "<b>do</b> it", "expected": "done"}, {"index": 7, "description": "more"}], "links": [{"id": "R-1", "role": "verifies"}, {"id": "R-1", "role": "verifies"}, {"role": "none"}]},
        {"id": "T-2"}, {"title": "no id"},
    ]
    (tmp_path / "t.json").write_text(json.dumps(cases))
    got = trackers.test_cases(spark, str(tmp_path / "t.json"))
    assert sorted((r.id, r.title, r.n_steps) for r in got["cases"].collect()) == [("T-1", "one", 2), ("T-2", None, 0)]
    assert sorted((r.case_id, r["index"], r.description, r.expected) for r in got["steps"].collect()) == [("T-1", 1, "do it", "done"), ("T-1", 7, "more", None)]
    assert [tuple(r) for r in got["links"].collect()] == [("T-1", "verifies", "R-1")]


def test_results_of_releases(spark, tmp_path):
    run = lambda case, verdict, at: {"testCase": case, "verdict": verdict, "executed": at}
    root = {"project": {"name": "P", "releases": [{"name": "1.0", "devices": [{"name": "D", "configuration": "c", "results": [run("T-1", "pass", "2024-01-01T00:00:00Z"), run("T-1", "fail", "2024-02-01T00:00:00Z"), run("T-2", "pass", None)]}, {"name": "E"}]}]}}
    (tmp_path / "r.json").write_text(json.dumps(root))
    got = sorted((r.device, r.case_id, r.verdict) for r in trackers.release_results(spark, str(tmp_path / "r.json")).collect())
    assert got == [("D", "T-1", "FAIL"), ("D", "T-2", "PASS")]
    assert trackers.release_results(spark, str(tmp_path / "r.json"), only_latest=False).count() == 3


def test_relations_and_module_contents(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"id": 1, "fromItem": 1, "toItem": 2, "relationshipType": 4}, {"id": 2, "fromItem": 2, "toItem": 3, "relationshipType": 5}, {"id": 3, "fromItem": 1, "toItem": 2, "relationshipType": 4}, {"id": 4, "fromItem": 1}]))
    path = str(tmp_path / "x.json")
    assert sorted(tuple(r) for r in trackers.relationships(spark, path, types={4: "derives"}).collect()) == [(1, 2, "derives"), (2, 3, "5")]
    two = spark.createDataFrame([(2,)], "id long")
    assert sorted((r.source, r.target, r.direction) for r in trackers.relationships(spark, path, two).collect()) == [(1, 2, "upstream"), (2, 3, "downstream")]
    items = spark.createDataFrame([(10, 1, 32), (11, 1, 7), (12, 10, 7), (13, 10, 32), (14, 13, None), (1, 13, 32), (20, 2, 7), (30, None, 7), (12, 1, 7)], "id long, parent long, item_type int")
    modules = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    assert sorted(tuple(r) for r in trackers.module_items(items, modules).collect()) == [(1, 11, 1), (1, 12, 1), (1, 14, 3), (2, 20, 1)]
    assert sorted(tuple(r) for r in trackers.module_items(items, modules, recurse=False).collect()) == [(1, 11, 1), (1, 12, 1), (2, 20, 1)]


def test_paged_documents(spark):
    page = lambda n, body: f"User Manual V1.{n}\nConfidential\n{body}\nPage {n} of 4\n"
    bodies = [
        "1 Overview\nThe module has 4 channels.\n2 More text that is no heading...........5\n1.1 Registers\n| Name | Offset |\n|---|---|\n| CLC | 0 |\n(table continues...)",
        "| Name | Offset |\n| ID | 8 |\n31 30 29 28 27 26\nrw r rw\nend of table\n1 Overview again\n1.2 Modes\nmode text",
        "still modes\n2 Usage\nuse it", "| a | b | c |\n2024-01-01\nlast",
    ]
    rows = [("d", k + 1, page(k + 1, b)) for k, b in enumerate(bodies)] + [("d", 5, None), ("e", 1, "User Manual V1.1\n1 Alone\ntext"), ("f", 1, "")]
    lines = paged.page_lines(spark.createDataFrame(rows, "doc string, page int, text string"))
    kept = [r.line for r in lines.filter("doc = 'd'").orderBy("page", "line_no").collect()]
    assert not any(x.startswith(("User", "Conf", "Page", "31", "rw", "(table")) or "....." in x or x.startswith("2024") for x in kept) and "last" in kept and "use it" in kept
    assert "User Manual V1.1" in [r.line for r in lines.filter("doc = 'e'").collect()]
    found = [(r.table_no, r.row_no, r.page, r.cells) for r in paged.tables(lines).orderBy("table_no", "row_no").collect()]
    assert found == [(1, 0, 1, ["Name", "Offset"]), (1, 1, 1, ["CLC", "0"]), (1, 2, 2, ["ID", "8"]), (2, 0, 4, ["a", "b", "c"])]
    sections = {(r.doc, r.number): (r.title, r.level, r.page, r.page_end, r.after) for r in paged.numbered_sections(lines).collect()}
    assert sections == {("d", "1"): ("Overview", 1, 1, 1, None), ("d", "1.1"): ("Registers", 2, 1, 2, "1"), ("d", "1.2"): ("Modes", 2, 2, 3, "1.1"), ("d", "2"): ("Usage", 1, 3, 4, "1.2"), ("e", "1"): ("Alone", 1, 1, 1, None)}
