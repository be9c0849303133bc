"""Further parsers of engineering files: one row per parsed record, files in parallel.

Line formats are parsed by expressions over the lines of whole files; zipped and nested
XML formats by a small helper per file inside ``mapInPandas``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import _lines

C = F.col


def _before(column: str, k: int = 1) -> Column:
    return F.lag(column, k).over(Window.partitionBy("path").orderBy("line_no"))


def _filled(column: Column) -> Column:
    """The last value above that is not null, inside the file."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no"))


def _part(line: str, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", found)


def restructured_sections(spark: SparkSession, path: str) -> DataFrame:
    """``path, section_no, title, mark, body`` of reStructuredText: a title is a line underlined by one repeated mark at least as long."""
    rows = _lines(spark, path)
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line_no"))
    mark = F.regexp_extract(after, r"^([=\-~^\"'`#*+.:_])\1*\s*$", 1)
    title = (F.trim("line") != "") & (mark != "") & (F.length(F.rtrim(after)) >= F.length(F.rtrim("line"))) & ~C("line").rlike(r"^([=\-~^\"'`#*+.:_])\1*\s*$")
    marked = rows.withColumn("_t", F.coalesce(title, F.lit(False))).withColumn("_m", mark)
    marked = marked.withColumn("_u", F.coalesce(_before("_t"), F.lit(False))).withColumn("section_no", F.sum(C("_t").cast("int")).over(Window.partitionBy("path").orderBy("line_no")))
    grouped = marked.groupBy("path", "section_no").agg(
        F.max(F.when(C("_t"), F.trim("line"))).alias("title"), F.max(F.when(C("_t"), C("_m"))).alias("mark"),
        F.array_sort(F.collect_list(F.when(~C("_t") & ~C("_u"), F.struct("line_no", "line")))).alias("_l"),
    )
    return grouped.select("path", "section_no", "title", "mark", F.trim(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit(" \n")).alias("body"))


def sequence_messages(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, sender, receiver, arrow, message`` of PlantUML sequence diagrams; arrows to the left are turned around."""
    pattern = r'^\s*"?([\w. ]+?)"?\s*(<?-+(?:\[[^\]]*\])?-*>?>?|<<?-+)\s*"?([\w. ]+?)"?\s*(?::\s*(.*?))?\s*$'
    rows = _lines(spark, path).filter(C("line").rlike(pattern) & ~C("line").rlike(r"^\s*(participant|actor|note|title|@|')"))
    left, arrow, right = (F.regexp_extract("line", pattern, k) for k in (1, 2, 3))
    back = arrow.startswith("<")
    return rows.select("path", "line_no", F.when(back, right).otherwise(left).alias("sender"), F.when(back, left).otherwise(right).alias("receiver"), arrow.alias("arrow"), F.regexp_extract("line", pattern, 4).alias("message"))


def participants(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, name, alias`` of declared participants of PlantUML diagrams."""
    pattern = r'^\s*(participant|actor|boundary|control|entity|database|class|component|state)\s+"?([^"\n]+?)"?(?:\s+as\s+(\w+))?\s*\{?\s*$'
    rows = _lines(spark, path).withColumn("kind", _part("line", pattern)).filter(C("kind").isNotNull())
    return rows.select("path", "kind", F.regexp_extract("line", pattern, 2).alias("name"), _part("line", pattern, 3).alias("alias"))


def register_fields(spark: SparkSession, path: str) -> DataFrame:
    """``path, register, field, low, high, access, description`` of bit-field structs in register headers."""
    field = r"^\s*(?:volatile\s+)?(?:unsigned|u?int\w*|\w+_t)\s+(?:int\s+)?(\w+)\s*:\s*(\d+)\s*;\s*(?:/\*+<?\s*(?:\\brief\s*)?(?:\[(\d+)(?::(\d+))?\])?\s*(.*?)\s*(?:\(([a-z]+)\))?\s*\*/)?"
    end = r"^\s*\}\s*(\w+)\s*;"
    order = Window.partitionBy("path").orderBy(F.desc("line_no"))
    rows = _lines(spark, path).withColumn("_end", _part("line", end))
    rows = rows.withColumn("register", F.last("_end", ignorenulls=True).over(order)).withColumn("field", _part("line", field)).filter(C("field").isNotNull() & C("register").isNotNull())
    width = F.regexp_extract("line", field, 2).cast("int")
    own = Window.partitionBy("path", "register").orderBy("line_no")
    low = F.sum(width).over(own) - width
    rows = rows.withColumn("low", low).withColumn("high", C("low") + width - 1)
    return rows.filter(~C("field").rlike("(?i)^reserved")).select("path", "register", "field", C("low").cast("int").alias("low"), C("high").cast("int").alias("high"), _part("line", field, 6).alias("access"), F.regexp_extract("line", field, 5).alias("description"))


def register_addresses(spark: SparkSession, path: str) -> DataFrame:
    """``path, register, address`` of ``#define NAME (... 0xF0000000u ...)`` lines."""
    pattern = r"^\s*#\s*define\s+(\w+)\s+.*?(0[xX][0-9A-Fa-f]+)[uUlL]*\)*\s*$"
    rows = _lines(spark, path).withColumn("register", _part("line", pattern)).filter(C("register").isNotNull())
    return rows.select("path", "register", F.conv(F.substring(F.regexp_extract("line", pattern, 2), 3, 16), 16, 10).cast("long").alias("address"))


def documented_functions(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, brief, parameters, returns`` of functions with a documentation comment before them."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    block = r"(?s)/\*\*((?:(?!\*/).)*)\*/\s*((?:[\w\*]+[ \t\*]+)+)(\w+)\s*\("
    both = F.regexp_extract_all("value", F.lit(f"({block})"), F.lit(1))
    rows = files.select("path", F.explode(both).alias("_b"))
    text = F.regexp_replace(F.regexp_extract("_b", block, 1), r"(?m)^\s*\*? ?", "")
    rows = rows.select("path", F.regexp_extract("_b", block, 3).alias("name"), text.alias("_c"))
    params = F.regexp_extract_all("_c", F.lit(r"[@\\]param(?:\[[\w,]*\])?\s+(\w+)"), F.lit(1))
    return rows.select("path", "name", F.trim(F.regexp_extract("_c", r"[@\\]brief\s+([^\n]*)", 1)).alias("brief"), params.alias("parameters"), F.trim(F.regexp_extract("_c", r"[@\\]returns?\s+([^\n]*)", 1)).alias("returns"))


def coverage_lcov(spark: SparkSession, path: str) -> DataFrame:
    """``path, source, n_lines, n_hit, share`` of lcov tracefiles."""
    rows = _lines(spark, path).withColumn("source", _filled(_part("line", r"^SF:(.*)$"))).withColumn("_hits", _part("line", r"^DA:\d+,(\d+)"))
    counted = rows.filter(C("_hits").isNotNull()).groupBy("path", "source").agg(F.count("*").alias("n_lines"), F.count_if(C("_hits") != "0").alias("n_hit"))
    return counted.withColumn("share", F.round(C("n_hit") / C("n_lines"), 4))


def coverage_gcov(spark: SparkSession, path: str) -> DataFrame:
    """``path, source, n_lines, n_hit`` of gcov listings: ``#####`` lines never ran, ``-`` lines hold no code."""
    rows = _lines(spark, path).withColumn("source", F.first(_part("line", r"^\s*-:\s*0:Source:(.*)$"), ignorenulls=True).over(Window.partitionBy("path")))
    rows = rows.withColumn("_n", _part("line", r"^\s*(\d+\*?|#####|=====|-):\s*[1-9]\d*:"))
    return rows.filter(C("_n").isNotNull() & (C("_n") != "-")).groupBy("path", "source").agg(F.count("*").alias("n_lines"), F.count_if(C("_n").rlike(r"^\d")).alias("n_hit"))


def coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """``path, source, n_lines, n_hit`` of Cobertura reports."""
    kind = "_filename string, lines struct<line array<struct<_number int, _hits long>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(kind).load(path)
    lines = F.coalesce("lines.line", F.array())
    return rows.select(F.input_file_name().alias("path"), C("_filename").alias("source"), F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: x["_hits"] > 0)).alias("n_hit"))


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """``path, source, n_lines, n_hit`` of gcovr-style JSON reports."""
    kind = "files array<struct<file string, lines array<struct<line_number int, count long>>>>"
    rows = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.input_file_name().alias("path"), F.explode("files").alias("f"))
    return rows.select("path", C("f.file").alias("source"), F.size("f.lines").alias("n_lines"), F.size(F.filter("f.lines", lambda x: x["count"] > 0)).alias("n_hit"))


def compiler_messages(spark: SparkSession, path: str) -> DataFrame:
    """``path, file, line, column, severity, message, rule`` of compiler logs."""
    pattern = r"^(.+?):(\d+)(?::(\d+))?:\s*(fatal error|error|warning|note):\s*(.*?)(?:\s*\[(-W[^\]]+)\])?\s*$"
    rows = _lines(spark, path).filter(C("line").rlike(pattern))
    return rows.select(
        "path", F.regexp_extract("line", pattern, 1).alias("file"), F.regexp_extract("line", pattern, 2).cast("int").alias("line"), _part("line", pattern, 3).cast("int").alias("column"),
        F.regexp_extract("line", pattern, 4).alias("severity"), F.regexp_extract("line", pattern, 5).alias("message"), _part("line", pattern, 6).alias("rule"),
    )


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, cells`` of tables in markdown (data sheets, hardware specifications): a map from heading to cell for each row."""
    bar = r"^\s*\|.*\|\s*$"
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rule = C("line").rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$")
    rows = _lines(spark, path).withColumn("_r", C("line").rlike(bar)).withColumn("_rule", rule)
    head = F.lead("_rule").over(Window.partitionBy("path").orderBy("line_no"))
    rows = rows.withColumn("_head", C("_r") & F.coalesce(head, F.lit(False))).withColumn("_run", F.sum((~C("_r")).cast("int")).over(Window.partitionBy("path").orderBy("line_no")))
    names = F.last(F.when(C("_head"), cells), ignorenulls=True).over(Window.partitionBy("path", "_run").orderBy("line_no"))
    body = rows.withColumn("_names", names).filter(C("_r") & ~C("_head") & ~C("_rule") & C("_names").isNotNull())
    return body.select("path", "line_no", F.map_from_arrays("_names", F.transform("_names", lambda n, i: F.get(cells, i))).alias("cells"))


def expand_indexed(names: Column) -> Column:
    """``NAME[0..3]`` and ``NAME[0-3]`` as the four names; others stay as they are."""
    pattern = r"^(.*)\[(\d+)(?:\.\.|-)(\d+)\](.*)$"
    at = F.sequence(F.regexp_extract(names, pattern, 2).cast("int"), F.regexp_extract(names, pattern, 3).cast("int"))
    each = F.transform(at, lambda k: F.concat(F.regexp_extract(names, pattern, 1), k.cast("string"), F.regexp_extract(names, pattern, 4)))
    return F.when(names.rlike(pattern), each).otherwise(F.array(names))


def expand_letter(text: Column, letter: Column, value: Column) -> Column:
    """A name or sentence with its index letter replaced by a number: between capitals (``CXPI_CHx_CTL1``) and as a word of its own; a note like ``(x=0-3)`` goes."""
    bare = F.regexp_replace(text, F.concat(F.lit(r"\s*\(\s*"), letter, F.lit(r"\s*=\s*\d+\s*(?:-|\u2013|\u2014|\.\.|\u2026|to)\s*\d+\s*\)")), F.lit(""))
    inside = F.regexp_replace(bare, F.concat(F.lit(r"(?<=[A-Z])"), letter, F.lit(r"(?=[A-Z_0-9]|$)")), value.cast("string"))
    return F.regexp_replace(inside, F.concat(F.lit(r"(?<!\w)"), letter, F.lit(r"(?!\w)")), value.cast("string"))


def expand_rows(rows: DataFrame, noted: str, *columns: str) -> DataFrame:
    """A row for each value of the index that ``noted`` (``... (x=0-3)``) declares, its letter replaced in ``columns`` and ``noted``; ``index`` is null in rows without one."""
    pattern = r"\(\s*([a-z])\s*=\s*(\d+)\s*(?:-|\u2013|\u2014|\.\.|\u2026|to)\s*(\d+)\s*\)"
    part = lambda k: F.regexp_extract(noted, pattern, k)
    values = F.when(C(noted).rlike(pattern), F.sequence(part(2).cast("int"), part(3).cast("int")))
    out = rows.withColumn("_letter", part(1)).select("*", F.explode_outer(values).alias("index"))
    changed = {c: F.when(C("index").isNull(), C(c)).otherwise(expand_letter(C(c), C("_letter"), C("index"))) for c in dict.fromkeys((noted, *columns))}
    return out.withColumns(changed).drop("_letter")


def coverage_verdict(counted: DataFrame) -> DataFrame:
    """Adds ``percent`` and ``verdict`` to ``n_lines, n_hit``: PASS from 80 percent, WARNING from 50, else FAIL; files without lines have 0."""
    percent = F.when(C("n_lines") > 0, F.round(100.0 * C("n_hit") / C("n_lines"), 2)).otherwise(F.lit(0.0))
    return counted.withColumn("percent", percent).withColumn("verdict", F.when(C("percent") >= 80, "PASS").when(C("percent") >= 50, "WARNING").otherwise("FAIL"))


def merge_unique(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """All rows of the first extractor, and those of the second whose key it has not."""
    return first.unionByName(second.dropDuplicates(list(keys)).join(first.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def _each_file(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """``parse(content)`` of every file, as rows with its path in front."""
    names = ["path", *(c.strip().rsplit(" ", 1)[0].split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(where, *row) for row in parse(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _flat(content: bytes) -> Iterator[tuple[str, str | None, str | None]]:
    """Every element with its path of tags (or short names) and its text."""
    stack = [("", ElementTree.fromstring(content))]
    while stack:
        above, node = stack.pop()
        name = next((c.text for c in node if _local(c.tag) == "SHORT-NAME" and c.text), None)
        here = f"{above}/{name or _local(node.tag)}"
        yield here, _local(node.tag), (node.text or "").strip() or None
        stack += [(here, child) for child in reversed(list(node))]


def xml_elements(spark: SparkSession, path: str) -> DataFrame:
    """``path, element, kind, value``: nested XML flattened, each element under the names of its containers."""
    return _each_file(spark, path, _flat, "element string, kind string, value string")


def _model(content: bytes) -> Iterator[tuple]:
    for node in ElementTree.fromstring(content).iter():
        kind, own = _local(node.tag), {_local(k): v for k, v in node.attrib.items()}
        if kind in ("packagedElement", "ownedOperation", "ownedAttribute", "element"):
            yield own.get("id") or own.get("idref"), own.get("type") or kind, own.get("name"), None, None
        elif kind in ("connector", "ownedConnector", "dependency", "generalization"):
            ends = [{_local(k): v for k, v in c.attrib.items()} for c in node if _local(c.tag) in ("source", "target")]
            source, target = (ends + [{}, {}])[:2]
            yield own.get("id") or own.get("idref"), kind, own.get("name"), own.get("client") or source.get("idref"), own.get("supplier") or own.get("general") or target.get("idref")


def uml_model(spark: SparkSession, path: str) -> DataFrame:
    """``path, id, kind, name, source, target``: elements and connectors of exchanged UML models."""
    return _each_file(spark, path, _model, "id string, kind string, name string, source string, target string")


def model_statistics(model: DataFrame) -> DataFrame:
    """``kind, n, n_named``"""
    return model.groupBy("kind").agg(F.count("*").alias("n"), F.count("name").alias("n_named"))


def _requirements(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        for name in sorted(n for n in packed.namelist() if n.lower().endswith(".reqif")):
            root = ElementTree.fromstring(packed.read(name))
            titles = {n.get("IDENTIFIER"): n.get("LONG-NAME") for n in root.iter() if _local(n.tag).startswith("ATTRIBUTE-DEFINITION-")}
            order = {n.text: k for k, n in enumerate(n for n in root.iter() if _local(n.tag) == "SPEC-OBJECT-REF")}
            for item in (n for n in root.iter() if _local(n.tag) == "SPEC-OBJECT"):
                values = {}
                for value in (n for n in item.iter() if _local(n.tag).startswith("ATTRIBUTE-VALUE-")):
                    which = next((r.text for r in value.iter() if _local(r.tag).startswith("ATTRIBUTE-DEFINITION-")), None)
                    text = value.get("THE-VALUE") or " ".join("".join(t.itertext()).strip() for t in value if _local(t.tag) == "THE-VALUE")
                    values[titles.get(which) or which or ""] = text
                yield name, item.get("IDENTIFIER"), order.get(item.get("IDENTIFIER")), list(values.items())


def requirement_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, document, id, place, fields``: objects of zipped requirement-interchange files, with their place in the specification."""
    rows = _each_file(spark, path, _requirements, "document string, id string, place long, fields array<struct<k:string,v:string>>")
    return rows.withColumn("fields", F.map_from_entries("fields"))


_CELL = re.compile(r"([A-Z]+)(\d+)")


def _sheets(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        names = set(packed.namelist())
        read = lambda name: ElementTree.fromstring(packed.read(name))
        text = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in (n for n in read("xl/workbook.xml").iter() if _local(n.tag) == "sheet"):
            target = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
            for row in (n for n in read(f"xl/{links[target]}").iter() if _local(n.tag) == "row"):
                cells: list[str | None] = []
                for cell in row:
                    column = 0
                    for letter in _CELL.match(cell.get("r")).group(1):
                        column = column * 26 + ord(letter) - 64
                    value = next((v.text for v in cell if _local(v.tag) == "v"), None)
                    if cell.get("t") == "s" and value is not None:
                        value = text[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
                    cells += [None] * (column - len(cells))
                    cells[column - 1] = value
                yield sheet.get("name"), int(row.get("r")), cells


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, row_no, cells`` of Excel workbooks."""
    return _each_file(spark, path, _sheets, "sheet string, row_no int, cells array<string>")


def sheet_table(spark: SparkSession, path: str, columns: dict[str, str], header_row: int = 1, sheet: str | None = None) -> DataFrame:
    """Rows below the header of each sheet, as the ``columns`` (name to heading, whatever its case); rows without any of them are left out.

    Test specifications, boundary values, test data and configuration maps are sheets with other headings.
    """
    rows = sheet_rows(spark, path)
    rows = rows if sheet is None else rows.filter(C("sheet") == sheet)
    heads = rows.filter(C("row_no") == header_row).select("path", "sheet", F.transform("cells", lambda x: F.lower(F.trim(x))).alias("_h"))
    body = rows.filter(C("row_no") > header_row).join(F.broadcast(heads), ["path", "sheet"])
    value = lambda title: F.get("cells", F.nullif(F.array_position("_h", title.lower()), F.lit(0)).cast("int") - 1)
    out = body.select("path", "sheet", "row_no", *(value(title).alias(name) for name, title in columns.items()))
    return out.dropna("all", subset=list(columns))


# Headings of the four families of workbooks.
TEST_SPEC = {"test_id": "test case id", "objective": "test objective", "method": "automation method", "requirement": "requirement id", "status": "status"}
BOUNDARY_VALUES = {"parameter": "parameter", "kind": "type", "least": "min", "most": "max", "nominal": "nominal"}
TEST_DATA = {"test_id": "test case id", "parameter": "parameter", "value": "value", "config": "configuration"}
CONFIG_MAP = {"config": "configuration", "device": "device", "supported": "supported"}
