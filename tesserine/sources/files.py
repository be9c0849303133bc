"""Parsers of engineering files, as scans that Spark distributes by file.

Every reader takes a path or glob and returns one row per parsed record.  Files are
read by Spark (``binaryFile``, ``text``, ``json``, XML), so any store that Spark
reads will do; a file is parsed in one task, files in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File kinds by suffix.
# Suffixes and what they hold.
KINDS = {".md": "markdown", ".json": "json", ".xml": "xml", ".c": "source", ".h": "header", ".csv": "table", ".txt": "text", ".html": "page"}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, content_hash, modified, size_bytes, kind`` of all files: a snapshot for change detection."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), F.coalesce(F.try_element_at(names, suffix), F.lit("other")).alias("kind"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line``: whole files, exploded by line, so numbers are the file's own."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return files.withColumn("line_no", F.col("line_no") + 1)


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """``path, section_no, level, title, body``: text under each ``#`` heading; section 0 is what comes before."""
    own = Window.partitionBy("path").orderBy("line_no")
    head = F.regexp_extract("line", r"^(#{1,6})\s+(.*?)\s*#*$", 1)
    marked = _lines(spark, path).withColumn("_h", head).withColumn("section_no", F.sum((F.col("_h") != "").cast("int")).over(own))
    grouped = marked.groupBy("path", "section_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "_h"))).alias("_l"))
    first = F.element_at("_l", 1)
    titled = first["_h"] != ""
    body = F.when(titled, F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(1)))).otherwise(F.col("_l"))
    body = F.when(titled & (F.size("_l") == 1), F.array()).otherwise(F.transform(body, lambda x: x["line"]))
    title = F.when(titled, F.regexp_extract(first["line"], r"^#{1,6}\s+(.*?)\s*#*$", 1))
    return grouped.select("path", "section_no", F.when(titled, F.length(first["_h"])).alias("level"), title.alias("title"), F.trim(F.array_join(body, "\n"), F.lit(" \n\r\t")).alias("body"))


def c_functions(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, name, parameters, is_static``: function definitions that start on their own line."""
    pattern = r"^\s*((?:static\s+|extern\s+|inline\s+)*)[A-Za-z_][\w\s\*]*?\b([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*\{?\s*$"
    found = _lines(spark, path).withColumn("name", F.regexp_extract("line", pattern, 2))
    keep = (F.col("name") != "") & ~F.col("name").isin("if", "for", "while", "switch", "return", "sizeof")
    return found.filter(keep).select("path", "line_no", "name", F.trim(F.regexp_extract("line", pattern, 3)).alias("parameters"), F.regexp_extract("line", pattern, 1).contains("static").alias("is_static"))


def c_calls(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, callee``: names followed by an opening bracket."""
    names = F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    each = _lines(spark, path).select("path", "line_no", F.explode(names).alias("callee"))
    return each.filter(~F.col("callee").isin("if", "for", "while", "switch", "return", "sizeof"))


def c_includes(spark: SparkSession, path: str) -> DataFrame:
    include = F.regexp_extract("line", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1)
    return _lines(spark, path).withColumn("include", include).filter(F.col("include") != "").select("path", "line_no", "include", F.element_at(F.split("include", "/"), -1).alias("basename"))


def c_defines(spark: SparkSession, path: str) -> DataFrame:
    pattern = r"^\s*#\s*define\s+([A-Za-z_]\w*)\s+(.*?)\s*$"
    name = F.regexp_extract("line", pattern, 1)
    return _lines(spark, path).withColumn("name", name).filter(F.col("name") != "").select("path", "line_no", "name", F.regexp_extract("line", pattern, 2).alias("value"))


def test_reports(spark: SparkSession, path: str) -> DataFrame:
    """``path, suite, name, status, duration_ms, message``: one row per ``testcase`` of JUnit-style XML files."""
    schema = "_name string, _classname string, _time double, failure struct<_message string, _VALUE string>, error struct<_message string, _VALUE string>, skipped string"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return cases.select(
        F.input_file_name().alias("path"), F.col("_classname").alias("suite"), F.col("_name").alias("name"), status.alias("status"),
        F.round(F.col("_time") * 1000).cast("long").alias("duration_ms"), F.coalesce("failure._message", "error._message").alias("message"),
    )


WORK_ITEM = "id long, documentKey string, globalId string, itemType int, fields map<string,string>, modifiedDate timestamp"


def work_items(spark: SparkSession, path: str, value_maps: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Tracker items from JSON lines or arrays: typed columns, markup stripped, codes mapped to labels."""
    items = spark.read.schema(WORK_ITEM).option("multiLine", "true").json(path)
    out = items.select("id", F.col("documentKey").alias("document_key"), F.col("globalId").alias("global_id"), F.col("itemType").alias("item_type"), F.col("fields.name").alias("name"), strip(F.col("fields.description")).alias("description"), F.col("fields.status").alias("status"), F.col("modifiedDate").alias("modified"), "fields")
    for column, names in (value_maps or {}).items():
        mapping = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        out = out.withColumn(column, F.coalesce(F.try_element_at(mapping, F.col(column)), F.col(column)))
    return out


def strip(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"\s+", " "))


def table_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited tables with a header, with the schema given: nothing is inferred."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def config_parameters(spark: SparkSession, path: str, row_tag: str = "parameter") -> DataFrame:
    """``path, name, value, container`` of XML configuration files with attributes or child elements of these names."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("_name string, _value string, _path string, name string, value string").load(path)
    return rows.select(F.input_file_name().alias("path"), F.coalesce("_name", "name").alias("name"), F.coalesce("_value", "value").alias("value"), F.try_element_at(F.filter(F.split(F.coalesce("_path", F.lit("")), "/"), lambda x: x != ""), F.lit(-1)).alias("container"))
