"""Records of trackers and simulators from files: requirement blocks, test cases with steps and links, results, relations, module contents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint
from .files import _lines, strip

C = F.col


def _srs_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines inside requirement blocks, with the block's id and name and the section they are in."""
    own = Window.partitionBy("path").orderBy("line_no")
    bare = F.trim(F.regexp_replace("line", r"^\s*(?:/\*!|/\*\*?|\*(?!/))\s?|\*/\s*$", ""))
    opens = r"(?i)[@\\]uid\s*\{\s*([A-Z0-9][A-Z0-9_-]*)\s*,\s*([^}]+?)\s*\}"
    rows = _lines(spark, path).withColumn("line", bare)
    rows = rows.withColumn("_open", C("line").rlike(opens)).withColumn("_end", C("line").rlike(r"(?i)[@\\]enduid\b"))
    rows = rows.withColumn("block", F.sum((C("_open") & ~C("_end")).cast("int")).over(own)).withColumn("_closed", F.max(C("_end").cast("int")).over(Window.partitionBy("path", "block").orderBy("line_no")))
    inside = rows.filter((C("block") > 0) & (C("_closed") == 0))
    block = Window.partitionBy("path", "block").orderBy("line_no")
    head = inside.withColumn("id", F.first(F.when(C("_open"), F.regexp_extract("line", opens, 1)), ignorenulls=True).over(block)).withColumn("name", F.first(F.when(C("_open"), F.regexp_extract("line", opens, 2)), ignorenulls=True).over(block))
    item = F.regexp_extract("line", r"(?i)[@\\]uid_litem\s*\{\s*([^}]+?)\s*\}", 1)
    trace = C("line").rlike(r"(?i)[@\\]uid_fw_trace\b")
    section = F.when(item != "", F.lower(item)).when(trace, "forward trace")
    marked = head.withColumn("_mark", section).withColumn("section", F.last("_mark", ignorenulls=True).over(block))
    return marked.filter(C("_mark").isNull() & ~C("_open"))


def srs_requirements(spark: SparkSession, path: str) -> DataFrame:
    """``path, id, name, description`` of requirement blocks in documentation sources; the description falls back to the name."""
    lines = _srs_lines(spark, path)
    said = lines.filter((C("section") == "description") & (C("line") != "")).groupBy("path", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("_d"))
    opens = r"(?i)[@\\]uid\s*\{\s*([A-Z0-9][A-Z0-9_-]*)\s*,\s*([^}]+?)\s*\}"
    heads = _lines(spark, path).filter(C("line").rlike(opens) & ~C("line").rlike(r"(?i)[@\\]enduid\b"))
    heads = heads.withColumn("block", F.row_number().over(Window.partitionBy("path").orderBy("line_no")))
    rows = heads.select("path", "block", F.regexp_extract("line", opens, 1).alias("id"), F.regexp_extract("line", opens, 2).alias("name"))
    return rows.join(said, ["path", "block"], "left").select("path", "id", "name", F.coalesce("_d", "name").alias("description"))


def srs_traces(spark: SparkSession, path: str) -> DataFrame:
    """``path, requirement_id, function, description`` of the forward traces in requirement blocks."""
    pattern = r"(?i)[@\\]tr\s*\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\s*:?\s*(.*)"
    rows = _srs_lines(spark, path).filter((C("section") == "forward trace") & C("line").rlike(pattern))
    text = F.rtrim(F.trim(F.regexp_extract("line", pattern, 2)), F.lit("."))
    return rows.select("path", C("id").alias("requirement_id"), F.regexp_extract("line", pattern, 1).alias("function"), F.when(text != "", text).alias("description"))


#: Words of simulators for the outcome of a test.  Fixed values.
OUTCOMES = {"PASS": ("PASSED", "PASS", "OK", "SUCCESS"), "FAIL": ("FAILED", "FAIL", "NOK", "FAILURE"), "ERROR": ("ERROR", "ABORT", "CRASH")}
_CASE = (
    "_name string, _Name string, _result string, _status string, _verdict string, _duration_ms string, Result struct<_VALUE string, _status string>, "
    "Duration string, Time string, FailureInfo string, ErrorMessage string, Message string, Description string"
)


def simulator_results(spark: SparkSession, path: str, tags: tuple[str, ...] = ("TestCase", "Test")) -> DataFrame:
    """``path, test_name, status, duration_ms, message`` of simulation reports.

    The outcome is a result element's text or status, or else the result, status or verdict attribute, in
    whatever words; the duration is an element in seconds or an attribute in
    milliseconds; the message is the first of failure text, error, message and description.  Names are read without regard to case.
    """
    parts = []
    for tag in tags:
        rows = spark.read.format("xml").option("rowTag", tag).schema(_CASE.replace(", _Name string", "")).load(path)
        said = F.upper(F.trim(F.coalesce(C("Result._VALUE"), C("Result._status"), C("_result"), C("_status"), C("_verdict"), F.lit("UNKNOWN"))))
        status = reduce(lambda rest, k: F.when(said.isin(*OUTCOMES[k]), k).otherwise(rest), OUTCOMES, F.lit("UNKNOWN"))
        seconds = F.coalesce("Duration", "Time")
        span = F.when(seconds.isNotNull(), F.coalesce((seconds.try_cast("double") * 1000).cast("long"), F.lit(0))).otherwise(F.coalesce(C("_duration_ms").try_cast("double").cast("long"), F.lit(0)))
        message = F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in ("FailureInfo", "ErrorMessage", "Message", "Description")))
        parts.append(rows.select(F.input_file_name().alias("path"), F.coalesce("_name", F.lit("unknown")).alias("test_name"), status.alias("status"), span.alias("duration_ms"), message.alias("message")))
    return reduce(DataFrame.unionByName, parts)


TEST_CASE = (
    "id string, title string, status string, type string, document string, component string, updated timestamp, fields map<string,string>, "
    "steps array<struct<index:int,description:string,expected:string>>, links array<struct<id:string,role:string>>"
)


def test_cases(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``cases`` (``id, title, status, type, document, component, updated, n_steps``), ``steps`` (``case_id, index, description, expected``) and ``links`` (``case_id, role, target``) from JSON.

    Steps without an index are numbered in order; markup is taken out of texts; links without target are left out.
    """
    rows = spark.read.schema(TEST_CASE).option("multiLine", "true").json(path).filter(C("id").isNotNull())
    cases = rows.select("id", "title", "status", "type", "document", "component", "updated", F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps"))
    steps = rows.select(C("id").alias("case_id"), F.posexplode("steps").alias("_k", "_s"))
    steps = steps.select("case_id", F.coalesce("_s.index", C("_k") + 1).alias("index"), strip(C("_s.description")).alias("description"), strip(C("_s.expected")).alias("expected"))
    links = rows.select(C("id").alias("case_id"), F.explode("links").alias("_l")).filter(C("_l.id").isNotNull()).select("case_id", C("_l.role").alias("role"), C("_l.id").alias("target")).distinct()
    return {"cases": cases, "steps": steps, "links": links}


RESULTS = "project struct<name:string,releases:array<struct<name:string,devices:array<struct<name:string,configuration:string,results:array<struct<testCase:string,verdict:string,executed:timestamp>>>>>>>"


def release_results(spark: SparkSession, path: str, only_latest: bool = True) -> DataFrame:
    """``project, release, device, configuration, case_id, verdict, executed`` of nested result files; with ``only_latest`` the last run of each."""
    rows = spark.read.schema(RESULTS).option("multiLine", "true").json(path).select(C("project.name").alias("project"), F.explode("project.releases").alias("_r"))
    rows = rows.select("project", C("_r.name").alias("release"), F.explode("_r.devices").alias("_d")).select("project", "release", C("_d.name").alias("device"), C("_d.configuration").alias("configuration"), F.explode("_d.results").alias("_t"))
    flat = rows.select("project", "release", "device", "configuration", C("_t.testCase").alias("case_id"), F.upper("_t.verdict").alias("verdict"), C("_t.executed").alias("executed"))
    if not only_latest:
        return flat
    key = ["project", "release", "device", "configuration", "case_id"]
    last = flat.groupBy(*key).agg(F.max(F.struct("executed", "verdict")).alias("_l"))
    return last.select(*key, "_l.verdict", "_l.executed")


RELATION = "id long, fromItem long, toItem long, relationshipType int"


def relationships(spark: SparkSession, path: str, items: DataFrame | None = None, types: dict[int, str] | None = None) -> DataFrame:
    """``source, target, type`` of tracker relations, once each; of given ``items`` (``id``) those that start or end at one, ``direction`` downstream or upstream."""
    rows = spark.read.schema(RELATION).option("multiLine", "true").json(path).filter(C("fromItem").isNotNull() & C("toItem").isNotNull())
    names = F.create_map(*(F.lit(x) for pair in (types or {}).items() for x in pair)) if types else None
    kind = C("relationshipType").cast("string") if names is None else F.coalesce(F.try_element_at(names, C("relationshipType")), C("relationshipType").cast("string"))
    rows = rows.select(C("fromItem").alias("source"), C("toItem").alias("target"), kind.alias("type")).distinct()
    if items is None:
        return rows
    ids = items.select("id").distinct()
    down = rows.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").withColumn("direction", F.lit("downstream"))
    up = rows.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").withColumn("direction", F.lit("upstream"))
    return down.unionByName(up)


def module_items(items: DataFrame, modules: DataFrame, folder_type: int = 32, recurse: bool = True, most: int = 64, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """``module, id, depth``: what lies under each of ``modules`` (``id``), down through folders, folders themselves left out.

    ``items``: ``id, parent, item_type``.  A folder that contains itself is entered once.
    """
    held = cut(items.filter(C("parent").isNotNull()).select(C("id"), "parent", "item_type").distinct())
    front = modules.select(C("id").alias("module"), C("id").alias("_at")).distinct()
    seen = front
    out = None
    for depth in range(1, most + 1):
        below = held.withColumnRenamed("parent", "_at").join(front, "_at").select("module", "id", "item_type").distinct()
        below = cut(below.join(seen.withColumnRenamed("_at", "id"), ["module", "id"], "left_anti"))
        found = below.filter(~C("item_type").eqNullSafe(folder_type)).select("module", "id", F.lit(depth).alias("depth"))
        out = found if out is None else out.unionByName(found)
        front = below.filter(C("item_type") == folder_type).select("module", C("id").alias("_at"))
        seen = seen.unionByName(front)
        if not recurse or front.isEmpty():
            break
    return out.groupBy("module", "id").agg(F.min("depth").alias("depth"))
