"""The graph of a C source tree: parsed findings, resolved over files, as typed nodes and relationships."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint
from . import dataflow
from .build import Edge, Node, Spec, build
from .patterns import Graph

_BASE = r"([^/]*)$"


def _id(file: Column, name: Column, static: Column) -> Column:
    """Names with external linkage stand for themselves, others belong to their file."""
    return F.when(static, F.concat(file, F.lit(":"), name)).otherwise(name)


def _props(rows: DataFrame, rel: str, src: str, dst: str, *props: str) -> DataFrame:
    """``src, rel, dst, props`` with properties as text, nulls left out."""
    values = F.map_filter(F.create_map(*(x for p in props for x in (F.lit(p), F.col(p).cast("string")))), lambda _, v: v.isNotNull()) if props else F.create_map().cast("map<string,string>")
    return rows.select(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"), values.alias("props"))


def source_graph(found: DataFrame, module: str, registers: DataFrame | None = None, designs: DataFrame | None = None, requirements: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> Graph:
    """Nodes and relationships of the files of a module, from the rows of :func:`tesserine.sources.c_source.c_findings`.

    Nodes: ``SourceFile, Function, DataType, Macro, GlobalVariable, LocalVariable,
    Register, Module`` and those given: ``designs`` (``name``) as
    ``DesignFunction``, ``requirements`` (``guid``) as ``Requirement``, ``registers`` (``name, module``).

    Relationships: ``DEFINED_IN`` (function, type, macro and variable to file), ``BELONGS_TO_MODULE``,
    ``CALLS`` (first order, case labels; a static function of the own file before any other), ``INCLUDES``
    (by file name), ``HAS_GLOBAL`` (file), ``HAS_LOCAL`` (function), ``USES_GLOBAL`` (access,
    contexts, member and chain; through local pointers, not copies, and through callees as
    :func:`dataflow.propagate` says), ``ACCESSES_REGISTER`` (access, field; matched or
    created, and propagated), ``IMPLEMENTS`` (design function of the same name) and ``COVERS`` (requirement by tag).
    """
    found = cut(found)
    kind = lambda k: found.filter(F.col("kind") == k)
    name = F.col("name")
    functions = kind("function").groupBy("file", "name").agg(F.bool_or("flag").alias("flag"), F.min("line").alias("line"), F.max("end").alias("end"), F.first("value").alias("type"), F.first("detail").alias("parameters"))
    functions = cut(functions.withColumn("id", _id(F.col("file"), name, F.col("flag"))).withColumn("public", ~F.col("flag")))
    owners = functions.select("file", F.col("name").alias("owner"), F.col("id").alias("function_id"))
    owned = lambda k: kind(k).join(owners, ["file", "owner"])
    here = functions.select("file", "name", F.col("id").alias("_here"))
    there = functions.filter("public").groupBy("name").agg(F.min("id").alias("_there"))
    resolve = lambda rows: rows.join(here, ["file", "name"], "left").join(there, "name", "left").withColumn("callee", F.coalesce("_here", "_there")).filter(F.col("callee").isNotNull())

    calls = cut(resolve(owned("call")).select(F.col("function_id").alias("caller"), "callee", F.col("value").alias("case_label"), "position"))
    constants = resolve(owned("constant")).select(F.col("function_id").alias("caller"), "callee", "position", F.regexp_replace("value", "[uUlL]+$", "").alias("value"))
    parameters = owned("parameter").select("function_id", "position", "name")
    branches = owned("branch").join(parameters.withColumnRenamed("name", "param"), ["function_id", "position"], "left")
    chained = branches.filter(F.col("param").isNotNull()).groupBy("function_id", "branch").agg(F.min("param").alias("_param"))
    branches = branches.join(chained, ["function_id", "branch"], "left")
    branches = branches.select(F.col("function_id").alias("callee"), F.col("name").alias("branch_id"), F.coalesce("param", F.when(F.col("flag"), F.col("_param"))).alias("param"), F.col("detail").alias("op"), F.regexp_replace("value", "[uUlL]+$", "").alias("value"), F.col("flag").alias("is_else"), F.col("branch").alias("chain"))

    globals_ = kind("global").groupBy("file", "name").agg(F.first("value").alias("type"), F.bool_or("flag").alias("flag"), F.min("line").alias("line"))
    globals_ = cut(globals_.withColumn("variable_id", F.concat("file", F.lit(":"), "name")))
    locals_ = cut(owned("local").select("function_id", "file", "name", "value", "detail", "flag"))
    hidden = locals_.select("function_id", "name", "flag").unionByName(parameters.select("function_id", "name", F.lit(True).alias("flag")))
    held = hidden.groupBy("function_id", "name").agg(F.bool_or("flag").alias("_pointer"))
    set_to = locals_.select("function_id", "name", "detail").unionByName(owned("alias").select("function_id", "name", "detail"))
    set_to = set_to.join(held, ["function_id", "name"]).filter(F.col("detail").startswith("&") | (F.col("_pointer") & F.col("detail").isNotNull()))
    aliases = set_to.select("function_id", F.col("name").alias("local"), F.col("detail").alias("chain"))
    root = F.regexp_extract("name", r"^(\w+)", 1)
    pointers = aliases.select("function_id", F.col("local").alias("_root")).distinct()
    shadow = hidden.select("function_id", F.col("name").alias("_root")).distinct().join(pointers, ["function_id", "_root"], "left_anti")
    uses = owned("use").withColumn("_root", root).join(shadow, ["function_id", "_root"], "left_anti")
    uses = uses.select("function_id", F.col("name").alias("chain"), F.col("value").alias("access_type"), F.lit(None).cast("string").alias("context"), "branch")
    members = kind("member").filter(F.col("value") != "enum").select(F.col("owner").alias("type"), F.col("name").alias("member"), F.regexp_replace("value", r"^(?:const|volatile)\s+|\s*\*+$", "").alias("member_type"))
    resolved = cut(dataflow.resolve_chains(uses.withColumn("context", F.col("branch")), globals_.select("variable_id", "name", "type"), aliases, members, cut=cut))
    placed = resolved.withColumn("branch", F.when(F.col("context") != "ALIAS", F.col("context"))).withColumn("context", F.when(F.col("context") == "ALIAS", "ALIAS").otherwise("DIRECT"))
    direct = dataflow.usage_edges(placed).withColumn("callee", F.lit(None).cast("string"))
    public = functions.filter("public").select(F.col("id").alias("node"))
    accesses = placed.select(F.col("function_id").alias("node"), F.col("variable_id").alias("target"), "member", "access_type", "context", F.col("branch").alias("branch_id"))
    through = dataflow.propagate(public, calls, accesses, constants, parameters, branches, cut=cut)
    through = through.select(F.col("node").alias("function_id"), F.col("target").alias("variable_id"), "member", "access_type", F.lit("CALLEE_PROPAGATED").alias("contexts"), F.lit(None).cast("string").alias("via_chain"), F.lit(None).cast("long").alias("n"), "callee")
    usage = direct.unionByName(through)

    named = owned("register").select("function_id", F.lit(module).alias("module"), F.col("name").alias("register"), F.col("detail").alias("field"), F.col("value").alias("access_type"))
    known = registers.select("name", "module") if registers is not None else found.sparkSession.createDataFrame([], "name string, module string")
    own = cut(dataflow.register_edges(named, known).withColumnRenamed("function_id", "node"))
    reached = dataflow.propagate_registers(public, calls, own, cut=cut)
    private = own.join(public, "node", "left_anti").select("node", "register", "access_type", "field", F.lit(False).alias("propagated"))
    register_uses = reached.unionByName(private)

    types, macros = kind("type").groupBy("name").agg(F.min("file").alias("file"), F.first("value").alias("type")), kind("macro").groupBy("file", "name").agg(F.first("value").alias("value"))
    files = found.select("file").distinct()
    includes = kind("include").select("file", F.regexp_extract("name", _BASE, 1).alias("_base")).distinct()
    by_name = files.select(F.col("file").alias("to"), F.regexp_extract("file", _BASE, 1).alias("_base"))
    sources = {
        "files": files.withColumn("module", F.lit(module)), "functions": functions, "types": types, "macros": macros.withColumn("id", F.concat("file", F.lit(":"), "name")), "globals": globals_,
        "locals": locals_.withColumn("id", F.concat("function_id", F.lit(":"), "name")), "registers": own.select(F.col("register").alias("name")).unionByName(known.select("name")).distinct(),
        "includes": includes.join(by_name, "_base"), "covers": kind("cover").join(owners, ["file", "owner"]).select("function_id", F.col("name").alias("guid")),
        "designs": designs if designs is not None else files.select(F.col("file").alias("name")).limit(0), "requirements": requirements if requirements is not None else files.select(F.col("file").alias("guid")).limit(0),
    }
    spec = Spec(
        (Node("SourceFile", "files", "file"), Node("Module", "files", "module"), Node("Function", "functions", "id", ("name", "type", "parameters", "line", "end", "public")), Node("DataType", "types", "name", ("type",)), Node("Macro", "macros", "id", ("name", "value")),
         Node("GlobalVariable", "globals", "variable_id", ("name", "type")), Node("LocalVariable", "locals", "id", ("name", "value")), Node("Register", "registers", "name"), Node("DesignFunction", "designs", "name"), Node("Requirement", "requirements", "guid")),
        (Edge("DEFINED_IN", "functions", ("Function", "id"), ("SourceFile", "file")), Edge("DEFINED_IN", "types", ("DataType", "name"), ("SourceFile", "file")), Edge("DEFINED_IN", "macros", ("Macro", "id"), ("SourceFile", "file")), Edge("DEFINED_IN", "globals", ("GlobalVariable", "variable_id"), ("SourceFile", "file")),
         Edge("BELONGS_TO_MODULE", "files", ("SourceFile", "file"), ("Module", "module")), Edge("HAS_GLOBAL", "globals", ("SourceFile", "file"), ("GlobalVariable", "variable_id")), Edge("HAS_LOCAL", "locals", ("Function", "function_id"), ("LocalVariable", "id")), Edge("INCLUDES", "includes", ("SourceFile", "file"), ("SourceFile", "to")),
         Edge("IMPLEMENTS", "functions", ("Function", "id"), ("DesignFunction", "name")), Edge("COVERS", "covers", ("Function", "function_id"), ("Requirement", "guid"))),
    )
    base = build(spec, sources)
    label = lambda of, column: F.concat(F.lit(f"{of}:"), F.col(column))
    linked = calls.groupBy("caller", "callee").agg(F.min("position").alias("order"), F.array_join(F.sort_array(F.collect_set("case_label")), ",").alias("cases"))
    more = [
        _props(linked.withColumn("a", label("Function", "caller")).withColumn("b", label("Function", "callee")), "CALLS", "a", "b", "order", "cases"),
        _props(usage.withColumn("a", label("Function", "function_id")).withColumn("b", label("GlobalVariable", "variable_id")), "USES_GLOBAL", "a", "b", "member", "access_type", "contexts", "via_chain", "callee"),
        _props(register_uses.withColumn("a", label("Function", "node")).withColumn("b", label("Register", "register")), "ACCESSES_REGISTER", "a", "b", "access_type", "field", "propagated"),
    ]
    return Graph(base.nodes, reduce(DataFrame.unionByName, more, base.edges))
