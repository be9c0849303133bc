"""Propagation of accesses along calls, aware of dispatchers, constants and branches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint

Cut = Callable[[DataFrame], DataFrame]
#: Accesses of these contexts are a function's own and settle the matter; a missing context is DIRECT.
OWN_CONTEXTS = ("DIRECT", "STRUCT_CHAIN")
#: The branch that is always taken.
BODY = "B0"


def dispatchers(calls: DataFrame) -> DataFrame:
    """``node``: callers that reach two or more different callees under case labels."""
    cases = calls.filter(F.coalesce("case_label", F.lit("")) != "").groupBy("caller").agg(F.count_distinct("callee").alias("n"))
    return cases.filter(F.col("n") >= 2).select(F.col("caller").alias("node"))


def _links(calls: DataFrame) -> DataFrame:
    """``caller, callee, plain``: each link once; ``plain`` if one of its calls is outside of cases."""
    links = calls.filter(F.col("caller").isNotNull() & F.col("callee").isNotNull()).groupBy("caller", "callee")
    return links.agg(F.bool_or(F.coalesce("case_label", F.lit("")) == "").alias("plain"))


def _upward(base: DataFrame, links: DataFrame, rounds: int, merge: Callable[[DataFrame], DataFrame], cut: Cut, closed: DataFrame | None = None) -> DataFrame:
    """What a caller gets from each function: the function's own rows (``base``: ``callee`` and more) and those of what it calls, through at most ``rounds`` calls.

    ``merge`` makes the rows of a function few in each round, so what is kept grows
    with functions times what they come to, never with pairs of functions.  A ``depth`` counts the calls.
    Functions in ``closed`` pass on only what is their own; only callers that are called themselves take part.
    """
    called = cut(links.select("callee").distinct())
    base = base.join(called, "callee", "left_semi")
    inner = links.join(called.withColumnRenamed("callee", "caller"), "caller", "left_semi")
    if closed is not None:
        inner = inner.join(closed.select(F.col("node").alias("caller")), "caller", "left_anti")
    inner = cut(inner.select("caller", "callee"))
    found = cut(merge(base))
    for _ in range(rounds):
        found = cut(merge(base.unionByName(_step(inner, found).withColumnRenamed("caller", "callee"))))
    return found


def _step(links: DataFrame, found: DataFrame) -> DataFrame:
    """What callers (``caller``) get through their links."""
    given = links.select("caller", "callee").join(found, "callee").drop("callee")
    return given.withColumn("depth", F.col("depth") + 1) if "depth" in given.columns else given


def _alike(starts: DataFrame, links: DataFrame, passed: DataFrame | None, cut: Cut, few: int = 64) -> DataFrame:
    """``node, twin``: starts that call anything, and the start that stands for each.

    Starts that nobody calls, that have the same links (at most ``few`` with their constants) and pass
    the same constants come to the same callees, so one of them is enough.
    """
    own = links.select(F.col("caller").alias("node"), F.struct(F.col("callee"), F.col("plain").cast("string").alias("name"), F.lit(None).cast("string").alias("value")).alias("_l"))
    if passed is not None:
        own = own.unionByName(passed.select(F.col("caller").alias("node"), F.struct(F.col("to").alias("callee"), F.col("name").cast("string").alias("name"), F.col("value").cast("string").alias("value")).alias("_l")))
    callers = cut(links.select(F.col("caller").alias("node")).join(starts.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.lit(0).alias("_0")).drop("_0"))
    own = own.join(callers.join(links.select(F.col("callee").alias("node")).distinct(), "node", "left_anti"), "node", "left_semi")
    small = own.groupBy("node").agg(F.count("*").alias("_n")).filter(F.col("_n") <= few)
    keys = cut(own.join(small.select("node"), "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_set("_l")).alias("_key")))
    twins = keys.groupBy("_key").agg(F.min("node").alias("twin"))
    return cut(callers.join(keys.join(twins, "_key").select("node", "twin"), "node", "left").select("node", F.coalesce("twin", "node").alias("twin")))


def _nearest_two(rows: DataFrame) -> DataFrame:
    """The two nearest callees of each thing accessed: the nearest other than any one function, so also than a start that calls itself on a way round, is among them."""
    key = [c for c in rows.columns if c not in ("depth", "source")]
    near = Window.partitionBy(*key).orderBy("depth", "source")
    once = rows.groupBy(*key, "source").agg(F.min("depth").alias("depth"))
    return once.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= 2).drop("_r")


def open_branches(passed: DataFrame, branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which branches of a callee a start can reach: the pairs ``node, at`` that constants decide, and their open ``node, at, branch_id``.

    ``passed``: ``node, at, name, least, largest``, the constants that a start (``node``) and what it reaches pass
    to a callee (``at``) for each of its parameters.  A pair is decided if the callee has branches on
    parameters and a constant is passed.  A branch on a parameter
    (``branches``: ``callee, branch_id, param, op, value, is_else, chain``) is open
    if the callers disagree about the parameter or pass none, if its
    condition holds for the one value passed, or, for an else, if no ``==`` of its
    chain does; other operators leave it open.  Branches on nothing that a
    parameter decides are not among them, the body always is.
    """
    tested = _tested(branches)
    decided = passed.select("node", "at").distinct().join(tested.select(F.col("callee").alias("at")).distinct(), "at", "left_semi")
    values = passed.filter(F.col("name").isNotNull()).select("node", "at", F.col("name").alias("param"), F.col("least").alias("_passed"), (F.col("least") == F.col("largest")).alias("_one"))
    equal = tested.filter(F.col("op") == "==").groupBy("callee", "chain").agg(F.collect_set("value").alias("_equal"))
    rows = decided.join(tested.join(equal, ["callee", "chain"], "left").withColumnRenamed("callee", "at"), "at").join(values, ["node", "at", "param"], "left")
    known = F.coalesce("_one", F.lit(False))
    other = ~F.coalesce(F.array_contains("_equal", F.col("_passed")), F.lit(False))
    holds = F.when(F.coalesce("is_else", F.lit(False)), other).when(F.col("op") == "==", F.col("value").eqNullSafe(F.col("_passed"))).when(F.col("op") == "!=", ~F.col("value").eqNullSafe(F.col("_passed"))).otherwise(True)
    taken = rows.filter(~known | holds).select("node", "at", "branch_id")
    return decided, taken.unionByName(decided.withColumn("branch_id", F.lit(BODY))).distinct()


def _tested(branches: DataFrame) -> DataFrame:
    return branches.filter(F.col("param").isNotNull() & (F.col("branch_id") != BODY))


def _kinds(met: DataFrame, *key: str) -> DataFrame:
    """The kinds of access of each key, one a row: what is read and written has READ_WRITE."""
    kind = lambda k: F.bool_or(F.col("access_type") == k)
    each = met.groupBy(*key).agg(kind("READ").alias("_r"), kind("WRITE").alias("_w"), kind("READ_WRITE").alias("_b"))
    both = F.col("_r") & F.col("_w") & ~F.col("_b")
    types = F.when(both, F.array(F.lit("READ_WRITE"))).otherwise(F.filter(F.array(F.when(F.col("_r"), "READ"), F.when(F.col("_w"), "WRITE"), F.when(F.col("_b"), "READ_WRITE")), lambda x: x.isNotNull()))
    return each.select(*key, F.explode(types).alias("access_type"))


def propagate(public: DataFrame, calls: DataFrame, accesses: DataFrame, constants: DataFrame | None = None, parameters: DataFrame | None = None, branches: DataFrame | None = None, most: int = 4, cut: Cut = checkpoint) -> DataFrame:
    """What public functions access through their callees: ``node, target, member, access_type, callee, depth``.

    ``public``: ``node``.  ``calls``: ``caller, callee, case_label``.  ``accesses``:
    ``node, target, member, access_type, context, branch_id`` (READ, WRITE or
    READ_WRITE); rows without a member are no struct accesses and stay where they are.

    Callees are reached through at most ``most`` calls.  Dispatchers count but nothing goes on from them;
    of a public function that is one, only calls outside of cases are followed, as one case is taken at a time.
    Where constants decide (:func:`open_branches`; any call leads to who passes them), only accesses in the body and in open branches count.  A
    member that the function accesses itself is not propagated.  A callee that reads and writes
    a member gives READ_WRITE; across callees READ_WRITE comes before
    WRITE, and WRITE before READ.  One row for each member: the nearest callee,
    then the least name.

    Nothing lists the pairs of functions and all that they reach: each function keeps the two nearest
    callees of each kind of access, and pairs only with callees whose branches constants may decide.
    """
    links, closed = cut(_links(calls)), cut(dispatchers(calls))
    held = accesses.filter(F.coalesce("member", F.lit("")) != "").select(F.col("node").alias("at"), "target", "member", F.coalesce("access_type", F.lit("READ")).alias("access_type"), F.coalesce("context", F.lit("DIRECT")).alias("context"), F.coalesce("branch_id", F.lit(BODY)).alias("branch_id"))
    key, passed, base = ["target", "member"], None, held
    if constants is not None:
        able = constants.filter(F.col("value").isNotNull()).join(_tested(branches).select("callee").distinct(), "callee", "left_semi").join(held.select(F.col("at").alias("callee")).distinct(), "callee", "left_semi")
        passed = cut(able.join(parameters.withColumnRenamed("function_id", "callee"), ["callee", "position"], "left").select("caller", F.col("callee").alias("to"), "name", "value").distinct())
        open_ = passed.select(F.col("to").alias("at")).distinct()
        base = held.join(open_, "at", "left_anti")
    base = _kinds(base, "at", *key).withColumn("whole", F.lit(None).cast(held.schema["at"].dataType))
    if passed is not None:
        base = base.unionByName(open_.withColumn("whole", F.col("at")), allowMissingColumns=True)
    base = cut(base.select(F.col("at").alias("callee"), *key, "access_type", "whole", F.col("at").alias("source"), F.lit(0).alias("depth")))
    below = _upward(base, links, most - 1, _nearest_two, cut, closed)

    twins = _alike(public, links, passed, cut)
    first = links.join(twins.select(F.col("twin").alias("caller")).distinct(), "caller", "left_semi")
    followed = first.join(closed.select(F.col("node").alias("caller"), F.lit(True).alias("_closed")), "caller", "left").filter(F.col("_closed").isNull() | F.col("plain"))
    met = _step(followed, below).filter(F.col("caller") != F.col("source")).groupBy("caller", *key, "access_type", "whole").agg(F.min(F.struct("depth", "source")).alias("_c"))
    if passed is not None:
        met = cut(met)
        flows = met.filter(F.col("whole").isNotNull()).select(F.col("caller").alias("node"), F.col("whole").alias("at"), F.col("_c"))
        merge = lambda rows: rows.groupBy("callee", "to", "name").agg(F.min("least").alias("least"), F.max("largest").alias("largest"))
        given = cut(merge(passed.select(F.col("caller").alias("callee"), "to", "name", F.col("value").alias("least"), F.col("value").alias("largest"))))
        around = _step(first, _upward(given, links, most - 1, merge, cut)).unionByName(given.withColumnRenamed("callee", "caller"))
        decided, taken = open_branches(merge(around.withColumnRenamed("caller", "callee")).withColumnsRenamed({"callee": "node", "to": "at"}).join(flows.select("node", "at"), ["node", "at"], "left_semi"), branches)
        chosen = flows.join(held.drop("context"), "at").join(decided.withColumn("_decided", F.lit(True)), ["node", "at"], "left").join(taken.withColumn("_open", F.lit(True)), ["node", "at", "branch_id"], "left")
        chosen = _kinds(chosen.filter(F.col("_decided").isNull() | F.col("_open")), "node", "_c", *key)
        met = met.filter(F.col("whole").isNull()).select(F.col("caller").alias("node"), *key, "access_type", "_c").unionByName(chosen)
    else:
        met = met.withColumnRenamed("caller", "node")
    kinds = ("READ_WRITE", "WRITE", "READ")
    nearest = met.groupBy(F.col("node").alias("twin"), *key).agg(*(F.min(F.when(F.col("access_type") == k, F.col("_c"))).alias(k) for k in kinds))
    own = held.withColumnRenamed("at", "node").groupBy("node", *key).agg(F.bool_or(F.col("context").isin(*OWN_CONTEXTS)).alias("_direct"), F.collect_set("access_type").alias("_own"))
    rows = twins.join(cut(nearest), "twin").join(own, ["node", *key], "left").filter(~F.coalesce("_direct", F.lit(False)))
    left = [F.when(F.col(k).isNotNull() & ~F.coalesce(F.array_contains("_own", k), F.lit(False)), F.struct(F.lit(k).alias("access_type"), F.col(k).alias("_c"))) for k in kinds]
    return rows.select("node", *key, F.coalesce(*left).alias("_f")).filter(F.col("_f").isNotNull()).select("node", *key, "_f.access_type", F.col("_f._c.source").alias("callee"), "_f._c.depth")


def propagate_registers(public: DataFrame, calls: DataFrame, accesses: DataFrame, most: int = 5, cut: Cut = checkpoint) -> DataFrame:
    """``node, register, access_type, field, propagated``: a public function's own register accesses and those of what it calls.

    Dispatchers are not gone through, but a start may be one.  The field is the
    own one or else the least of the callees'.  Each function keeps its registers
    and the least fields, not the functions that it reaches; a way round to the start adds nothing to its own.
    """
    starts, links = cut(public.select("node").distinct()), cut(_links(calls))
    merge = lambda rows: rows.groupBy("callee", "register", "access_type").agg(F.min("field").alias("field"))
    below = _upward(accesses.select(F.col("node").alias("callee"), "register", "access_type", "field"), links, most - 1, merge, cut, dispatchers(calls))
    own = accesses.join(starts, "node", "left_semi").select("node", "register", "access_type", "field", F.lit(False).alias("propagated"))
    through = _step(links.join(starts.withColumnRenamed("node", "caller"), "caller", "left_semi"), below).withColumnRenamed("caller", "node").withColumn("propagated", F.lit(True))
    both = own.unionByName(through).groupBy("node", "register", "access_type")
    return both.agg(F.coalesce(F.min(F.when(~F.col("propagated"), F.col("field"))), F.min("field")).alias("field"), F.bool_and("propagated").alias("propagated"))


def _steps(chain: str) -> Column:
    """The names of a member chain (``a.b->c[i]``) in order, without subscripts and address or dereference marks."""
    bare = F.regexp_replace(F.regexp_replace(chain, r"\[[^\]]*\]", ""), r"[\s&*()]", "")
    return F.filter(F.split(bare, r"\.|->"), lambda x: x != "")


def resolve_chains(uses: DataFrame, variables: DataFrame, aliases: DataFrame, members: DataFrame, most: int = 8, cut: Cut = checkpoint) -> DataFrame:
    """``function_id, variable_id, member, leaf_type, chain, access_type, context``: member chains led back to their global variable.

    ``uses``: ``function_id, chain, access_type, context``; ``variables``:
    ``variable_id, name, type``; ``aliases``: ``function_id, local, chain`` (a local
    pointer and what it was set to); ``members``: ``type, member, member_type``.

    A chain whose first name is a local of its function is replaced by what the local
    stands for, again and again (``most`` times at most, so a cycle ends).  Then the
    names after the variable are looked up one by one in the type of the one
    before: ``member`` is the part of the chain that the types know, ``leaf_type`` its type.
    Chains that lead to no global variable give no row.
    """
    rows = uses.select("function_id", "chain", "access_type", "context", _steps("chain").alias("_s"), F.lit(False).alias("_through"))
    local = cut(aliases.select("function_id", F.col("local").alias("_root"), _steps("chain").alias("_to")).filter(F.size("_to") > 0).groupBy("function_id", "_root").agg(F.min("_to").alias("_to")))
    done = None
    for _ in range(most):
        turned = rows.withColumn("_root", F.get("_s", F.lit(0))).join(local, ["function_id", "_root"], "left")
        turned = cut(turned.withColumn("_more", F.col("_to").isNotNull()))
        stay = turned.filter(~F.col("_more")).drop("_root", "_to", "_more")
        done = stay if done is None else done.unionByName(stay)
        rest = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(1)))
        rows = turned.filter("_more").withColumn("_s", F.when(F.size("_s") > 1, F.concat("_to", rest)).otherwise(F.col("_to"))).withColumn("_through", F.lit(True)).drop("_root", "_to", "_more")
        if rows.isEmpty():
            break
    known = variables.groupBy("name").agg(F.min(F.struct("variable_id", "type")).alias("_v"))
    at = done.withColumn("name", F.get("_s", F.lit(0))).join(known, "name").select("function_id", "chain", "access_type", "context", "_through", "_v.variable_id", F.col("_v.type").alias("type"), "_s", F.lit(1).alias("_at"))
    by = members.groupBy("type", F.col("member").alias("_name")).agg(F.min("member_type").alias("_next"))
    ended = None
    while True:
        looked = cut(at.withColumn("_name", F.get("_s", F.col("_at"))).join(by, ["type", "_name"], "left"))
        stop = looked.filter(F.col("_next").isNull()).drop("_next", "_name")
        ended = stop if ended is None else ended.unionByName(stop)
        at = looked.filter(F.col("_next").isNotNull()).withColumn("type", F.col("_next")).withColumn("_at", F.col("_at") + 1).drop("_next", "_name")
        if at.isEmpty():
            break
    path = F.array_join(F.slice("_s", 2, F.greatest(F.col("_at") - 1, F.lit(0))), ".")
    context = F.when(F.col("_through"), "ALIAS").otherwise(F.coalesce("context", F.lit("DIRECT")))
    return ended.select("function_id", "variable_id", path.alias("member"), F.col("type").alias("leaf_type"), "chain", F.coalesce("access_type", F.lit("READ")).alias("access_type"), context.alias("context"))


def usage_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each function, variable and member: ``function_id, variable_id, member, access_type, contexts, via_chain, n``.

    Different kinds of access make READ_WRITE; contexts are listed in order, the
    longest chain is kept (the least of equally long ones), ``n`` counts the uses.
    """
    types, longest = F.sort_array(F.collect_set("access_type")), F.min(F.struct(-F.length("chain"), F.col("chain").alias("chain")))
    grouped = resolved.groupBy("function_id", "variable_id", "member").agg(types.alias("_t"), F.array_join(F.sort_array(F.collect_set("context")), ",").alias("contexts"), longest.alias("_l"), F.count("*").alias("n"))
    return grouped.select("function_id", "variable_id", "member", F.when(F.size("_t") > 1, "READ_WRITE").otherwise(F.col("_t")[0]).alias("access_type"), "contexts", F.col("_l.chain").alias("via_chain"), "n")


def register_edges(accesses: DataFrame, registers: DataFrame) -> DataFrame:
    """``function_id, register, access_type, field, created``: accesses matched to the registers of their module, or to new ones.

    ``accesses``: ``function_id, module, register, field, access_type``; ``registers``:
    ``name, module``.  An access name without subscripts, dots as underscores,
    matches a register of the same full name anywhere, and in its module one that
    ends with it after an underscore, where each part of a name of several parts
    may carry a number (``CH_CFG`` meets ``ADC_CH0_CFG``).  What matches none becomes a new
    register of its own name.  Names under three characters are left out.  One edge for each function,
    register and kind of access, with the least field.

    Names meet on the endings of register names with numbers taken off, so nothing is compared with all registers.
    """
    norm = F.regexp_replace(F.regexp_replace("register", r"\[.*?\]", ""), r"\.", "_")
    asked = accesses.withColumn("norm", norm).filter(F.length("norm") >= 3).groupBy("function_id", "module", "norm", "access_type").agg(F.min("field").alias("field"), F.min("register").alias("register"))
    plain = lambda c: F.regexp_replace(c, r"\d+(?=_|$)", "")
    parts = F.split("name", "_")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "_"))
    ends = registers.select("name", "module", F.explode(F.when(F.size(parts) > 1, tails)).alias("tail")).withColumn("_key", plain("tail"))
    pattern = F.regexp_replace("norm", "_", r"\\d*_")
    fits = (F.col("tail") == F.col("norm")) | (F.col("norm").contains("_") & F.expr("regexp_like(tail, concat('^', _pattern, '\\\\d*$'))"))
    close = asked.withColumn("_key", plain("norm")).withColumn("_pattern", pattern).join(ends, ["module", "_key"]).filter(fits)
    same = asked.join(registers.select(F.col("name").alias("register")).distinct(), "register").withColumn("name", F.col("register"))
    found = close.select("function_id", "norm", "module", "access_type", "name").unionByName(same.select("function_id", "norm", "module", "access_type", "name")).distinct()
    met = asked.join(found, ["function_id", "norm", "module", "access_type"], "left")
    named = met.select("function_id", F.coalesce("name", "norm").alias("register"), "access_type", "field", F.col("name").isNull().alias("created"))
    return named.groupBy("function_id", "register", "access_type").agg(F.min("field").alias("field"), F.bool_and("created").alias("created"))


def reachable_branches(arguments: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches a call can take: those whose value its constant argument has, or all if the argument isn't constant."""
    fixed = arguments.filter(F.col("value").isNotNull()).join(branches, ["callee", "value"]).select("caller", "callee", "branch")
    free = arguments.filter(F.col("value").isNull()).select("caller", "callee").join(branches, "callee").select("caller", "callee", "branch")
    return fixed.unionByName(free).distinct()
