"""Hardware and software interfaces of functions, merged from two graphs and the functions' own records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trust(read: Column, write: Column) -> Column:
    """The trust class of a register's access protection; null without any.

    Fixed values: PTOP on either side is untrusted, else PCPU is trusted, anything else stands as it is.
    """
    both = F.filter(F.array(read, write), lambda x: x.isNotNull() & (x != ""))
    held = lambda word: F.exists(both, lambda x: F.upper(x).contains(word))
    return F.when(F.size(both) == 0, None).when(held("PTOP"), "Untrusted").when(held("PCPU"), "Trusted").otherwise(F.concat(F.lit("APU: "), F.array_join(both, ", ")))


def register_interface(edges: DataFrame, recorded: DataFrame, listed: DataFrame, twins: DataFrame, twin_edges: DataFrame) -> DataFrame:
    """``function, register, access_type, field, line, device, trust_zone, evidence``: one row for each register that a function touches.

    Evidence by precedence: ``edges`` of the source graph (``function, register,
    access_type, field, line, device``; devices are joined in order, the first field
    and line by line number stay, a missing access comes from the record); without any edge of the function what
    was ``recorded`` for it (``function, register, access_type, field, line``); then the
    ``listed`` names (``function, register, access_type``), written before read.  Registers
    of the design graph (``twins``: ``sfr_id, name, read_apu, write_apu``) give the trust class by their id, or by the name
    after the first underscore.  What the design graph alone says the function accesses
    (``twin_edges``: ``function, sfr_id, name, access_type, read_apu, write_apu``) gives trust to an entry
    that it matches (same id, or a name inside the register's) and is an entry of its own otherwise.
    """
    key = ["function", "register"]
    upper = lambda c: F.upper(F.when(F.col(c) != "", F.col(c)))
    noted = recorded.filter(F.coalesce("register", F.lit("")) != "").groupBy(*key).agg(F.min(F.struct(F.col("line").isNull(), "line", "access_type", "field")).alias("_n"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.col("line").isNull(), "line", F.col(c).alias("v"))))["v"]
    own = edges.groupBy(*key).agg(first("access_type").alias("access_type"), first("field").alias("field"), F.min("line").alias("line"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("device") != "", F.col("device")))), ", ").alias("device"))
    own = own.join(noted, key, "left").select(*key, F.coalesce(upper("access_type"), F.upper("_n.access_type"), F.lit("UNKNOWN")).alias("access_type"), "field", "line", "device", F.lit(1).alias("rank"))
    fallback = noted.join(edges.select("function").distinct(), "function", "left_anti")
    fallback = fallback.select(*key, F.coalesce(F.upper("_n.access_type"), F.lit("UNKNOWN")).alias("access_type"), F.col("_n.field").alias("field"), F.col("_n.line").alias("line"), F.lit("").alias("device"), F.lit(2).alias("rank"))
    names = listed.filter(F.coalesce("register", F.lit("")) != "").select(*key, F.upper("access_type").alias("access_type"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("int").alias("line"), F.lit("").alias("device"), F.when(F.upper("access_type") == "WRITE", 3).otherwise(4).alias("rank"))
    held = reduce(DataFrame.unionByName, (own, fallback, names)).groupBy(*key).agg(F.min(F.struct("rank", "access_type", "field", "line", "device")).alias("_e"))
    entries = held.select(*key, "_e.*")

    zone = trust(F.col("read_apu"), F.col("write_apu"))
    known = twins.select("sfr_id", "name", zone.alias("zone"))
    by_id = known.filter(F.col("sfr_id").isNotNull()).groupBy(F.col("sfr_id").alias("register")).agg(F.min(F.struct("name", "zone")).alias("_i"))
    by_name = known.groupBy(F.col("name").alias("_short")).agg(F.min(F.struct("name", "zone")).alias("_s"))
    short = F.when(F.col("register").contains("_"), F.regexp_replace("register", "^[^_]*_", "")).otherwise(F.col("register"))
    entries = entries.join(by_id, "register", "left").withColumn("_short", short).join(by_name, "_short", "left")
    twin = F.when(F.col("_i").isNull(), F.col("_s")).when(F.col("_s").isNull(), F.col("_i")).otherwise(F.least("_i", "_s"))
    entries = entries.withColumn("zone", twin["zone"]).drop("_short", "_i", "_s")

    said = twin_edges.select("function", "sfr_id", "name", F.upper("access_type").alias("said"), zone.alias("said_zone")).distinct().withColumn("_id", F.xxhash64("function", "sfr_id", "name", "said", "said_zone"))
    meets = (F.col("sfr_id") == F.col("register")) | (F.col("register").contains(F.col("name")) & (F.col("name") != ""))
    met = said.join(entries.select(*key, "rank"), "function").filter(F.coalesce(meets, F.lit(False)))
    one = met.withColumn("_r", F.row_number().over(Window.partitionBy("function", "_id").orderBy("rank", "register"))).filter("_r = 1")
    given = one.groupBy(*key).agg(F.min("said_zone").alias("_zone"))
    entries = entries.join(given, key, "left")
    new = said.join(met.select("_id", "function").distinct(), ["_id", "function"], "left_anti").filter((F.coalesce("sfr_id", F.lit("")) != "") | (F.coalesce("name", F.lit("")) != ""))
    new = new.groupBy("function", F.coalesce(F.when(F.col("sfr_id") != "", F.col("sfr_id")), F.col("name")).alias("register")).agg(F.min("said").alias("said"), F.min("said_zone").alias("said_zone"))
    evidence = F.element_at(F.array(*(F.lit(x) for x in ("edge", "record", "written", "read"))), F.col("rank"))
    shown = entries.select(*key, "access_type", "field", "line", "device", F.coalesce("zone", "_zone").alias("trust_zone"), evidence.alias("evidence"))
    return shown.unionByName(new.select("function", "register", F.coalesce("said", F.lit("UNKNOWN")).alias("access_type"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("int").alias("line"), F.lit("").alias("device"), F.col("said_zone").alias("trust_zone"), F.lit("design").alias("evidence")))
