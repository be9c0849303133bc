"""Vectors from parsed code and relaxed-profile records: one chunk for each function, type, register or section, embedded and upserted in batches.

Embedding is a column expression that callers may replace; without a model it is the
deterministic hash embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hash_embedding, name_uuid
from .snapshots import Snapshots

MOST_BODY_CHARS = 50_000


def code_chunks(found: DataFrame, files: DataFrame, module: str, most_chars: int = MOST_BODY_CHARS) -> DataFrame:
    """``point_id, document, payload`` for every function of C files (``file, text``), from their findings.

    The document has the head, what is called, read and written, and the lines of the body; bodies
    above ``most_chars`` (generated tables) have their head and lists only.
    """
    kind = lambda k: found.filter(F.col("kind") == k)
    functions = kind("function").select("file", F.col("name").alias("owner"), "value", "detail", "flag", "line", "end")
    names = lambda rows, value, alias: rows.groupBy("file", "owner").agg(F.array_join(F.sort_array(F.collect_set(value)), ", ").alias(alias))
    calls, registers = names(kind("call"), F.col("name"), "_calls"), names(kind("register"), F.concat_ws(" ", "value", "name"), "_registers")
    rows = functions.join(calls, ["file", "owner"], "left").join(registers, ["file", "owner"], "left").join(files.select("file", F.split("text", "\n").alias("_lines")), "file")
    body = F.array_join(F.slice("_lines", F.col("line"), F.greatest(F.col("end") - F.col("line") + 1, F.lit(0))), "\n")
    rows = rows.withColumn("_body", F.when(F.length(body) <= most_chars, body))
    part = lambda title, column: F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(f"{title}: "), column))
    document = F.concat_ws("\n", part("Function", F.col("owner")), part("Module", F.lit(module)), part("File", F.col("file")), part("Returns", F.col("value")), part("Parameters", F.regexp_replace("detail", ";", ", ")), part("Calls", F.col("_calls")), part("Registers", F.col("_registers")), F.col("_body"))
    payload = F.create_map(*(x for k, v in {"type": F.lit("function"), "name": F.col("owner"), "file": F.col("file"), "module": F.lit(module), "line": F.col("line").cast("string"), "static": F.col("flag").cast("string")}.items() for x in (F.lit(k), v)))
    return rows.select(name_uuid(F.concat_ws("/", F.lit(module), "file", "owner")).alias("point_id"), document.alias("document"), payload.alias("payload"))


def record_chunks(rows: DataFrame, kind: str, module: str, key: str, *columns: str) -> DataFrame:
    """``point_id, document, payload`` of parsed records: a line for each of ``columns`` that has a value; records without ``key`` are left out."""
    shown = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    document = F.concat_ws("\n", F.concat(F.lit(f"[{kind}] "), F.col(key).cast("string")), *shown)
    payload = F.create_map(F.lit("type"), F.lit(kind), F.lit("name"), F.col(key).cast("string"), F.lit("module"), F.lit(module))
    return rows.filter(F.col(key).isNotNull()).select(name_uuid(F.concat(F.lit(f"{module}/{kind}/"), F.col(key).cast("string"))).alias("point_id"), document.alias("document"), payload.alias("payload")).dropDuplicates(["point_id"])


def upsert(store: Snapshots, collection: str, chunks: DataFrame, embed: Callable[[Column], Column] = hash_embedding, scope: Column | None = None) -> dict[str, int]:
    """Bring a collection of ``store`` up to date with ``chunks``; returns how many points were kept, embedded and removed.

    Only documents whose digest is new or changed are embedded; vectors of others are carried over.  Points of
    ``scope`` (a condition over the payload; all without one) that ``chunks`` no longer has
    are removed.  The new version is committed whole, so searches see all of a load or none of it.
    """
    before, new = store.read(collection), chunks.withColumn("digest", F.sha2("document", 256))
    if before is None:
        made = new.withColumn("embedding", embed(F.col("document")))
        counts = {"kept": 0, "removed": 0}
    else:
        held = before.select("point_id", F.col("digest").alias("_digest"), F.col("embedding").alias("_embedding"))
        met = new.join(held, "point_id", "left").withColumn("_same", F.col("digest") == F.col("_digest"))
        made = met.withColumn("embedding", F.when(F.coalesce("_same", F.lit(False)), F.col("_embedding")).otherwise(embed(F.col("document")))).drop("_digest", "_embedding", "_same")
        other = before.join(new.select("point_id"), "point_id", "left_anti")
        inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
        counts = {"kept": new.join(held, "point_id").filter(F.col("digest") == F.col("_digest")).count(), "removed": other.filter(inside).count()}
        made = made.unionByName(other.filter(~inside))
    total = new.count()
    store.stage({collection: made}, keep=[n for n in store.tables() if n != collection])
    store.commit()
    return counts | {"embedded": total - counts["kept"]}
