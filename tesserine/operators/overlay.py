"""Overlays: uncommitted versions of rows laid over production rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, *keys: str, by: str | None = None) -> DataFrame:
    """One row for each key: the last by ``by``, or the greatest of all its columns, so repeated keys give the same row on every run."""
    whole = F.struct(*rows.columns)
    last = F.max(whole) if by is None else F.max(F.struct(F.col(by).alias("_by"), whole.alias("_row")))["_row"]
    return rows.groupBy(*keys).agg(last.alias("_r")).select("_r.*")


def merge_edges(target: DataFrame, updates: DataFrame, *keys: str, by: str) -> DataFrame:
    """Edge upsert: of all rows with one key the last by ``by`` stays; merging twice changes nothing."""
    return newest(target.unionByName(updates, allowMissingColumns=True), *keys, by=by)


def shadow(production: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Overlay rows win, column by column; ``origin`` tells ``production``, ``shadow`` or ``overlay``.

    ``overlay`` may have a boolean ``deleted``: such keys disappear.
    """
    columns = [c for c in production.columns if c != key]
    o = overlay if "deleted" in overlay.columns else overlay.withColumn("deleted", F.lit(False))
    o = newest(o, key).select(key, "deleted", *(F.col(c).alias(f"_o_{c}") for c in columns), F.lit(True).alias("_over"))
    joined = production.withColumn("_prod", F.lit(True)).join(o, key, "full_outer").filter(~F.coalesce("deleted", F.lit(False)))
    origin = F.when(F.col("_over").isNull(), "production").when(F.col("_prod").isNull(), "overlay").otherwise("shadow")
    return joined.select(key, *(F.coalesce(f"_o_{c}", c).alias(c) for c in columns), origin.alias("origin"))


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, change``: ``added``, ``removed``, ``modified`` (any shared column differs, nulls being equal) or ``unchanged``."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    b = before.select(key, F.struct(*columns).alias("_b")) if columns else before.select(key, F.lit(1).alias("_b"))
    a = after.select(key, F.struct(*columns).alias("_a")) if columns else after.select(key, F.lit(1).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def merge(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Idempotent upsert: non-null values of the update win, unknown keys are added; merging twice changes nothing."""
    columns = [c for c in target.columns if c != key]
    u = newest(updates, key).select(key, *(F.col(c).alias(f"_u_{c}") for c in columns))
    return target.join(u, key, "full_outer").select(key, *(F.coalesce(f"_u_{c}", c).alias(c) for c in columns))
