"""Incremental loads: changes between file snapshots, watermarks, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """``path, change_type, old_hash, new_hash`` of files that were ADDED, MODIFIED or DELETED.

    ``also`` (``path``) names files that a version-control diff lists: they count as
    modified even with an unchanged hash.  Unchanged files give no row.
    """
    old, new = before.select("path", F.col("content_hash").alias("old_hash")), after.select("path", F.col("content_hash").alias("new_hash"))
    both = old.join(new, "path", "full_outer")
    listed = both.withColumn("_listed", F.lit(False)) if also is None else both.join(also.select("path").distinct().withColumn("_listed", F.lit(True)), "path", "left")
    kind = F.when(F.col("old_hash").isNull(), "ADDED").when(F.col("new_hash").isNull(), "DELETED").when((F.col("old_hash") != F.col("new_hash")) | F.coalesce("_listed", F.lit(False)), "MODIFIED")
    return listed.withColumn("change_type", kind).filter(F.col("change_type").isNotNull()).select("path", "change_type", "old_hash", "new_hash")


def modified_since(items: DataFrame, watermark, column: str = "modified") -> tuple[DataFrame, object]:
    """Items changed after the watermark, and the next watermark (the greatest time seen, or the old one)."""
    fresh = items if watermark is None else items.filter(F.col(column) > F.lit(watermark))
    top = fresh.agg(F.max(column)).first()[0]
    return fresh, top if top is not None else watermark


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``df`` has; a second run leaves the same rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
