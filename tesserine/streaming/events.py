"""Streaming twins of the time-window queries.

Each takes a streaming (or batch) DataFrame of ``event_id, ts, user_id, event_type, value``
and returns the transformed stream; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlay import newest

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpointed file log is the modified-since watermark."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("minute"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions that end ``gap`` after their last event; state of a user goes with the watermark."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("last_seen"))
    return grouped.select("user_id", "started", "last_seen", "n")


def rate_limited(events: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Every event with its count in the moving window of its key, and whether it exceeds the limit.

    The state of a key is the times that an event inside the watermark may still
    count, so it is bounded by the traffic of that span, and it goes when the
    watermark has left the key's last window behind.  An event that comes late
    counts what lies before it in time, whatever came in between; counts that were
    given before it came stay as they are.
    """
    span = seconds * 1_000_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        own = rows["ts"].to_numpy("datetime64[ns]").astype(np.int64)
        held = np.sort(np.concatenate([np.array(state.get[0] if state.exists else [], np.int64), own]))
        counts = np.searchsorted(held, own, side="right") - np.searchsorted(held, own - span, side="left")
        oldest = state.getCurrentWatermarkMs() * 1_000_000 - span
        state.update((held[held >= oldest].tolist(),))
        state.setTimeoutTimestamp(max(int(held[-1] + span) // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "n": counts, "limited": counts > limit})

    return events.select("user_id", "event_id", "ts").withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        step, "event_id long, user_id long, n long, limited boolean", "times array<long>", "append", "EventTimeTimeout"
    )


def upsert_each_batch(target_path: str, key: str, by: str = "ts", buckets: int = 64):
    """A ``foreachBatch`` sink that keeps the last row of each key by ``by``, whatever order rows come in.

    Keys are dealt to ``buckets``; an epoch writes a new version of the buckets that
    it touches and leaves the others.  An epoch that runs again reads what came
    before it and writes the same.  :func:`stored` reads the table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh = newest(batch, key, by=by)
        touched = [r[0] for r in fresh.select(bucket.alias("_bucket")).distinct().collect()]
        if touched:
            before = _versions(batch.sparkSession, target_path, epoch)
            old = [before[b] for b in touched if b in before]
            rows = newest(fresh.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(*old)), key, by=by) if old else fresh
            rows.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{target_path}/version={epoch}")

    return write


def stored(spark: SparkSession, target_path: str) -> DataFrame:
    """The table that :func:`upsert_each_batch` keeps: every bucket's last version."""
    return spark.read.parquet(*_versions(spark, target_path, 2**62).values())


def _versions(spark: SparkSession, target_path: str, before: int) -> dict[int, str]:
    """The folder of each bucket's last complete version below ``before``, from a listing in the table's own file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(target_path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, str] = {}
    done = sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in files.globStatus(hadoop.Path(root, "version=*/_SUCCESS")) or ())
    for version in (v for v in done if v < before):
        for status in files.globStatus(hadoop.Path(root, f"version={version}/_bucket=*")):
            found[int(status.getPath().getName().split("=")[1])] = status.getPath().toString()
    return found
