"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession

_HELD: dict[Hashable, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a temporary one only where the setting is absent and all runs in one process (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tesserine-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` texts in one Arrow batch, so that what a Python worker and its task hold of long texts stays small; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What the tasks of one operator keep between them in a Python worker; another operator's tasks drop it."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what other operators' tasks have left in this Python worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
