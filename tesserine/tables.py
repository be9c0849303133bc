"""Reading the input tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its path.

    Its schema is read from a footer once for each application and state of the
    path (length and modification time), not by a job for every query; where a store has no times, always.
    """
    path = f"{sf_dir}/{name}.parquet"
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(where)
    changed = status.getModificationTime()
    if not changed:
        return spark.read.parquet(path)
    key = (context.applicationId, path, status.getLen(), changed)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
