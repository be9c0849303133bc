"""A rotating log of records: a ``foreachBatch`` sink, and a reader of the newest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(generation, epoch, folder) of what is written, newest last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(hadoop.Path(f"{path}/generation=*/epoch=*/_SUCCESS")) or ():
        folder = status.getPath().getParent()
        found.append((int(folder.getParent().getName().split("=")[1]), int(folder.getName().split("=")[1]), folder.toString()))
    return sorted(found, key=lambda p: p[1])


def _bytes(spark: SparkSession, folder: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


def log_each_batch(path: str, most_bytes: int = 50_000_000, text: str = "query", most_chars: int = 500):
    """A sink that appends JSON records, texts cut at ``most_chars``; a generation above ``most_bytes`` is closed and the one before it deleted.

    Every epoch is a folder of its own.  An epoch that runs again writes the folder that it wrote before, so no
    record comes twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = _parts(spark, path)
        again = [g for g, e, _ in done if e == epoch]
        generation = again[0] if again else (done[-1][0] if done else 0)
        if not again and _bytes(spark, f"{path}/generation={generation}") > most_bytes:
            generation += 1
        rows = batch.withColumn(text, F.substring(text, 1, most_chars)) if text in batch.columns else batch
        rows.write.mode("overwrite").json(f"{path}/generation={generation}/epoch={epoch}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for old in {g for g, _, _ in done if g < generation - 1}:
            files.delete(hadoop.Path(f"{path}/generation={old}"), True)

    return write


def newest(spark: SparkSession, path: str, n: int, schema: str, by: str = "ts") -> DataFrame:
    """The newest ``n`` records of the current generation, read from the last epochs that are needed and no others."""
    parts = _parts(spark, path)
    parts = [p for p in parts if p[0] == max(g for g, _, _ in parts)] if parts else []
    rows, count = spark.createDataFrame([], schema), 0
    for _, _, folder in reversed(parts):
        own = spark.read.schema(schema).json(folder)
        rows, count = rows.unionByName(own), count + own.count()
        if count >= n:
            break
    return rows.orderBy(F.desc(by)).limit(n)
