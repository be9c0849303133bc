"""Deletion along ownership: what nobody owns any more goes too, and only partitions that lose something are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut as checkpoint


def gone_with(roots: DataFrame, owns: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """``node, round``: the deleted ``roots`` (``node``, round 0) and all nodes whose every owner is gone.

    ``owns`` (``owner, owned``) may give a node several owners: it stays while one of
    them does.  Nodes that own each other stay unless they are roots.  Each round
    joins only what went in the round before and adds up how many owners each
    node has lost.
    """
    links = cut(owns.filter(F.col("owner").isNotNull() & F.col("owned").isNotNull() & (F.col("owner") != F.col("owned"))).select("owner", "owned").distinct())
    total = cut(links.groupBy("owned").agg(F.count("*").alias("_owners")))
    front = cut(roots.select("node").filter(F.col("node").isNotNull()).distinct())
    gone, lost, turn = front.withColumn("round", F.lit(0)), None, 0
    while not front.isEmpty():
        turn += 1
        hit = links.join(front.withColumnRenamed("node", "owner"), "owner").groupBy("owned").agg(F.count("*").alias("_lost"))
        lost = cut(hit if lost is None else lost.unionByName(hit).groupBy("owned").agg(F.sum("_lost").alias("_lost")))
        bare = lost.join(total, "owned").filter(F.col("_lost") == F.col("_owners")).select(F.col("owned").alias("node"))
        front = cut(bare.join(gone, "node", "left_anti"))
        gone = gone.unionByName(front.withColumn("round", F.lit(turn)))
    return gone


def delete_rows(path: str, gone: DataFrame, keys: tuple[str, ...], by: str) -> list:
    """Delete the rows of a Parquet table at ``path``, partitioned by ``by``, that name a gone ``node`` in any of ``keys``; returns the partitions written.

    Only partitions with such a row are read whole and written anew, through files of the
    checkpoint folder; the others keep their files.  A partition that loses all
    rows is removed.
    """
    spark = gone.sparkSession
    table = spark.read.parquet(path)
    nodes = checkpoint(gone.select("node").distinct())
    hit = None
    for key in keys:
        own = table.select(F.col(by), F.col(key).alias("node")).join(nodes, "node", "left_semi").select(by)
        hit = own if hit is None else hit.unionByName(own)
    touched = [r[0] for r in hit.distinct().collect()]
    if not touched:
        return []
    rest = table.filter(F.col(by).isin(touched))
    for key in keys:
        rest = rest.join(nodes.withColumnRenamed("node", key), key, "left_anti")
    rest = checkpoint(rest.select(*table.columns))
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    left = {r[0] for r in rest.select(by).distinct().collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in touched:
        if value not in left:
            files.delete(hadoop.Path(f"{path}/{by}={value}"), True)
    return sorted(touched)
