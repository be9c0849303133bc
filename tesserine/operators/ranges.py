"""Running totals and numbers over a global order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def _changes(columns: list[pa.Array], last: tuple | None) -> np.ndarray:
    """Where a row's group differs from that of the row before; ``last`` is the group before the batch."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for column in columns:
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = tuple(c[0].as_py() for c in columns) != last
    return new


def running(rows: DataFrame, group: list[str], order: list[Column], value: str | None, name: str, few: int = 100_000) -> DataFrame:
    """Add ``name``: the sum of ``value`` (rows, where it is None) over the earlier rows of the row's group in ``order``.

    Rows are dealt by ranges of group and order and sorted inside each range, so a
    group that holds most rows is spread over many tasks.  Each task sums up its own
    range; what earlier ranges of the same group hold is added from a table with one
    row for each range and group in it.  ``group`` may be empty: then the order is
    global.  A null group is a group.  Ties of group and order stand in any order,
    so make ``order`` total where that matters.  ``rows`` is read twice (once for the
    ranges' bounds): cut it first if it is dear.  The totals are broadcast while they
    number at most ``few``.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    source = rows.withColumn("_value", F.col(value).cast("long") if value else F.lit(1).cast("long"))
    ranged = source.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = [ranged.columns.index(g) for g in group]
    where = ranged.columns.index("_value")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(where).to_numpy(zero_copy_only=False)
            upto = np.cumsum(values)
            before = upto - values
            if at:
                columns = [batch.column(k) for k in at]
                new = _changes(columns, last)
                last = tuple(c[n - 1].as_py() for c in columns)
                first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                before = np.where(first < 0, before + carried, before - before[np.maximum(first, 0)])
            else:
                before = before + carried
            carried = int(before[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(np.full(n, part), pa.int64())], [*batch.schema.names, "_before", "_range"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = cut(ranged.mapInArrow(sum_up, f"{schema}, _before long, _range long"))
    totals = placed.groupBy("_range", *group).agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(totals.select(F.col("_range").alias("_at"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_shift")))
    same = F.col("_range") == F.col("_at")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    summed = placed.join(F.broadcast(shifts) if shifts.count() <= few else shifts, same)
    return summed.select(*rows.columns, (F.col("_before") + F.col("_shift")).alias(name))
