"""Connected components of undirected links, by alternating large-star and small-star rounds in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: every node points its larger (large) or smaller (small) neighbours, and itself, at its smallest neighbour.

    The smallest neighbour is a partial aggregate and comes back by a join, so the
    links of a hub are never gathered.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _forests(links: DataFrame, blocks: int, most: int) -> DataFrame:
    """The links dealt to at most ``blocks`` tasks; each gives stars with the same components as its own links have, from at most ``most`` nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict[int, int] = {}

        def top(n: int) -> int:
            while (up := lead.setdefault(n, n)) != n:
                lead[n] = n = lead[up]
            return n

        def stars() -> pa.RecordBatch:
            found = [(n, t) for n in list(lead) if (t := top(n)) != n]
            lead.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                lead[max(x, y)] = min(x, y)
            if len(lead) > most:
                yield stars()
        yield stars()

    return links.coalesce(blocks).mapInArrow(run, "a long, b long")


def components(links: DataFrame, a: str, b: str, block: int = 50_000) -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest reachable node.

    ``links`` may hold both directions, repeats and self-links; null ends are ignored.
    First tasks of about ``block`` links each shorten their own links to stars, so
    chains shrink before any round and no more than ``block`` links need none.
    Each round is written to the checkpoint folder; rounds grow with the logarithm
    of the number of links.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x") != F.col("y"))
    stars = cut(pairs.select(F.greatest("x", "y").cast("long").alias("a"), F.least("x", "y").cast("long").alias("b")).distinct())
    blocks = max(1, -(-stars.count() // block))
    stars = cut(_forests(stars, blocks, 2 * block))
    state = _state(stars) if blocks > 1 else None
    while state is not None:
        stars = cut(_star(_star(stars, large=True), large=False))
        now = _state(stars)
        if now == state:
            break
        state = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    """Count and order-free digest of the links: equal states mean that a round changed nothing."""
    code = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(code), F.bit_xor(F.xxhash64(code, F.lit(1)))).first())
