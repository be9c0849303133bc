"""The best points of every query by cosine: packed blocks of queries against packed blocks of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vectors in a block of points and of queries; queries in a partition.
POINTS, QUERIES, SHARE = 4096, 512, 4096
_NO_LABEL = np.iinfo(np.int64).min


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """``vec_id, label, vector`` rows packed by vector width; a null vector has width 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().fill_null(0).to_numpy()
            for width in np.unique(lengths):
                at = np.flatnonzero(lengths == width)
                for start in range(0, len(at), size):
                    part = batch.take(pa.array(at[start : start + size]))
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    labels = part.column(1).fill_null(_NO_LABEL).to_numpy(zero_copy_only=False)
                    vectors = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    order = np.argsort(ids, kind="stable")
                    packed = [ids[order].astype(np.int64).tobytes(), labels[order].astype(np.int64).tobytes(), vectors.reshape(len(ids), -1)[order].tobytes()]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in packed), pa.array([int(width)], pa.int32())], names)

    names = [f"{prefix}{n}" for n in ("ids", "labels", "vectors", "width")]
    return rows.mapInArrow(pack, ", ".join(f"{n} {t}" for n, t in zip(names, ("binary", "binary", "binary", "int"), strict=True)))


def cosines(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Rounded cosine of every query (rows) and point (columns), 0 where either has no length."""
    if not points.shape[1] or not queries.shape[1]:
        return np.zeros((len(queries), len(points)))
    sizes = np.sqrt((queries * queries).sum(1))[:, None] * np.sqrt((points * points).sum(1))[None, :]
    with np.errstate(all="ignore"):
        return np.where(sizes > 0, np.round(queries @ points.T / sizes, 6), 0.0) + 0.0


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest scores of each row, the earlier columns of equal ones; ``-inf`` never counts."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above, level = scores > least, scores == least
        room = k - above.sum(1, keepdims=True)
        keep = above | level & (np.cumsum(level, axis=1) <= room)
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & (scores > -np.inf))


def nearest(points: DataFrame, queries: DataFrame, k: int, by_label: bool = False) -> DataFrame:
    """``query_id, vec_id, label, score``: for every query the ``k`` best points (of each label), and perhaps some more.

    ``points`` and ``queries``: ``vec_id, label, vector``.  Each pair of blocks keeps
    its own ``k`` best, so a window over the result gives the exact answer.  A query
    never finds its own id; rows without id count nothing.  Blocks have a fixed size,
    and queries are dealt to partitions by their number, so neither side is collected.
    """
    queries = queries.filter(F.col("vec_id").isNotNull())
    n = queries.count()
    parts = max(-(-n // SHARE), min(-(-n // 64), 16), 1)
    pairs = _blocks(points.filter(F.col("vec_id").isNotNull()), POINTS, "p_").crossJoin(_blocks(queries.repartition(parts, "vec_id"), QUERIES, "q_"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p_ids, p_labels, q_ids = (np.frombuffer(row[c], np.int64) for c in ("p_ids", "p_labels", "q_ids"))
                p, q = (np.frombuffer(row[f"{s}_vectors"]).reshape(len(ids), row[f"{s}_width"]) for s, ids in (("p", p_ids), ("q", q_ids)))
                scores = cosines(p, q)
                ranked = np.where(np.isnan(scores), np.inf, scores)
                ranked[q_ids[:, None] == p_ids[None, :]] = -np.inf
                groups = [np.flatnonzero(p_labels == x) for x in np.unique(p_labels)] if by_label else [np.arange(len(p_ids))]
                for own in groups:
                    i, j = best_columns(ranked[:, own], k)
                    j = own[j]
                    labels = pa.array(p_labels[j], mask=p_labels[j] == _NO_LABEL)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(p_ids[j]), labels, pa.array(scores[i, j])], ["query_id", "vec_id", "label", "score"])

    return pairs.mapInArrow(search, "query_id long, vec_id long, label long, score double")
