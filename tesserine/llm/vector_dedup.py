"""Operator 9: near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components


@dataclass(frozen=True)
class Quantiser:
    """Codes are the signs of ``(unit - mean) @ turn``; tables look up ``chunk`` bits each."""

    mean: np.ndarray
    turn: np.ndarray
    chunk: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    @property
    def tables(self) -> int:
        return self.bits // self.chunk

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One unsigned number of ``chunk`` bits for each vector and table."""
        signs = ((unit - self.mean) @ self.turn) > 0
        weights = 1 << np.arange(self.chunk, dtype=np.int64)
        return signs.reshape(len(unit), self.tables, self.chunk) @ weights


def fit_quantiser(unit: np.ndarray, chunk: int = 16, rounds: int = 50, seed: int = 7) -> Quantiser:
    """ITQ: principal directions, then the rotation for which signs lose least, by alternating codes and Procrustes fits."""
    size = unit.shape[1]
    chunk = min(chunk, max(size, 1))
    bits = max(min(size, 64) // chunk, 1) * chunk  # a whole code fits a long
    mean = unit.mean(0) if len(unit) else np.zeros(size)
    centred = unit - mean
    values, directions = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(size))
    basis = directions[:, np.argsort(-values)[:bits]]
    projected = centred @ basis
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds if len(unit) else 0):
        signs = np.where(projected @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        rotation = left @ right
    return Quantiser(mean, basis @ rotation, chunk)


def fit_quantisers(unit: np.ndarray, chunk: int, least: float, radius: int, missed: float = 0.001, most: int = 16, trials: int = 20_000) -> tuple[list[Quantiser], int, float]:
    """Quantisers with other rotations until few pairs escape all of them; the radius; the share that escapes.

    The share is measured on sample vectors, each paired with a vector at a cosine
    of exactly ``least`` to it: half of these lie in a random direction, half in that
    of a difference of sample vectors; the worse half counts.  The radius grows until
    it drops at most a tenth of ``missed``.  Centring shrinks the vectors but not
    their differences, so a strong common mean calls for more quantisers.
    """
    found = [fit_quantiser(unit, chunk)]
    if len(unit) < 2 or unit.shape[1] < 2:
        return found, max(radius, found[0].bits), 0.0
    rng = np.random.default_rng(11)
    x = unit[rng.integers(len(unit), size=trials)]
    away = rng.standard_normal(x.shape)
    away[::2] = (unit[rng.integers(len(unit), size=trials)] - unit[rng.integers(len(unit), size=trials)])[::2] + 1e-6 * away[::2]
    away -= (away * x).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(max(1 - least * least, 0)) * away / np.linalg.norm(away, axis=1, keepdims=True)
    escaped = np.ones(trials, bool)
    while True:
        apart = np.bitwise_count(found[-1].codes(x) ^ found[-1].codes(y)).astype(np.int64)
        whole = apart.sum(1)
        radius = max(radius, *(int(np.quantile(whole[k::2], 1 - missed / 10, method="higher")) for k in (0, 1)))
        escaped &= ~((apart.min(1) <= 2) & (whole <= radius))
        share = float(max(escaped[::2].mean(), escaped[1::2].mean()))
        if share <= missed or len(found) == most:
            return found, radius, share
        found.append(fit_quantiser(unit, chunk, seed=7 + len(found)))


def _vectors(column: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """Unit vectors of the rows that have one, and their row numbers; null, zero, empty or not finite ones have none."""
    good, rows = [], []
    for i, value in enumerate(column.to_pylist()):
        if value and None not in value:
            v = np.array(value, dtype=np.float64)
            largest = np.abs(v).max()
            if np.isfinite(largest) and largest > 0:
                v = v / largest
                good.append(v / np.sqrt(v @ v))
                rows.append(i)
    return good, rows


def links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, sample_rows: int = 20_000, chunk: int = 16, radius: int = 20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(classes, members, pairs)`` of the linked vectors.

    ``classes`` (``_rep, _label, _vector, _copies``): equal vectors of one label, by
    their smallest id.  ``members`` (``_id, _rep``).  ``pairs`` (``x, y``, x < y):
    classes of one label found with a cosine of at least ``least``, computed in
    double precision.

    The rotation is fitted on at most ``sample_rows`` classes, those with the
    smallest hashes; every class is indexed.  Codes are cut into chunks of
    ``chunk`` bits, a table each, under as many rotations as ``fit_quantisers`` finds
    needed; it may also raise ``radius``.  Both sides of a pair enter a table under their
    own chunk and all chunks one bit away, so chunks up to two bits apart meet;
    pairs whose whole codes differ in more than ``radius`` bits are dropped
    before the original vectors decide.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), F.col(vector_col).cast("array<double>").alias("_vector"))
    sound = F.expr("size(_vector) > 0 and forall(_vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(_vector, v -> v <> 0)")
    usable = rows.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_vector").isNotNull()).filter(sound)
    keyed = usable.withColumn("_vector", F.transform("_vector", lambda v: v + F.lit(0.0))).withColumn("_key", F.sha2(F.concat_ws(",", F.transform("_vector", lambda v: v.cast("string"))), 256))
    classes = cut(keyed.groupBy("_label", "_key").agg(F.min("_id").alias("_rep"), F.countDistinct("_id").alias("_copies"), F.first("_vector").alias("_vector")))
    members = keyed.join(classes.select("_label", "_key", "_rep"), ["_label", "_key"]).select("_id", "_rep").distinct()

    size = classes.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = size[0] if size else 1
    sample = classes.filter(F.size("_vector") == width).orderBy(F.xxhash64("_key"), "_rep").limit(sample_rows).select("_vector").toArrow()
    unit, _ = _vectors(sample.column(0).combine_chunks())
    quantisers, radius, _ = fit_quantisers(np.array(unit).reshape(len(unit), width), chunk, least, radius)
    quantiser = quantisers[0]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.r_[0, 1 << np.arange(quantiser.chunk, dtype=np.int64)]
        for batch in batches:
            unit, rows = _vectors(batch.column(2))
            by_width: dict[int, list[int]] = {}
            for k, v in enumerate(unit):
                by_width.setdefault(len(v), []).append(k)
            for n, ks in by_width.items():
                block, at = np.array([unit[k] for k in ks]), np.array([rows[k] for k in ks])
                for group, own in enumerate(quantisers if n == width else quantisers[:1]):
                    if n == width:
                        codes = own.codes(block)
                    else:  # another width can't be compared with the rotation: one table by width, decided by the vectors
                        codes = np.zeros((len(at), quantiser.tables), np.int64)
                    shifts = np.arange(quantiser.tables, dtype=np.uint64) * np.uint64(quantiser.chunk)
                    whole = pa.array(np.bitwise_or.reduce(codes.astype(np.uint64) << shifts, axis=1).view(np.int64))
                    keys = codes[:, :, None] ^ near[None, None, :] | n << 20
                    take = pa.array(np.repeat(np.arange(len(at)), quantiser.tables * len(near)))
                    table = pa.array(np.tile(np.repeat(np.arange(quantiser.tables, dtype=np.int32), len(near)), len(at)))
                    rep, label = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([rep.take(take), label.take(take), table, pa.array(np.full(len(take), group, np.int32)), pa.array(keys.reshape(-1)), whole.take(take)], ["_rep", "_label", "_table", "_group", "_cell", "_code"])

    cells = classes.select("_rep", "_label", "_vector").mapInArrow(index, "_rep long, _label long, _table int, _group int, _cell long, _code long")
    return classes, members, _rerank(_candidates(cells, quantiser.chunk, radius), classes, least)


def _candidates(cells: DataFrame, chunk: int, radius: int) -> DataFrame:
    """Pairs ``x < y`` that meet in a table, each once.

    Two codes of one rotation may meet in several tables and cells.  The pair counts only in its
    first table with chunks at most two bits apart, there in the cell of ``x``, or,
    at two bits, in the cell that differs from ``x`` in the lower of them.
    """
    one = cells.select("_label", "_table", "_group", "_cell", F.col("_rep").alias("x"), F.col("_code").alias("cx"))
    two = cells.select("_label", "_table", "_group", "_cell", F.col("_rep").alias("y"), F.col("_code").alias("cy"))
    mask = (1 << chunk) - 1
    apart = f"bit_count(shiftrightunsigned(cx ^ cy, {chunk} * {{t}}) & {mask}L)"
    earlier = " and ".join(f"(_table <= {t} or {apart.format(t=t)} > 2)" for t in range(64 // chunk - 1)) or "true"
    part = f"(shiftrightunsigned(cx ^ cy, {chunk} * _table) & {mask}L)"
    own = f"((_cell & {mask}L) ^ (shiftrightunsigned(cx, {chunk} * _table) & {mask}L))"
    place = f"case when bit_count({part}) <= 1 then {own} = 0 else {own} = ({part} & -{part}) end"
    met = one.join(two, ["_label", "_table", "_group", "_cell"])
    return met.filter("x < y").filter(F.expr(f"bit_count(cx ^ cy) <= {radius}")).filter(F.expr(place)).filter(F.expr(earlier)).select("x", "y").distinct()


def _rerank(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose original vectors have a cosine of at least ``least``, in double precision."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            if batch.num_rows:
                sides = [batch.column(i) for i in (2, 3)]
                sizes = [c.value_lengths().to_numpy() for c in sides]
                for n in np.unique(sizes[0][sizes[0] == sizes[1]]):
                    rows = np.flatnonzero((sizes[0] == n) & (sizes[1] == n))
                    x, y = (c.take(pa.array(rows)).flatten().to_numpy().reshape(-1, n) for c in sides)
                    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                    good[rows] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good))

    one, two = classes.select(F.col("_rep").alias("x"), F.col("_vector").alias("vx")), classes.select(F.col("_rep").alias("y"), F.col("_vector").alias("vy"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "vx", "vy").mapInArrow(decide, "x long, y long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, **options) -> DataFrame:
    """Links and components of near-duplicate vectors inside each label.

    Returns one row per input row: ``id_col``, ``n_links`` (other vectors linked
    directly, copies counted one by one), ``component_id`` (the smallest id
    reachable by links) and ``kept`` (whether that is the row's own id).

    Vectors that are null, empty, zero, or hold null, NaN or infinite components,
    and rows with a null label or id, link with nothing and are kept; a null id has
    a null component.  Rows with one id count as one vector.  Equal vectors are
    one class, so copies cost a row each and no pairs.  Other columns are ignored.
    """
    classes, members, pairs = links(vectors, id_col, vector_col, label_col, least, **options)
    pairs = cut(pairs)
    sizes = classes.select("_rep", "_label", "_copies")
    around = (
        pairs.union(pairs.select("y", "x"))
        .join(sizes.select(F.col("_rep").alias("y"), F.col("_copies").alias("_n")), "y")
        .groupBy("x").agg(F.sum("_n").alias("_around"))
    )
    degree = sizes.join(around, F.col("_rep") == F.col("x"), "left").select("_rep", (F.col("_copies") - 1 + F.coalesce("_around", F.lit(0))).alias("_links"))
    joined = components(pairs.union(members.select(F.col("_id").alias("x"), F.col("_rep").alias("y"))), "x", "y")
    of_id = members.join(degree, "_rep").groupBy("_id").agg(F.max("_links").alias("_links"))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"))
    out = rows.join(of_id, "_id", "left").join(joined.withColumnRenamed("node", "_id"), "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    kept = F.coalesce(F.col("_id") == F.col("component"), F.lit(True))
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))
