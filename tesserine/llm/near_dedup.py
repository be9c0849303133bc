"""Operator 5: near-duplicate documents by SetSketch registers, banding, a joint likelihood, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import cut, release, small_batches
from .components import components

_SHINGLE_BASE = 0xA0761D6478BD642F
_SHORT = np.uint64(0xE7037ED1A0B428DB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 250_000


@dataclass(frozen=True)
class Sketch:
    """SetSketch parameters: ``m`` registers, base ``b``, rate ``a``, largest value ``q + 1``; ``rows`` registers per band.

    At a similarity of 0.75 a pair shares no band of 4 registers with a chance
    below ``(1 - 0.75**4) ** 40``, about 3e-7.
    """

    m: int = 160
    b: float = 1.001
    a: float = 20.0
    q: int = 65_533
    rows: int = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each row, and their number per row."""
    data = packed.fold_ascii(data)
    starts, ends, counts = packed.words(data, offsets)
    codes = packed.span_hashes(data, starts, ends)
    row, place = packed.within(counts)
    n = len(codes) - width + 1
    if n > 0:
        whole = row[:n] == row[width - 1 :]
        hashes, owner = packed.rolling(codes, width, _SHINGLE_BASE)[whole], row[:n][whole]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    brief = np.flatnonzero((counts > 0) & (counts < width))  # fewer words: the whole sequence is the one shingle
    if len(brief):
        first = np.cumsum(counts) - counts
        extra = []
        for r in brief:
            code = packed.step(int(counts[r]), _SHORT)
            for c in codes[first[r] : first[r] + counts[r]]:
                code = packed.mix64(np.array([code ^ c]))[0]
            extra.append(code)
        hashes, owner = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([owner, brief])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
        hashes, owner = hashes[keep], owner[keep]
    return hashes, np.bincount(owner, minlength=len(offsets) - 1)


def registers(hashes: np.ndarray, counts: np.ndarray, sketch: Sketch) -> np.ndarray:
    """The SetSketch of every row, as a (rows, m) array.

    Each element is a Poisson process of rate ``a * m`` whose points fall on
    registers at random, so the first point on each register is exponential with
    rate ``a``, all independent.  A register keeps the least point over the
    elements, truncated to an exponentially spaced scale.  An element stops once
    its next point lies beyond all its row's registers.
    """
    m = sketch.m
    owner = np.repeat(np.arange(len(counts)), counts)
    least = np.full((len(counts), m), np.inf)
    flat = least.reshape(-1)
    live, at, step = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    while len(live):
        step += 1
        draw = packed.mix64(hashes[live] + packed.step(step, _GOLD))
        at = at - np.log(((draw >> np.uint64(12)) + 0.5) * 2.0**-52) / (sketch.a * m)
        cell = owner[live] * m + (packed.mix64(draw) >> np.uint64(32)).astype(np.int64) * m // 2**32
        np.minimum.at(flat, cell, at)
        if step == 1 or step & 7 == 0 or len(live) > 50_000:
            go = at < least.max(axis=1)[owner[live]]
            live, at = live[go], at[go]
    with np.errstate(divide="ignore"):
        scale = np.floor(1.0 - np.log(least) / np.log(sketch.b))
    return np.where(np.isfinite(least), np.clip(scale, 0, sketch.q + 1), 0).astype(np.uint16)


def merge_registers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(x, y)


def likely_similarity(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, sketch: Sketch, steps: int = 40) -> np.ndarray:
    """Jaccard estimates of row pairs by maximum likelihood over the counts of larger, smaller and equal registers.

    With u = nx / (nx + ny), v = ny / (nx + ny) and p(t) = -log_b(1 - t (b - 1) / b),
    a register of x exceeds that of y with chance p(u - v J), the reverse is
    p(v - u J), and the rest is equal.  The log-likelihood is concave in J, so a
    golden-section search finds its maximum.
    """
    b, m = sketch.b, x.shape[1]
    up, down = (x > y).sum(1), (x < y).sum(1)
    same = m - up - down
    u, v = nx / (nx + ny), ny / (nx + ny)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(t: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(t, 0, 1) * (b - 1) / b) / np.log(b)

    def value(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(np.maximum(more, tiny)) + down * np.log(np.maximum(less, tiny)) + same * np.log(np.maximum(1 - more - less, tiny))

    ratio = (5**0.5 - 1) / 2
    for _ in range(steps):
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        left = value(c) > value(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def reaches(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, sketch: Sketch, least: float) -> np.ndarray:
    """Whether :func:`likely_similarity` of row pairs is at least ``least``.

    The log-likelihood is concave, so its maximum lies there if, and only if, it
    does not fall at ``least``: one slope for each pair instead of a search.
    """
    c = (sketch.b - 1) / sketch.b
    up, down = _ones(x > y), _ones(x < y)
    same = x.shape[1] - up - down
    u, v = nx / (nx + ny), ny / (nx + ny)
    s, t = u - v * least, v - u * least
    inside = (s > 0) & (t > 0)  # else no sets of these sizes are so similar
    s, t = np.where(inside, s, 0.5), np.where(inside, t, 0.5)
    log_b = np.log(sketch.b)
    more, less = -np.log1p(-s * c) / log_b, -np.log1p(-t * c) / log_b
    more_by, less_by = c / (1 - s * c) / log_b, c / (1 - t * c) / log_b
    rise = same * (v * more_by + u * less_by) / np.maximum(1 - more - less, 1e-12)
    return inside & (rise >= up * v * more_by / more + down * u * less_by / less)


def _ones(flags: np.ndarray) -> np.ndarray:
    """The number of true values in each row."""
    return np.bitwise_count(np.packbits(flags, axis=1)).sum(1, dtype=np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, sketch: Sketch) -> DataFrame:
    """``_id, _n, _fa, _fb, _sketch``: set size, an order-free 128-bit digest of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at, to in packed.slices(batch.column(1), _SLICE):
                hashes, counts = shingle_sets(*packed.buffers(batch.column(1).slice(at, to - at)), width)
                sums = []
                for salt in (0x1, 0x5851F42D4C957F2D):
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(packed.mix64(hashes * np.uint64(salt) + _SHORT), out=total[1:])
                    ends = np.cumsum(counts)
                    sums.append((total[ends] - total[ends - counts]).view(np.int64))
                blobs = [r.tobytes() if n else None for r, n in zip(registers(hashes, counts, sketch), counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(counts.astype(np.int64)), *map(pa.array, sums), pa.array(blobs, pa.binary())],
                    ["_id", "_n", "_fa", "_fb", "_sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, _n long, _fa long, _fb long, _sketch binary")


def band_codes(regs: np.ndarray, sketch: Sketch) -> np.ndarray:
    """One hash for each row and band of ``sketch.rows`` registers; the band's number is part of it."""
    groups = sketch.m // sketch.rows
    code = np.tile(np.arange(groups, dtype=np.uint64) * _GOLD, (len(regs), 1))
    for r in range(sketch.rows):
        code = packed.mix64(code ^ regs[:, r :: sketch.rows][:, :groups] + packed.step(r + 1, _SHORT))
    return code.view(np.int64)


def _bands(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """``_rep, _band``: one row for each class and band; the band number is part of the hash."""
    groups = sketch.m // sketch.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.uint64)
            take = pa.array(np.repeat(np.arange(batch.num_rows), groups))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(band_codes(regs, sketch).reshape(-1))], ["_rep", "_band"])

    return classes.select("_rep", "_sketch").mapInArrow(run, "_rep long, _band long")


def _likely(pairs: DataFrame, classes: DataFrame, sketch: Sketch, least: float) -> DataFrame:
    """Pairs ``x, y`` (and their sets' sizes ``nx, ny``) whose estimated similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            nx, ny = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 4, 5)], ["x", "y", "nx", "ny"]).filter(pa.array(reaches(x, y, nx, ny, sketch, least)))

    one = classes.select(F.col("_rep").alias("x"), F.col("_sketch").alias("sx"), F.col("_n").alias("nx"))
    two = classes.select(F.col("_rep").alias("y"), F.col("_sketch").alias("sy"), F.col("_n").alias("ny"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "sx", "sy", "nx", "ny").mapInArrow(run, "x long, y long, nx long, ny long")


def _pairs(band: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, inside: np.ndarray, most: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare, those of different components, about ``most`` at a time.

    Rows come sorted by band, block pair, own block and component, so the partners
    of a row are one range of rows, or two around its own component in the other block.
    """
    n = len(band)
    if not n:
        return
    block = np.cumsum(np.r_[False, (band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    code = np.unique(inside, return_inverse=True)[1]
    many = int(code.max()) + 1
    key = (block * 2 + (own != low)) * many + code
    alone, across = np.flatnonzero(low == high), np.flatnonzero((low != high) & (own == low))
    other = (block[across] * 2 + 1) * many
    rows = np.concatenate([alone, across, across])
    start = np.searchsorted(key, np.concatenate([key[alone] + 1, other, other + code[across] + 1]))
    stop = np.searchsorted(key, np.concatenate([(block[alone] + 1) * 2 * many, other + code[across], other + many]))
    some = stop > start
    rows, start, size = rows[some], start[some], (stop - start)[some]
    if not len(rows):
        return
    before = np.cumsum(size) - size
    heads = np.flatnonzero(np.r_[True, np.diff(before // most) > 0])
    for a, b in zip(heads, [*heads[1:], len(rows)], strict=True):
        place, step = packed.within(size[a:b])
        yield rows[a:b][place], start[a:b][place] + step


def _candidates(table: pa.Table, sketch: Sketch, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a group's rows, and pairs of places in it: likely similar, in different components, here in the first band that they share."""
    names = ("_band", "_lo", "_hi", "_own", "_in", "_n")
    band, low, high, own, inside, size = (table.column(c).to_numpy() for c in names)
    order = np.lexsort((inside, own, high, low, band))
    band, low, high, own, inside, size = (x[order] for x in (band, low, high, own, inside, size))
    regs = np.frombuffer(b"".join(table.column("_sketch").to_pylist()), np.uint16).reshape(len(order), -1)[order]
    found = []
    groups = sketch.m // sketch.rows
    for i, j in _pairs(band, low, high, own, inside):
        even = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])
        i, j = i[even], j[even]
        same = regs[i] == regs[j]
        near = _ones(same) >= sketch.m * (least - 0.02)
        i, j, same = i[near], j[near], same[near]
        if not len(i):
            continue
        good = reaches(regs[i], regs[j], size[i].astype(float), size[j].astype(float), sketch, least)
        i, j, same = i[good], j[good], same[good]
        if len(i):
            first = np.logical_and.reduce([same[:, r :: sketch.rows][:, :groups] for r in range(sketch.rows)]).argmax(1)
            here = band_codes(regs[i].astype(np.uint64), sketch)[np.arange(len(i)), first] == band[i]
            found.append(np.stack([i[here], j[here]]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return order, i, j


class _Sets:
    """Sorted sets of hashes as numbers, to count what one shares with many others."""

    def __init__(self, blobs: list[bytes]):
        self.sizes = np.array([len(b) // 8 for b in blobs], np.int64)
        self.ends = np.cumsum(self.sizes)
        known, numbers = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)
        self.numbers, self.marked = numbers.astype(np.int32), np.zeros(len(known), bool)

    def own(self, k: int) -> np.ndarray:
        return self.numbers[self.ends[k] - self.sizes[k] : self.ends[k]]

    def similar(self, one: int, others: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
        mine = self.own(one)
        self.marked[mine] = True
        both = np.array([np.count_nonzero(self.marked[self.own(k)]) for k in others.tolist()], np.int64)
        self.marked[mine] = False
        return both * similarity[1] >= (len(mine) + self.sizes[others] - both) * similarity[0]


def _across(placed: DataFrame, classes: DataFrame, rows: DataFrame, width: int, similarity: tuple[int, int], sketch: Sketch, least: float, block: int = 1000, block_bytes: int = 4_000_000) -> DataFrame:
    """Links ``x, y`` that join different components, enough of them to connect all that pairs sharing a band can.

    ``placed`` has ``_band, _rep, _in``.  A bucket with several components is dealt
    out as pairs of blocks, each of about ``block`` classes and ``block_bytes`` of
    sets; block pairs are packed into groups of even size.  First the registers of
    a group's block pairs are compared, and only classes with a likely partner in
    another component go on, one row for each block pair.  Then their full sets
    meet in the same blocks and decide every likely pair whose classes are not yet
    connected.  So pairs are compared inside tasks, never listed.
    """
    held = placed.join(classes.select("_rep", "_n"), "_rep")
    split = (
        held.groupBy("_band").agg(F.min("_in").alias("_a"), F.max("_in").alias("_b"), F.count("*").alias("_size"), F.sum("_n").alias("_total")).filter("_a <> _b")
        .select("_band", F.ceil(F.greatest(F.col("_size") / block, F.col("_total") * 8 / block_bytes)).cast("int").alias("_blocks"))
    )
    dealt = cut(
        held.join(split, "_band")
        .withColumn("_own", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
        .select("_band", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "_own", "_rep", "_in", "_n")
    )

    def packed_groups(members: DataFrame, most_rows: int) -> DataFrame:
        n, total = members.agg(F.count("*"), F.sum("_n")).first()
        groups = max(256, n // most_rows, (total or 0) * 8 // block_bytes)
        return members.withColumn("_group", F.pmod(F.xxhash64("_band", "_lo", "_hi"), F.lit(groups)))

    def likely(table: pa.Table) -> pa.Table:
        order, i, j = _candidates(table, sketch, least)
        go = order[np.unique(np.concatenate([i, j]))]
        return table.select(["_band", "_lo", "_hi", "_own", "_rep", "_in", "_n"]).take(pa.array(go))

    def decide(table: pa.Table) -> pa.Table:
        order, i, j = _candidates(table, sketch, least)
        blobs = table.column("_set").to_pylist()
        sets = _Sets([blobs[k] for k in order])
        rep, inside = table.column("_rep").to_numpy()[order], table.column("_in").to_numpy()[order].tolist()
        lead = {c: c for c in inside}

        def top(c: int) -> int:
            while lead[c] != c:
                lead[c] = c = lead[lead[c]]
            return c

        out: list[tuple[int, int]] = []
        by_first = np.argsort(i, kind="stable")
        i, j = i[by_first], j[by_first]
        heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for a, b in zip(heads, [*heads[1:], len(i)], strict=True) if len(i) else []:
            x = int(i[a])
            mine = top(inside[x])
            open_ = np.array([y for y in j[a:b].tolist() if top(inside[y]) != mine], np.int64)
            if len(open_):
                for y in open_[sets.similar(x, open_, similarity)].tolist():
                    if top(inside[y]) != top(inside[x]):
                        lead[top(inside[y])] = top(inside[x])
                        out.append((int(rep[x]), int(rep[y])))
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"x": x, "y": y})

    names = "_band long, _lo int, _hi int, _own int, _rep long, _in long, _n long"
    seen = packed_groups(dealt, 20_000).join(classes.select("_rep", "_sketch"), "_rep")
    chosen = cut(seen.groupBy("_group").applyInArrow(likely, names))
    full = packed_groups(chosen, 20_000).join(classes.select("_rep", "_sketch"), "_rep").join(_sets(rows, chosen.select("_rep"), width), "_rep")
    return full.groupBy("_group").applyInArrow(decide, "x long, y long")


def _sets(rows: DataFrame, needed: DataFrame, width: int, broadcast_ids: int = 4_000_000) -> DataFrame:
    """``_rep, _set``: the sorted shingle hashes of the rows whose id is in ``needed``.

    Up to ``broadcast_ids`` ids go to the texts' scan, so texts are not shuffled;
    more are joined by a shuffle.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in packed.slices(batch.column(1), _SLICE):
                hashes, counts = shingle_sets(*packed.buffers(batch.column(1).slice(at, to - at)), width)
                ends = np.cumsum(counts)
                blobs = [hashes[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(blobs, pa.binary())], ["_rep", "_set"])

    ids = cut(needed.distinct())
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return rows.join(ids, "_rep").select("_rep", "_text").mapInArrow(sets, "_rep long, _set binary").filter(F.octet_length("_set") > 0)


def _verified(pairs: DataFrame, rows: DataFrame, width: int, similarity: tuple[int, int], block: int = 500, block_bytes: int = 4_000_000) -> DataFrame:
    """Pairs of a class ``x`` and its centre ``y`` whose full shingle sets have intersection * ``similarity[1]`` >= union * ``similarity[0]``.

    The classes of a centre are dealt into blocks of about ``block`` classes and
    ``block_bytes`` of sets; each block gets the centre's set once.
    """

    def compare(table: pa.Table) -> pa.Table:
        rep, centre = table.column("_rep").to_numpy(), table.column("_centre").to_numpy()
        block = table.column("_block").to_numpy()
        order = np.lexsort((rep != centre, block, centre))
        blobs = table.column("_set").to_pylist()
        sets = _Sets([blobs[k] for k in order])
        rep, centre, block = rep[order], centre[order], block[order]
        heads = np.flatnonzero(np.r_[True, (centre[1:] != centre[:-1]) | (block[1:] != block[:-1])])
        found = []
        for a, b in zip(heads, [*heads[1:], len(rep)], strict=True):
            leads = a + int((rep[a:b] == centre[a]).sum())  # texts of one id are all its own
            for k in range(a, leads):
                others = np.arange(leads, b)
                if len(others):
                    found.append(others[sets.similar(k, others, similarity)])
        good = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.table({"x": rep[good], "y": centre[good]})

    pairs = cut(pairs)
    blocks = pairs.groupBy("y").agg(F.max("ny").alias("ny"), F.ceil(F.greatest(F.count("*") / block, F.sum("nx") * 8 / block_bytes)).cast("int").alias("_blocks"))
    members = pairs.join(blocks.select("y", "_blocks"), "y").select(F.col("y").alias("_centre"), F.pmod(F.xxhash64("x"), F.col("_blocks")).cast("int").alias("_block"), F.col("x").alias("_rep"), F.col("nx").alias("_n"))
    centres = blocks.select(F.col("y").alias("_centre"), F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_block"), F.col("y").alias("_rep"), F.col("ny").alias("_n"))
    both = cut(members.union(centres))
    n, total = both.agg(F.count("*"), F.sum("_n")).first()
    groups = max(256, n // 2_000, (total or 0) * 8 // block_bytes)
    full = both.join(_sets(rows, both.select("_rep"), width), "_rep").withColumn("_group", F.pmod(F.xxhash64("_centre", "_block"), F.lit(groups)))
    return full.groupBy("_group").applyInArrow(compare, "x long, y long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (75, 100), sketch: Sketch | None = None, margin: float = 0.15
) -> DataFrame:
    """Components of documents whose sets of ``width``-word shingles are similar enough.

    Returns one row per input row: ``id_col``, ``n_shingles``, ``component_id`` (the
    smallest id reachable by links) and ``kept`` (whether that is the row's own id).
    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.

    Rows without words, or with a null text, have no shingles and link with
    nothing.  Rows with a null id link with nothing, have a null component and are
    kept.  Rows with one id are one node; each of their texts can link it.  Other
    columns are ignored.

    1. Rows with the same set form a class (a digest of 128 bits, partially
       aggregated), so copies cost one row each whatever their number.
    2. Bands of registers give buckets.  In each, all classes are paired with one
       centre, the class that shares most buckets overall.  Pairs that the
       likelihood puts no more than ``margin`` below the threshold (over 4 standard
       errors) are verified on full sets, and components are built.
    3. A bucket whose classes now lie in one component has nothing to add.  In the
       others every pair across components is compared as well, block by block,
       and verified if likely, so no link between components is lost.
    """
    small_batches(docs.sparkSession)
    sketch = sketch or Sketch()
    least = similarity[0] / similarity[1] - margin
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sketched = cut(_sketches(docs, id_col, text_col, width, sketch))
    known = sketched.filter(F.col("_id").isNotNull() & (F.col("_n") > 0))
    classes = cut(known.groupBy("_fa", "_fb").agg(F.min("_id").alias("_rep"), F.first("_n").alias("_n"), F.first("_sketch").alias("_sketch")))
    member = known.join(classes.select("_fa", "_fb", "_rep"), ["_fa", "_fb"]).select("_id", "_rep")
    text_of = rows.filter(F.col("_id").isNotNull()).withColumnRenamed("_id", "_rep")

    banded = _bands(classes, sketch)
    sizes = banded.groupBy("_band").agg(F.count("*").alias("_size")).filter(F.col("_size") > 1)
    crowded = cut(banded.join(sizes, "_band"))
    weight = crowded.groupBy("_rep").agg(F.sum("_size").alias("_w"))
    centre = crowded.join(weight, "_rep").groupBy("_band").agg(F.min(F.struct(-F.col("_w"), F.col("_rep"))).alias("_c"))
    stars = crowded.join(centre, "_band").select(F.col("_rep").alias("x"), F.col("_c._rep").alias("y")).filter(F.col("x") != F.col("y")).distinct()
    links = cut(_verified(_likely(stars, classes, sketch, least), text_of, width, similarity))
    first = components(links.union(member.select(F.col("_id").alias("x"), F.col("_rep").alias("y"))), "x", "y")

    placed = crowded.join(first.withColumnRenamed("node", "_rep"), "_rep", "left").select("_band", "_rep", F.coalesce("component", "_rep").alias("_in"))
    extra = cut(_across(placed, classes, text_of, width, similarity, sketch, least))
    if not extra.isEmpty():
        first = components(first.select(F.col("node").alias("x"), F.col("component").alias("y")).union(extra), "x", "y")

    out = sketched.join(first.withColumnRenamed("node", "_id"), "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    kept = F.coalesce(F.col("_id") == F.col("component"), F.lit(True))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
