"""Which windows of a corpus also start earlier: packed hash lists, dealt out by hash bucket.

A window is known by its document key ``(doc, twin)``, its position and two
independent hashes: one of 64 bits that is compared, and one that picks its
bucket.  Map tasks send, per bucket, one packed list; a hash that occurs more
than once in a map task is sent once, with its earliest place, and the later
places go along as already decided.  So a window that a third of all documents
share costs a bucket one entry per map task, and no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches
from .packed import mix64

LAST_ID = 2**63 - 1
_PACKED = "bucket int, hashes binary, docs binary, twins binary, sizes binary, places binary, late_docs binary, late_twins binary, late_sizes binary, late_places binary"
_LATE = "_part int, docs binary, twins binary, sizes binary, places binary"


def pack(values: np.ndarray) -> bytes:
    """Byte planes of the differences of integers, compressed: sorted or repeating ones shrink to little."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel())


def _runs(doc: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """Starts of runs of equal document keys."""
    if not len(doc):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])


def _pack_places(doc: np.ndarray, twin: np.ndarray, place: np.ndarray) -> list[bytes]:
    at = _runs(doc, twin)
    return [pack(doc[at]), pack(twin[at]), pack(np.diff(at, append=len(doc))), pack(place)]


def _unpack_places(docs: bytes, twins: bytes, sizes: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = unpack(sizes)
    return np.repeat(unpack(docs), n), np.repeat(unpack(twins), n), unpack(places)


def _split(code: np.ndarray, doc: np.ndarray, twin: np.ndarray, place: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the earliest place of each hash, and places that come after it.

    ``across``: only places in documents after the earliest one's count as later.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    first, later = np.ones(n, bool), np.zeros(n, bool)
    if same.any():
        many = np.r_[False, same] | np.r_[same, False]
        rows = order[many]
        rows = rows[np.lexsort((place[rows], twin[rows], doc[rows], code[rows]))]
        head = np.r_[True, code[rows][1:] != code[rows][:-1]]
        lead = rows[np.flatnonzero(head)][np.cumsum(head) - 1]
        twin_of = (doc[rows] == doc[lead]) & (twin[rows] == twin[lead])
        first[rows] = head
        if across:
            later[rows] = ~twin_of
        else:
            later[rows] = ~head & ~(twin_of & (place[rows] == place[lead]))  # a repeated row is no earlier place
    return first, later


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``_id, _text, _doc, _twin`` and the carried columns as ``_0, _1, ...``: ``_doc`` orders the documents, a null id last.

    ``_twin`` tells rows with one id but other texts apart.  It is 0 throughout
    where ids are unique, and then costs nothing in the packed lists.
    """
    small_batches(docs.sparkSession)
    extra = [F.col(c).alias(f"_{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_doc"), *extra)
    unique = rows.groupBy("_doc").count().filter("count > 1").isEmpty()
    return rows.withColumn("_twin", F.lit(0).cast("long") if unique else F.xxhash64("_text"))


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """Any even spread of documents over parts; the same in map tasks and for the texts."""
    return (mix64(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def pack_by_part(doc: np.ndarray, twin: np.ndarray, place: np.ndarray, parts: int) -> pa.Table:
    """Positions as packed lists, one row for each part of the documents."""
    part = part_of(doc, parts)
    order = np.lexsort((place, twin, doc, part))
    return _pack_parts(doc[order], twin[order], place[order], part[order])


def pack_runs_by_part(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, count: np.ndarray, parts: int) -> pa.Table:
    """The same from runs of consecutive positions that do not overlap: runs are sorted, then spelt out."""
    part = part_of(doc, parts)
    order = np.lexsort((start, twin, doc, part))
    return _pack_parts(*spelt(doc[order], twin[order], start[order], count[order]), np.repeat(part[order], count[order]))


def spelt(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs as single positions."""
    first = np.cumsum(count) - count
    return np.repeat(doc, count), np.repeat(twin, count), np.repeat(start - first, count) + np.arange(int(count.sum()))


def as_runs(doc: np.ndarray, twin: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, in order inside each document, as runs."""
    if not len(doc):
        return doc, twin, place, place
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (place[1:] != place[:-1] + 1)])
    return doc[head], twin[head], place[head], np.diff(head, append=len(doc))


def _pack_parts(doc: np.ndarray, twin: np.ndarray, place: np.ndarray, part: np.ndarray) -> pa.Table:
    bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    out = [_pack_places(doc[x], twin[x], place[x]) for x in map(slice, bounds, [*bounds[1:], len(part)])]
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table([pa.array(part[bounds]), *(pa.array(list(c), pa.binary()) for c in columns)], [x.split()[0] for x in _LATE.split(", ")])


def late_windows(docs: DataFrame, windows: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], buckets: int, parts: int, across: bool = False, hold: int = 600_000) -> DataFrame:
    """Windows whose content also starts earlier, as packed lists of document keys and positions, a few for each of ``parts`` groups of documents.

    ``windows`` turns a batch (``_text, _doc, _twin``) into arrays ``(compared hash,
    bucket hash, doc, twin, place)``.  A map task holds about ``hold`` windows
    before it sends them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))  # ids in order pack well
            for arrays in windows(batch):
                held.append(arrays)
                n += len(arrays[0])
                if n >= hold:
                    yield from deal(held)
                    held, n = [], 0
        if n:
            yield from deal(held)

    def deal(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        code, spread, doc, twin, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        first, later = _split(code, doc, twin, place, across)
        bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out: list[list] = [[] for _ in range(10)]
        for b in np.flatnonzero(np.diff(bounds)):
            rows = order[bounds[b] : bounds[b + 1]]
            go, late = rows[first[rows]], rows[later[rows]]
            cells = [int(b), code[go].tobytes(), *_pack_places(doc[go], twin[go], place[go]), *_pack_places(doc[late], twin[late], place[late])]
            for column, cell in zip(out, cells, strict=True):
                column.append(cell)
        kinds = [pa.int32(), *[pa.binary()] * 9]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in _PACKED.split(", ")])

    def decide(packed: pa.Table) -> pa.Table:
        columns = {name: packed.column(name).to_pylist() for name in packed.column_names}
        sent = [_unpack_places(*x) for x in zip(*(columns[k] for k in ("docs", "twins", "sizes", "places")), strict=True)]
        known = [_unpack_places(*x) for x in zip(*(columns[k] for k in ("late_docs", "late_twins", "late_sizes", "late_places")), strict=True)]
        code = np.concatenate([np.frombuffer(x, np.uint64) for x in columns["hashes"]])
        doc, twin, place = (np.concatenate(x) for x in zip(*sent, strict=True))
        _, later = _split(code, doc, twin, place, across)
        doc, twin, place = (np.concatenate([x[later], *(k[i] for k in known)]) for i, x in enumerate((doc, twin, place)))
        return pack_by_part(doc, twin, place, parts)

    return docs.mapInArrow(send, _PACKED).groupBy("bucket").applyInArrow(decide, _LATE)


def with_late(docs: DataFrame, late: DataFrame, parts: int, finish: Callable[[pa.Table, Callable], pa.Table], schema: str) -> DataFrame:
    """Bring texts and late windows together, part by part.

    ``finish`` gets the rows of a part (``_id, _text, _doc, _twin``) and a function
    from a document key to the positions of its late windows.
    """

    def meet(texts: pa.Table, lists: pa.Table) -> pa.Table:
        found = [_unpack_places(*x) for x in zip(*(lists.column(k).to_pylist() for k in ("docs", "twins", "sizes", "places")), strict=True)]
        none = np.zeros(0, np.int64)
        if not found:
            return finish(texts, lambda doc, twin: none)
        doc, twin, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, twin, doc))
        doc, twin, place = doc[order], twin[order], place[order]
        at = _runs(doc, twin)
        of = {key: (a, b) for key, a, b in zip(zip(doc[at].tolist(), twin[at].tolist(), strict=True), at.tolist(), [*at[1:].tolist(), len(doc)], strict=True)}
        return finish(texts, lambda doc, twin: place[slice(*of[doc, twin])] if (doc, twin) in of else none)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_part", pa.array(part_of(batch.column("_doc").to_numpy(), parts)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    placed = docs.mapInArrow(deal, f"{kinds}, _part int")
    return placed.groupBy("_part").cogroup(late.groupBy("_part")).applyInArrow(meet, schema)


def corpus_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
