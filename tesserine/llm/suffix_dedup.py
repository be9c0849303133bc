"""Operator 8: exact byte-level deduplication by suffix sorting of content-defined shards.

A string of ``width`` bytes can only recur where its least ``GRAM``-byte hash
recurs.  Runs of windows with the same least hash are therefore counted first;
runs whose hash occurs in several documents are cut out with all their bytes and
dealt to shards by that hash, so equal windows always meet in one shard.  Each
shard is suffix-sorted by induction (:mod:`induced_sort`), and equal windows take
the smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import cut, release
from .induced_sort import BORDER, END, SHIFT, equal_windows
from .repeats import _LATE, _pack_places, _unpack_places, as_runs, corpus_bytes, keyed, pack, pack_by_part, pack_runs_by_part, spelt, unpack, with_late

GRAM = 25
_BASE = 0xC2B2AE3D27D4EB4F
_SLICE = 250_000
_SEND = "bucket int, codes binary, more binary, docs binary, twins binary, sizes binary, places binary, known_docs binary, known_twins binary, known_sizes binary, known_places binary"
_SEGMENTS = "shard int, content binary, widths binary, docs binary, twins binary, times binary, lows binary, late_docs binary, late_twins binary, late_sizes binary, late_places binary"


def least_hash_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a row with the same least gram hash: hash, row, first window, number of windows."""
    none = np.zeros(0, np.int64)
    n = len(data) - width + 1
    if n <= 0:
        return none.view(np.uint64), none, none, none
    low = packed.rolling(packed.byte_codes(data), GRAM, _BASE)
    reach, span = 1, width - GRAM + 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: n], low[span - reach :][: n])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:n] == row[width - 1 :]
    head = whole.copy()
    head[1:] &= (low[1:] != low[:-1]) | (row[1:n] != row[: n - 1]) | ~whole[:-1]
    starts = np.flatnonzero(head)
    stop = np.flatnonzero(whole & np.r_[head[1:] | ~whole[1:], True]) + 1
    return low[starts], row[starts], starts - offsets[row[starts]], stop - starts


def _shared(code: np.ndarray, doc: np.ndarray, twin: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over occurrences: in the smallest document of its hash; hash in several documents; and, at the first of each hash, occurrences elsewhere and all of them.

    ``more``: further occurrences in other documents, known already.
    """
    order = np.lexsort((twin, doc, code))
    c, d, t = code[order], doc[order], twin[order]
    head = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    size = np.diff(np.r_[at, len(c)])
    lead = np.repeat(at, size)
    inside = (d == d[lead]) & (t == t[lead])
    first, wide = np.zeros(len(c), bool), np.zeros(len(c), bool)
    others, every = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    if len(c):
        apart = np.add.reduceat((~inside).astype(np.int64) + more[order], at)
        first[order], wide[order] = inside, np.repeat(apart > 0, size)
        others[order[at]], every[order[at]] = apart, np.add.reduceat(1 + more[order], at)
    return first, wide, others, every


def _deal_code(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash, and its key: the bucket and 40 further bits."""
    code = packed.mix64(code)
    bucket = ((code >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
    return bucket, code & np.uint64(2**40 - 1) | bucket.astype(np.uint64) << np.uint64(40)


def _shared_runs(docs: DataFrame, width: int, buckets: int, parts: int, hold: int, hot_runs: int) -> DataFrame:
    """Runs whose hash occurs in several documents, packed by part; keys of 40 bits and a bucket, a false one only costs work later.

    Keys with at least ``hot_runs`` runs come as the places of rows with part -1.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, n = [], 0
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))
            for at, to in packed.slices(batch.column(0), _SLICE):
                code, row, place, _ = least_hash_runs(*packed.buffers(batch.column(0).slice(at, to - at)), width)
                doc, twin = (batch.column(k).slice(at, to - at).to_numpy()[row] for k in (1, 2))
                held.append((code, doc, twin, place))
                n += len(code)
                if n >= hold:
                    yield deal(held)
                    held, n = [], 0
        if n:
            yield deal(held)

    def deal(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        code, doc, twin, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket, code = _deal_code(code, buckets)
        first, _, others, _ = _shared(code, doc, twin, np.zeros(len(code), np.int64))
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out: list[list] = [[] for _ in _SEND.split(", ")]
        for b in np.flatnonzero(np.diff(bounds)):
            rows = order[bounds[b] : bounds[b + 1]]
            go, known = rows[first[rows]], rows[~first[rows]]
            brief = np.ascontiguousarray(code[go].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            cells = [int(b), brief, pack(others[go]), *_pack_places(doc[go], twin[go], place[go]), *_pack_places(doc[known], twin[known], place[known])]
            for column, cell in zip(out, cells, strict=True):
                column.append(cell)
        names = [x.split()[0] for x in _SEND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(out)], names)

    def decide(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in table.column_names}
        sent = [_unpack_places(*x) for x in zip(*(columns[k] for k in ("docs", "twins", "sizes", "places")), strict=True)]
        known = [_unpack_places(*x) for x in zip(*(columns[k] for k in ("known_docs", "known_twins", "known_sizes", "known_places")), strict=True)]
        codes = []
        for blob in columns["codes"]:
            wide = np.zeros((len(blob) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
            codes.append(wide.view(np.uint64).ravel())
        doc, twin, place = (np.concatenate(x) for x in zip(*sent, strict=True))
        code = np.concatenate(codes)
        _, wide, _, every = _shared(code, doc, twin, np.concatenate([unpack(b) for b in columns["more"]]))
        hot = np.sort(code[every >= hot_runs].view(np.int64) | columns["bucket"][0] << 40)
        doc, twin, place = (np.concatenate([x[wide], *(k[i] for k in known)]) for i, x in enumerate((doc, twin, place)))
        runs = pack_by_part(doc, twin, place, parts)
        if not len(hot):
            return runs
        none = np.zeros(len(hot), np.int64)
        return pa.concat_tables([runs, pa.table([pa.array([-1], pa.int32()), *(pa.array([x], pa.binary()) for x in _pack_places(none, none, hot))], runs.schema.names)])

    return docs.mapInArrow(send, _SEND).groupBy("bucket").applyInArrow(decide, _LATE)


class _Pieces:
    """Equal pieces once, with their smallest document and its places; what is larger loses all its windows at once."""

    def __init__(self, width: int):
        self.width = width
        self.owner: dict[bytes, tuple[tuple[int, int], list[int]]] = {}
        self.late: list[tuple[int, int, int, int]] = []

    def add(self, piece: bytes, key: tuple[int, int], lows: list[int]) -> None:
        held = self.owner.get(piece)
        if held is None:
            self.owner[piece] = (key, lows)
        elif held[0] == key:
            held[1].extend(lows)
        else:
            less, more = sorted([held, (key, lows)])
            self.owner[piece] = less
            self.lose(*more, 0, len(piece) - self.width + 1)

    def lose(self, key: tuple[int, int], lows: list[int], start: int, stop: int) -> None:
        for lo in lows:
            self.late.append((*key, lo + start, stop - start))

    def decided(self) -> np.ndarray:
        """Lost windows as runs: document, twin, first window, number of windows."""
        return np.array(self.late, np.int64).reshape(-1, 4).T

    def cells(self) -> list[bytes]:
        owners, lows = [k for k, _ in self.owner.values()], [lo for _, lo in self.owner.values()]
        content = zstandard.ZstdCompressor(level=1).compress(b"".join(self.owner))
        numbers = (list(map(len, self.owner)), [d for d, _ in owners], [t for _, t in owners], list(map(len, lows)), [x for lo in lows for x in lo])
        runs = self.decided()
        return [content, *(pack(np.array(x, np.int64)) for x in numbers), *_pack_places(*spelt(*runs[:, np.lexsort((runs[2], runs[1], runs[0]))]))]


def _segments(texts: pa.Table, late_of, width: int, shards: int, buckets: int, hot: np.ndarray) -> pa.Table:
    """The bytes of a part's shared runs, by shard; runs with a hot hash go window by window, dealt by the whole window's hash."""
    by_shard: dict[int, _Pieces] = {}
    rows = sorted(zip(texts.column("_doc").to_pylist(), texts.column("_twin").to_pylist(), texts.column("_text").to_pylist(), strict=True), key=lambda r: r[:2])

    def deal(held: list[tuple[tuple[int, int], bytes, np.ndarray]]) -> None:
        data = b"".join(raw for _, raw, _ in held)
        offsets = np.cumsum([0, *(len(raw) for _, raw, _ in held)])
        flat = np.frombuffer(data, np.uint8)
        code, row, place, count = least_hash_runs(flat, offsets, width)
        at = offsets[row] + place
        wanted = np.concatenate([offsets[k] + starts for k, (_, _, starts) in enumerate(held)])
        own = np.flatnonzero(np.isin(at, wanted))
        code, row, place, count, at = code[own], row[own], place[own], count[own], at[own]
        shard = packed.mix64(packed.mix64(code) + np.uint64(1)) % np.uint64(shards)
        crowded = np.isin(_deal_code(code, buckets)[1].view(np.int64), hot) if len(hot) else np.zeros(len(code), bool)
        for s, k, lo, n, start in zip(*(x[~crowded].tolist() for x in (shard, row, place, count, at)), strict=True):
            pieces = by_shard.get(s) or by_shard.setdefault(s, _Pieces(width))
            pieces.add(data[start : start + n + width - 1], held[k][0], [lo])
        if crowded.any():
            shard = packed.rolling(packed.byte_codes(flat), width, _BASE) % np.uint64(shards)
            for k, lo, n, start in zip(*(x[crowded].tolist() for x in (row, place, count, at)), strict=True):
                for j in range(n):
                    by_shard.setdefault(int(shard[start + j]), _Pieces(width)).add(data[start + j : start + j + width], held[k][0], [lo + j])

    held, size, done = [], 0, None
    for doc, twin, text in rows:
        starts = late_of(doc, twin)
        if not len(starts) or (doc, twin) == done:
            continue
        done = doc, twin
        held.append((done, (text or "").encode(), starts))
        size += len(held[-1][1])
        if size >= _SLICE:
            deal(held)
            held, size = [], 0
    if held:
        deal(held)
    columns = list(zip(*([s, *p.cells()] for s, p in by_shard.items()), strict=True)) or [()] * 11
    return pa.table([pa.array(list(c), pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], [x.split()[0] for x in _SEGMENTS.split(", ")])


def _sort_shard(table: pa.Table, width: int, parts: int, memory_items: int) -> pa.Table:
    """Windows of the shard that also start in a smaller document."""
    pieces, known = _Pieces(width), []
    columns = {name: table.column(name).to_pylist() for name in table.column_names}
    for content, *numbers in zip(*(columns[k] for k in ("content", "widths", "docs", "twins", "times", "lows")), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(content)
        widths, docs, twins, times, lows = (unpack(x).tolist() for x in numbers)
        at = low = 0
        for n, doc, twin, k in zip(widths, docs, twins, times, strict=True):
            pieces.add(raw[at : at + n], (doc, twin), lows[low : low + k])
            at, low = at + n, low + k
    known = [_unpack_places(*x) for x in zip(*(columns[k] for k in ("late_docs", "late_twins", "late_sizes", "late_places")), strict=True)]

    own = list(pieces.owner.values())
    sizes = np.array(list(map(len, pieces.owner)), np.int64)
    bodies = np.frombuffer(bytes([BORDER - SHIFT & 0xFF]).join([b"", *pieces.owner, b""]), np.uint8) + np.uint8(SHIFT)
    text = np.r_[bodies, np.uint8(END)]
    begin = np.cumsum(sizes + 1) - sizes
    _, rank = np.unique(np.array([k for k, _ in own], np.int64).reshape(-1, 2), axis=0, return_inverse=True)
    rank = rank.ravel()
    late_at: list[np.ndarray] = []
    starts = np.repeat(begin, sizes - width + 1)
    starts += np.arange(len(starts)) - np.repeat(np.cumsum(sizes - width + 1) - (sizes - width + 1), sizes - width + 1)
    for place, equal in equal_windows(text, width, memory_items, starts) if own else []:
        group = np.cumsum(~equal)
        many = equal.copy()
        many[:-1] |= equal[1:]
        place, group = place[many].astype(np.int64), group[many]
        piece = np.searchsorted(begin, place, side="right") - 1
        fits = (piece >= 0) & (place + width <= begin[piece] + sizes[piece])
        place, group, piece = place[fits], group[fits], piece[fits]
        if len(place):
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            least = np.repeat(np.minimum.reduceat(rank[piece], at), np.diff(np.r_[at, len(place)]))
            late_at.append(place[least < rank[piece]])
    late = np.sort(np.concatenate(late_at)) if late_at else np.zeros(0, np.int64)
    edges = np.flatnonzero(np.r_[True, np.diff(late) != 1]) if len(late) else []
    for a, b in zip(edges, [*edges[1:], len(late)], strict=True) if len(late) else []:
        k = int(np.searchsorted(begin, late[a], side="right")) - 1
        start = int(late[a] - begin[k])
        pieces.lose(*own[k], start, start + int(b - a))
    earlier = [as_runs(*k) for k in known]
    return pack_runs_by_part(*(np.concatenate([x, *(k[i] for k in earlier)]) for i, x in enumerate(pieces.decided())), parts)


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, runs_per_bucket: int = 2_000_000, part_bytes: int = 8_000_000,
    corpus_bytes_per_shard: int = 8_000_000, hold: int = 1_000_000, memory_items: int = 8_000_000, hot_runs: int = 500_000,
) -> DataFrame:
    """Remove every byte covered by ``width`` bytes that also start in a document with a smaller id.

    Texts are UTF-8 bytes.  Matches stay inside documents, may overlap, and are
    judged on the input.  Returns ``id_col``, ``n_bytes``, ``n_removed``, ``spans``
    (maximal removed runs, end excluded) and ``kept`` (binary: the other bytes).

    Null and short texts lose nothing.  Rows with a null id come last.  Rows with
    one id and one text are one document given several times; rows with one id and
    other texts are ordered among themselves by a hash.  Other columns are ignored.

    Buckets, shards and parts follow the size of the corpus, so tasks keep their
    size.  A run that a third of all documents share reaches its shard once for
    each part.  Runs with a hash that occurs ``hot_runs`` times (more in corpora so
    large that over a million hashes could) need not be equal, so their windows are
    dealt one by one, by a hash of the whole window: equal ones still meet, and no
    shard has them all.  A shard's queues spill to the task's own temporary files.
    """
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    rows = keyed(docs, id_col, text_col)
    size = corpus_bytes(rows, "_text")
    buckets, parts, shards = (max(8, size // x) for x in (13 * runs_per_bucket, part_bytes, corpus_bytes_per_shard))
    hot_runs = max(hot_runs, size // 1_000_000)  # at most a million hot hashes, 8 MB
    runs = cut(_shared_runs(rows.select("_text", "_doc", "_twin"), width, buckets, parts, hold, hot_runs))
    hot = np.concatenate([np.zeros(0, np.int64), *(unpack(r["places"]) for r in runs.filter("_part = -1").select("places").toLocalIterator())])
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(hot))
    pieces = with_late(rows, runs.filter("_part >= 0"), parts, lambda texts, late_of: _segments(texts, late_of, width, shards, buckets, hot.value), _SEGMENTS)
    late = pieces.groupBy("shard").applyInArrow(lambda t: _sort_shard(t, width, parts, memory_items), _LATE)

    def remove(texts: pa.Table, late_of) -> pa.Table:
        n_bytes, n_removed, spans, kept = [], [], [], []
        for text, doc, twin in zip(*(texts.column(c).to_pylist() for c in ("_text", "_doc", "_twin")), strict=True):
            raw = (text or "").encode()
            starts = late_of(doc, twin)
            runs = np.zeros((0, 2), np.int64)
            if len(starts):
                edges = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + width, -1)
                stay = np.cumsum(edges)[:-1] == 0
                runs = np.flatnonzero(np.diff(np.r_[True, stay, True])).reshape(-1, 2)
                kept.append(np.frombuffer(raw, np.uint8)[stay].tobytes())
            else:
                kept.append(raw)
            n_bytes.append(len(raw))
            n_removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cells = [texts.column("_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
        return pa.table(cells, ["_id", "n_bytes", "n_removed", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = with_late(rows, late, parts, remove, f"_id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
