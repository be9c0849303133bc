"""Operator 4: substring deduplication by Rabin-Karp hashes of fixed-length word windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .repeats import corpus_bytes, keyed, late_windows, with_late

_COMPARED, _SPREAD = 0xD6E8FEB86659FD93, 0xCA9B0C7EBA1DA115
_SLICE = 250_000


def word_windows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Two hashes and the place of every window of ``width`` words that lies in one document."""
    for at, to in packed.slices(batch.column(0), _SLICE):
        data, offsets = packed.buffers(batch.column(0).slice(at, to - at))
        starts, ends, counts = packed.words(data, offsets)
        if len(starts) < width:
            continue
        codes = packed.span_hashes(data, starts, ends)
        row, place = packed.within(counts)
        n = len(codes) - width + 1
        whole = row[:n] == row[width - 1 :]
        row, place = row[:n][whole], place[:n][whole]
        doc = batch.column(1).slice(at, to - at).to_numpy(zero_copy_only=False)
        twin = batch.column(2).slice(at, to - at).to_numpy(zero_copy_only=False)
        yield packed.rolling(codes, width, _COMPARED)[whole], packed.rolling(packed.mix64(codes), width, _SPREAD)[whole], doc[row], twin[row], place


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, windows_per_bucket: int = 1_000_000, part_bytes: int = 8_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier.

    Words are runs of bytes other than space and 0x09-0x0D.  Earlier means a
    smaller ``id_col``, or the same document and an earlier start.  Windows are
    judged on the input.  Returns ``id_col``, ``n_words``, ``n_removed``, ``spans``
    (maximal removal intervals as word numbers, end excluded) and ``kept`` (the
    kept words joined by one space), one row per input row.  With ``carry``, these
    columns come along, and ``text_after``: the text as it was where nothing was
    removed, else ``kept``.

    Null and empty texts have no words; texts below ``width`` words lose none;
    rows with a null id come last; rows with one id and one text are one document
    given several times and get the same result, rows with one id and other texts
    are ordered among themselves by a hash.  Other columns are ignored.

    All windows are hashed and counted; the bucket number, from a second hash,
    adds its bits to the 64 compared.  The number of buckets follows the corpus
    (about ``windows_per_bucket`` each), so the memory of a task stays the same.
    """
    rows = keyed(docs, id_col, text_col, carry)
    size = corpus_bytes(rows, "_text")
    buckets, parts = max(8, size // (6 * windows_per_bucket)), max(8, size // part_bytes)
    late = late_windows(rows.select("_text", "_doc", "_twin"), lambda b: word_windows(b, width), buckets, parts)

    def remove(texts: pa.Table, late_of) -> pa.Table:
        n_words, n_removed, spans, kept, after = [], [], [], [], []
        for text, doc, twin in zip(*(texts.column(c).to_pylist() for c in ("_text", "_doc", "_twin")), strict=True):
            found = (text or "").encode().split()  # bytes: exactly space and 0x09-0x0D separate
            starts = late_of(doc, twin)
            runs = np.zeros((0, 2), np.int64)
            if len(starts):
                edges = np.zeros(len(found) + 1, np.int32)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + width, -1)
                stay = np.cumsum(edges)[:-1] == 0
                runs = np.flatnonzero(np.diff(np.r_[True, stay, True])).reshape(-1, 2)
                found_kept = compress(found, stay)
            else:
                found_kept = found
            kept.append(b" ".join(found_kept).decode())
            n_words.append(len(found))
            if carry:
                after.append(kept[-1] if len(runs) else text)
            n_removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cells = [texts.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
        names = ["_id", "n_words", "n_removed", "spans", "kept"]
        if carry:
            cells, names = [*cells, pa.array(after, pa.string()), *(texts.column(f"_{k}") for k in range(len(carry)))], [*names, "text_after", *(f"_{k}" for k in range(len(carry)))]
        return pa.table(cells, names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"_id {kinds['_id']}, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept string"
    if carry:
        schema += ", text_after string" + "".join(f", _{k} {kinds[f'_{k}']}" for k in range(len(carry)))
    out = with_late(rows, late, parts, remove, schema)
    return out.withColumnsRenamed({"_id": id_col} | {f"_{k}": c for k, c in enumerate(carry)})


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
