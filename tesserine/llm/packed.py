"""Vectorised words and hashes over Arrow text columns.

A batch of texts is one byte buffer with row offsets.  Words, word hashes and
rolling (Rabin-Karp) hashes of word or byte windows come from prefix sums over
that buffer, all modulo 2**64, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTE_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i below at least ``n``, modulo 2**64 (``base`` odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for factor in (base, pow(base, -1, 2**64)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def step(i: int, by: int) -> np.uint64:
    """``i * by`` modulo 2**64."""
    return np.uint64(i * int(by) % 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its row offsets; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text each; a longer text stands alone."""
    _, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of every row."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = edge[:n].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span."""
    up, down = powers(_BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` codes, mixed; windows may cross rows, the caller masks those."""
    n = len(codes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[: n - width + 1])


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place inside its row of every element, from the rows' element counts."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]
