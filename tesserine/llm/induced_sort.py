"""Suffix sorting of one shard by induction, to a bounded depth, with disk-backed queues.

Suffixes are L (larger than their right neighbour) or S (smaller); an S suffix
right of an L suffix is S*.  Sorted S* suffixes induce the order of all L suffixes
in one ascending scan, and those induce all S suffixes in a descending one.  A
scan pops suffix tuples from a priority queue by first symbol, in order of arrival,
and pushes their left neighbours.  Every tuple carries the length of the prefix it
shares with the one before it: pushing adds one to the least value scanned since
the last push to that symbol.  Queues beyond their memory go to files.

Depth is bounded (windows of ``depth`` symbols are what is asked for), so prefix
values stop there, and the S* suffixes, instead of a recursion on their names, are
ordered by refining groups eight symbols at a time, only as deep as that.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

from .packed import mix64

#: Symbols below all bytes of UTF-8, whose largest is 0xF4: the text's end and the border of segments.
END, BORDER, SHIFT = 0, 1, 2
_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


class SymbolQueues:
    """A priority queue of (position, shared prefix) by symbol, first in first out; spills to ``folder``."""

    def __init__(self, folder: str, name: str, memory_items: int):
        self.folder, self.name, self.most, self.held = folder, name, memory_items, 0
        self.chunks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def push(self, symbol: int, place: np.ndarray, shared: np.ndarray) -> None:
        self.chunks.setdefault(symbol, []).append((place, shared))
        self.held += len(place)
        if self.held > self.most:
            for s, parts in self.chunks.items():
                for k, dtype in ((0, "p"), (1, "l")):
                    with open(self._path(s, dtype), "ab") as f:
                        for part in parts:
                            f.write(part[k].tobytes())
            self.chunks, self.held = {}, 0

    def _path(self, symbol: int, kind: str) -> str:
        return os.path.join(self.folder, f"{self.name}-{symbol}-{kind}")

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a symbol that have arrived, and none of them stays."""
        parts = self.chunks.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in parts)
        path = self._path(symbol, "p")
        if os.path.exists(path):
            parts.insert(0, (np.fromfile(path, np.int32), np.fromfile(self._path(symbol, "l"), np.uint8)))
            os.remove(path)
            os.remove(self._path(symbol, "l"))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])


class _Shared:
    """For each symbol, the least shared prefix scanned since the last push to it."""

    def __init__(self, depth: int):
        self.depth, self.least = depth, np.zeros(256, np.uint8)

    def push_all(self, queues: SymbolQueues, symbols: np.ndarray, places: np.ndarray, go: np.ndarray, scanned: np.ndarray) -> None:
        """Push ``places[go]`` by ``symbols``; ``scanned`` has the shared prefixes of the whole batch."""
        if not len(scanned):
            return
        rows = np.flatnonzero(go)
        own = symbols[rows]
        order = np.argsort(own, kind="stable")
        before = self.least.copy()
        self.least = np.minimum(self.least, scanned.min())
        if not len(rows):
            return
        bounds = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        for a, b in zip(bounds, [*bounds[1:], len(rows)], strict=True):
            at = rows[order[a:b]]
            s = int(symbols[at[0]])
            starts = np.r_[0, at + 1]
            tail = starts[-1] < len(scanned)
            low = np.minimum.reduceat(scanned, starts if tail else starts[:-1])
            self.least[s] = low[-1] if tail else self.depth
            low = low[: len(at)].copy()
            low[0] = min(low[0], before[s])
            queues.push(s, places[at], np.minimum(low + 1, self.depth).astype(np.uint8))


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S."""
    n = len(text)
    out = np.ones(n, bool)
    last = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 2))
    nearest = np.minimum.accumulate(last[::-1])[::-1]  # where the run of equal symbols ends
    out[:-1] = text[nearest] < text[nearest + 1]
    return out


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """At each place eight symbols as one number, the first one highest; zeros beyond the end, as far as ``depth`` reaches."""
    n = len(text) + depth + 8
    words = np.zeros(n + 8, np.uint64)
    words[: len(text)] = text
    for k in (1, 2, 4):  # pairs, then fours, then eights
        words[:-k] = words[:-k] << np.uint64(8 * k) | words[k:]
        words[-k:] = 0
    return words[:n]


def _shared_symbols(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many of the first ``depth`` symbols two lists of suffixes share, pair by pair."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, depth, 8):
        diff = words[a[live] + at] ^ words[b[live] + at]
        out[live] += 8 - np.searchsorted(_BYTES, diff, side="right")  # leading bytes that agree
        live = live[diff == 0]
    return np.minimum(out, depth)


def _refined(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (or a few more): groups of equal ones are split by as many further symbols as fit one number with the group's."""
    order = places[np.argsort(words[places])]
    key, at = words[order], 8
    fresh = np.r_[True, key[1:] != key[:-1]] if len(order) else np.zeros(0, bool)  # where a group starts
    rows = np.arange(len(order))
    while at < depth and len(rows):
        crowded = np.r_[~fresh[1:], False] | ~fresh
        rows, fresh = rows[crowded], fresh[crowded]
        if not len(rows):
            break
        group = (np.cumsum(fresh) - 1).astype(np.uint64)
        symbols = (64 - int(group[-1] + np.uint64(1)).bit_length()) // 8
        key = group << np.uint64(8 * symbols) | words[order[rows] + at] >> np.uint64(64 - 8 * symbols)
        again = np.argsort(key)
        order[rows], key = order[rows][again], key[again]
        fresh = np.r_[True, key[1:] != key[:-1]]
        at += symbols
    return order


def sort_stars(words: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order of their first symbols, and the prefix each shares with its predecessor.

    Suffixes that agree all the way down are found by a hash, checked symbol by
    symbol, and only one of each goes through the sort.
    """
    code = np.zeros(len(stars), np.uint64)
    for at in range(0, depth, 8):
        code = mix64(code ^ words[stars + at])
    by_code = np.argsort(code)
    fresh = np.r_[True, np.diff(code[by_code]) != 0] if len(stars) else np.zeros(0, bool)
    heads, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    mates = stars[by_code]
    leads = mates[heads]
    rest, own = mates[~fresh], leads[group[~fresh]]
    if any((words[rest + at] != words[own + at]).any() for at in range(0, depth, 8)):  # hashes collide: sort all
        mates = leads = stars
        heads = np.arange(len(stars))
    sizes = np.diff(np.r_[heads, len(stars)])
    of = np.empty(len(words), np.int32)
    of[leads] = np.arange(len(leads))
    ordered = _refined(words, leads, depth)
    rank = of[ordered]
    runs = sizes[rank]
    first = np.cumsum(runs) - runs
    order = mates[np.repeat(heads[rank] - first, runs) + np.arange(len(stars))]
    shared = np.full(len(stars), depth, np.uint8)
    if len(ordered):
        shared[first[1:]] = _shared_symbols(words, ordered[:-1], ordered[1:], depth)
        shared[0] = 0
    return order, shared


def equal_windows(text: np.ndarray, depth: int, memory_items: int = 8_000_000, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in order, by first symbol: pairs of places and whether each shares ``depth`` symbols with the one before.

    ``text`` ends with the one END symbol.  With ``wanted`` (places, ascending) only
    these and what induces them are sorted: from each wanted suffix up to the next
    S* suffix behind it; a few more may come along.
    """
    small = types(text)
    star = small & np.r_[False, ~small[:-1]]
    words = _words(text, depth)
    stars = np.flatnonzero(star).astype(np.int32)
    if wanted is not None:
        stars = stars[np.unique(np.searchsorted(stars, wanted, side="right"))]  # the last S* is the text's end, so each has one
    order, shared = sort_stars(words, stars, depth)
    seeds = np.searchsorted(text[order], np.arange(258))
    with tempfile.TemporaryDirectory() as folder:  # this task's own, gone with it
        queues, larger = SymbolQueues(folder, "l", memory_items), SymbolQueues(folder, "done", memory_items)
        state = _Shared(depth)
        for c in range(256):
            last = None
            while True:
                place, lcp = queues.pop(c)
                if not len(place):
                    break
                if last is None:
                    lcp[0] = 0
                larger.push(c, place, lcp)
                last = place[-1]
                left = place - 1
                go = (place > 0) & (text[left] >= c)
                state.push_all(queues, text[left], left, go, lcp)
            place = order[seeds[c] : seeds[c + 1]]
            if len(place):
                lcp = shared[seeds[c] : seeds[c + 1]].copy()
                lcp[0] = 0 if last is None else _shared_symbols(words, np.array([last]), place[:1], depth)[0]
                left = place - 1
                state.push_all(queues, text[left], left, place > 0, lcp)
        state = _Shared(depth)
        for c in range(255, -1, -1):
            parts = []
            first = True
            while True:
                place, lcp = queues.pop(c)
                if not len(place):
                    break
                if first:
                    lcp[0] = 0
                    first = False
                parts.append((place, lcp))
                left = place - 1
                go = (place > 0) & (text[left] <= c)
                state.push_all(queues, text[left], left, go, lcp)
            s_place, s_lcp = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.uint8))
            l_place, l_lcp = larger.pop(c)
            if c == END:  # the last suffix alone, which nothing induces
                s_place, s_lcp = np.array([len(text) - 1], np.int32), np.zeros(1, np.uint8)
            if len(l_place):
                down = np.r_[np.uint8(0), l_lcp[:0:-1]]
                if len(s_place):
                    down[0] = _shared_symbols(words, s_place[-1:], l_place[-1:], depth)[0]
                turned = l_place[::-1]
                left = turned - 1
                state.push_all(queues, text[left], left, (turned > 0) & (text[left] < c), down)
            place = np.concatenate([l_place, s_place[::-1]])
            lcp = np.concatenate([l_lcp, np.r_[np.uint8(0), s_lcp[:0:-1]] if len(s_place) else s_lcp])
            if len(l_place) and len(s_place):
                lcp[len(l_place)] = _shared_symbols(words, l_place[-1:], s_place[-1:], depth)[0]
            if len(place):
                yield place, lcp >= depth
