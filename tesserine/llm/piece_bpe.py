"""Merge-type sentencepiece models in Python: exact encoding by backtracking, and decoding.

Greedy merging has one property that makes backtracking exact: a tiling of a
string is its encoding if, and only if, every two adjacent tokens come back
unchanged when their joint text is merged alone.  (The first merge across a
token border would also be the first one inside that pair.)  So the encoder
walks left to right over Aho-Corasick longest matches, tests each token against
its left neighbour by re-merging the two, tries shorter matches on a conflict,
and steps back when none fits.  A prefix has only one valid tiling, so a
position that failed once is failed for good; one bit each remembers them.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterable

import sentencepiece

SPACE_MARK = "▁"
_CACHED_CHARS = 48
_CACHED_ITEMS = 300_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class PieceModel:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        self.silent = {i for i in ids if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.end = sp.eos_id()
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.id_text = {piece: str(i) for piece, i in self.ids.items()}
        self.said = {piece: piece.replace(SPACE_MARK, " ") for piece in self.ids}
        self.matcher = matcher(self.ids)
        known = {p: p for p in self.ids}  # one object for each piece: its hash is computed once
        self.next_shorter = {p: known.setdefault(q, q) for p in self.ids if (q := next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.ids), p[0] if len(p) > 1 else ""))}
        self._after = Neighbours(self._merge_keeps)
        self.segment, self.part = map(re.compile, self._cuts())

    def _cuts(self) -> tuple[str, str]:
        """Patterns that cut where no piece can reach across: segments, and the finer parts of a segment.

        Segments end before a space mark that follows another character, and around
        line breaks that no longer piece holds.  Parts also end between a letter and
        a punctuation mark that no piece has after a letter.
        """
        if any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in self.ids):
            return r"(?s).+", r"(?s).+"
        inner = [piece for piece in self.ids if len(piece) > 1]
        stop = "".join(re.escape(c) for c in "\t\n\r" if not any(c in piece for piece in inner))
        letter = re.compile(f"[{_LETTERS}]")
        reached = {b for piece in inner for a, b in zip(piece, piece[1:], strict=False) if letter.match(a)}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in reached)
        segment = f"{SPACE_MARK}+[^{SPACE_MARK}{stop}]*|[^{SPACE_MARK}{stop}]+" + (f"|[{stop}]" if stop else "")
        return segment, f"(?s).(?:[^{marks}]+|(?<![{_LETTERS}])[{marks}])*" if marks else r"(?s).+"

    def segments(self, text: str) -> list[str]:
        """The text as the model sees it (one space put before it, spaces marked), cut into parts that merge separately."""
        return self.segment.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def merge(self, s: str) -> list[str]:
        """The model's own rule: of all adjacent pairs whose joint text is a piece, merge the best-scored, leftmost first."""
        parts, score = list(s), self.score
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, joint = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != joint:
                continue
            parts[i], parts[j] = joint, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (p := joint + parts[k]) in score:
                    heapq.heappush(heap, (-score[p], i, p))
            if (h := left[i]) >= 0 and (p := parts[h] + joint) in score:
                heapq.heappush(heap, (-score[p], h, p))
        return [p for p in parts if p]

    def _merge_keeps(self, a: str, b: str) -> bool:
        """Whether two adjacent tokens stay as they are when merged side by side (the first may be empty)."""
        return self.merge(a + b) == ([a, b] if a else [b])

    def tokens(self, s: str) -> list[str]:
        """Encode one segment by backtracking."""
        n = len(s)
        node, longest = self.matcher, []
        for c in reversed(s):
            node = node[c]
            longest.append(node.longest or c)
        longest.reverse()
        failed, stuck, out, at = bytearray(n // 8 + 1), False, [], 0
        after, shorter = self._after, self.next_shorter
        fits, token = after[""], longest[0] if n else ""
        while at < n:
            while token:
                to = at + len(token)
                if fits[token] and not (stuck and failed[to >> 3] >> (to & 7) & 1):
                    break
                token = shorter.get(token, "")  # a single character has none
            if token:
                out.append(token)
                fits, at = after[token], to
                token = longest[at] if at < n else ""
            else:
                failed[at >> 3] |= 1 << (at & 7)
                stuck = True
                token = out.pop()
                at -= len(token)
                fits, token = after[out[-1] if out else ""], shorter.get(token, "")
        return out

    def spell(self, tokens: list[str]) -> tuple[str, str]:
        """The tokens' decimal ids joined by one space, and what they decode to."""
        try:
            return " ".join([self.id_text[t] for t in tokens]), "".join([self.said[t] for t in tokens])
        except KeyError:  # characters that are no pieces
            ids = self.to_ids(tokens)
            return " ".join(map(str, ids)), self.surface(ids)

    def to_ids(self, tokens: list[str]) -> list[int]:
        out = []
        for token in tokens:
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in token.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str, end: bool = False) -> list[int]:
        out = [i for s in self.segments(text) for part in self.part.findall(s) for i in self.to_ids(self.tokens(part))]
        return [*out, self.end] if end else out

    def surface(self, ids: list[int]) -> str:
        """The text of ids, space marks as spaces; bytes that form no character give U+FFFD."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:  # a control id says nothing, but ends a run of bytes
                out.append(self.text[i].replace(SPACE_MARK, " "))
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library does: the space put before the text goes again."""
        first = next((i for i in ids if i not in self.silent), None)
        text = self.surface(ids)
        return text[1:] if first is not None and self.text[first].startswith(SPACE_MARK) else text


def _utf8(raw: bytearray) -> str:
    """Valid characters as they are, U+FFFD for each byte that is part of none."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Node(dict):
    """A state of an Aho-Corasick automaton that reads backwards: the next state for each character, and the longest word that starts here ("" if none does).

    Transitions by way of ``back``, the longest other suffix that is a state, are
    kept as they are met, so a text costs one look-up for each character; all
    states together keep no more than ``room`` of them.
    """

    __slots__ = ("longest", "back", "room")

    def __missing__(self, c: str) -> Node:
        node = self
        while c not in node and node.back is not None:
            node = node.back
        to = node.get(c, node)  # the first state has no ``back`` and stays
        if self.room[0] > 0:
            self.room[0] -= 1
            self[c] = to
        return to


def matcher(words: Iterable[str], room: int = 400_000) -> Node:
    """The first state of the automaton of ``words``, each entered from its end."""
    left = [room]

    def state() -> Node:
        node = Node()
        node.longest, node.back, node.room = "", None, left
        return node

    root = state()
    for word in words:
        node = root
        for c in reversed(word):
            if c not in node:
                node[c] = state()
            node = node[c]
        node.longest = word
    level = [root]
    while level:  # states of fewer characters first, as those of more lead back to them
        after = []
        for node in level:
            for c, to in node.items():
                back = node.back
                while back is not None and c not in back:
                    back = back.back
                to.back = root if back is None else back[c]
                to.longest = to.longest or to.back.longest
                after.append(to)
        level = after
    return root


class Neighbours(dict):
    """For each token a dictionary of what was found for the tokens after it; all is dropped when ``most`` results are kept."""

    def __init__(self, find, most: int = 600_000):
        super().__init__()
        self.find, self.most, self.kept = find, most, 0

    def __missing__(self, token: str) -> dict:
        self[token] = row = _Row(self, token)
        return row


class _Row(dict):
    __slots__ = ("table", "token")

    def __init__(self, table: Neighbours, token: str):
        super().__init__()
        self.table, self.token = table, token

    def __missing__(self, token: str) -> bool:
        table = self.table
        if table.kept >= table.most:
            table.clear()
            table.kept = 0
        self[token] = found = table.find(self.token, token)
        table.kept += 1
        return found


class Memo(dict):
    """Results for short keys, looked up at C speed, in bounded space.

    When it is full, :meth:`trim` sets everything aside; what is asked for again
    comes back from there, so frequent keys survive and rare ones go.
    """

    def __init__(self, make, most: int = _CACHED_ITEMS):
        super().__init__()
        self.make, self.most, self.aside = make, most, {}

    def __missing__(self, key):
        value = self.aside.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _CACHED_CHARS:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.aside = dict(self)
            self.clear()
