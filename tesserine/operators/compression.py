"""The best sentences of whole documents, each document read and split once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS

_SHORT, _END, _CODE = re.compile(rf"(?:{ABBREVIATIONS})\."), re.compile(r"([.!?])\s+", re.ASCII), re.compile(r"[{};()]|^\s*#", re.ASCII)
_NAMES, _NORMS = ("function", "register", "struct", "enum", "typedef", "macro"), ("ASIL", "ISO", "MISRA", "AUTOSAR")
_NAME, _NORM = re.compile("|".join(_NAMES), re.ASCII | re.IGNORECASE), re.compile("|".join(_NORMS))


def _in_word(text: str, i: int) -> bool:
    """Whether ``\\b`` of Spark's expressions takes the character for part of a word: letters, digits, ``_`` and marks on letters or digits."""
    if text[i] < "\x80":
        return text[i].isalnum() or text[i] == "_"
    while i > 0 and category(text[i]) == "Mn":
        i -= 1
    return category(text[i])[0] == "L" or category(text[i]) == "Nd"


def _bounded(pattern: re.Pattern, text: str) -> bool:
    """Whether a match stands for itself, without part of a word on either side."""
    found = pattern.search(text)
    while found:
        i, j = found.span()
        if not (i and _in_word(text, i - 1)) and not (j < len(text) and _in_word(text, j)):
            return True
        found = pattern.search(text, i + 1)
    return False


def _held(text: str) -> str:
    """The text with the last dots of abbreviations replaced by a control character."""
    parts, done, found = [], 0, _SHORT.search(text)
    while found:
        i, j = found.span()
        if i and _in_word(text, i - 1):
            found = _SHORT.search(text, i + 1)
            continue
        parts += (text[done : j - 1], "\x01")
        done, found = j, _SHORT.search(text, j)
    return "".join([*parts, text[done:]]) if parts else text


def best_sentences(text: str, most: int, terms: tuple[str, ...] = ()) -> str:
    """The ``most`` best sentences in their own order, as ``functions.text``'s ``sentences`` and ``sentence_score`` have them; of equal ones the first.

    Terms are in lower case and ASCII.  What occurs nowhere in the text is not looked for in its sentences.
    """
    held = _held(text)
    kept = [s for part in _END.sub("\\1\x02", held).replace("\x01", ".").split("\x02") if (s := part.strip(" "))]
    if len(kept) <= most:
        return " ".join(kept)
    low = text.lower()
    names, norms, code = any(w in low for w in _NAMES), any(w in text for w in _NORMS), any(c in text for c in "{};()#")
    raws = list(map(str.encode, kept))
    minus = [-5 if 10 <= n <= 40 else 3 if n < 5 else 0 for n in map(len, map(bytes.split, raws))]  # scores in tenths, the best first
    if terms:
        raws = list(map(bytes.lower, raws))
    for term in (t.encode() for t in terms):
        minus = [m - 10 if term in raw else m for m, raw in zip(minus, raws, strict=True)]
    if names:
        minus = [m - 5 if _bounded(_NAME, s) else m for m, s in zip(minus, kept, strict=True)]
    if norms:
        minus = [m - 3 if _bounded(_NORM, s) else m for m, s in zip(minus, kept, strict=True)]
    if code:
        minus = [m - 7 if _CODE.search(s) else m for m, s in zip(minus, kept, strict=True)]
    return " ".join([kept[i] for i in sorted(sorted(range(len(kept)), key=minus.__getitem__)[:most])])


def compressed(docs: DataFrame, most: int, terms: tuple[str, ...] = (), query: str = "lang", item: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, item_id, tokens, content_md5`` of each document's best sentences; its text is read and split once, and none of it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sums = [], []
            for raw in batch.column(2):
                content = best_sentences(raw.as_py().decode("utf-8", "replace"), most, terms)
                tokens.append(max(1, len(content) // 4) if content else 0)
                sums.append(hashlib.md5(content.encode(), usedforsecurity=False).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(sums, pa.string())], ["query_id", "item_id", "tokens", "content_md5"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.filter(F.col(text).isNotNull()).select(query, item, F.col(text).cast("binary"))
    return rows.mapInArrow(run, f"query_id {kinds[query]}, item_id {kinds[item]}, tokens long, content_md5 string")
