"""JSON inside noisy text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A brace, or a string with its escapes; an open string runs to the end.
_MARK = re.compile(r'[{}]|"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.S)


def balanced_end(text: str, start: int) -> int | None:
    """The place after the brace that closes the one at ``start``; braces in strings don't count."""
    depth = 0
    for mark in _MARK.finditer(text, start):
        found = mark.group()
        depth += (found == "{") - (found == "}")
        if not depth:
            return mark.end()
    return None


def object_in(text: str | None) -> str | None:
    """The first balanced part of ``text`` that is a JSON object, as it stands there; None if there is none."""
    start = text.find("{") if text else -1
    while start >= 0:
        end = balanced_end(text, start)
        if end is not None:
            try:
                json.loads(text[start:end])
                return text[start:end]
            except (ValueError, RecursionError):
                pass
        start = text.find("{", start + 1)
    return None


def _batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(object_in)


def first_object(text: Column) -> Column:
    """The first JSON object in each text, for ``from_json`` or ``get_json_object``."""
    return F.pandas_udf(_batches, "string")(text)
