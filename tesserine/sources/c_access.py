"""Register accesses in C text, told apart by their place in the statement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What a statement is made of; comments, strings and character constants never hold an access.
_TOKEN = re.compile(r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+\w*|\d[\w.]*|<<=|>>=|->|\+\+|--|[-+*/%&|^=!<>]=|<<|>>|&&|\|\||\n|\S""", re.S)
#: Pointers that lead to registers, and the views (bits or the unsigned whole) that end a register's path.
_BASE = re.compile(r"\w+(?:SFR|Ch)$")
_TABLE = re.compile(r"\w+Ptr$")
_VIEWS = ("B", "U")
#: Macros by the end of their names: what they do to the register path in them.
_MACROS = (
    (re.compile(r"(?:SFRWRITE|SFR_(?:RUNTIME|INIT_DEINIT)_WRITE(?:32)?)$"), ("WRITE",)),
    (re.compile(r"(?:SFRREAD|SFR_(?:RUNTIME|INIT_DEINIT)_READ(?:32)?)$"), ("READ",)),
    (re.compile(r"SWPMSK$"), ("READ", "WRITE")),
)
_COMPOUND = {"|=", "&=", "^=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>="}
_NAME = re.compile(r"[A-Za-z_]\w*$")
_VIEW_END = re.compile(r"\.(?:B|U)(?:\.\w+)?$")


def _tokens(text: str) -> tuple[list[str], list[int]]:
    words, lines, line = [], [], 1
    for token in _TOKEN.findall(text):
        if token == "\n":
            line += 1
        elif token.startswith(("/*", "//", '"', "'")):
            line += token.count("\n")
        else:
            words.append(token)
            lines.append(line)
    return words, lines


def _subscripts(words: list[str], at: int) -> int:
    """The place after the subscripts that start at ``at``, brackets inside them included."""
    while at < len(words) and words[at] == "[":
        depth = 0
        while at < len(words):
            depth += (words[at] == "[") - (words[at] == "]")
            at += 1
            if not depth:
                break
    return at


def _path(words: list[str], at: int) -> tuple[list[str], str | None, int]:
    """Names of a member path from ``at`` up to its view, the field after a bits view, and the place behind."""
    names: list[str] = []
    while at < len(words) and _NAME.match(words[at]):
        name, after = words[at], _subscripts(words, at + 1)
        if name in _VIEWS and names:
            if after + 1 < len(words) and words[after] == "." and _NAME.match(words[after + 1]):
                return names, words[after + 1], _subscripts(words, after + 2)
            return names, "U", after
        names.append(name + "".join(words[at + 1 : after]))
        if after >= len(words) or words[after] not in (".", "->"):
            return names, None, after
        at = after + 1
    return names, None, at


def accesses(text: str) -> list[tuple[str, str, str, int]]:
    """``(register, field, READ or WRITE, line)`` of a function's text, in the order of its tokens.

    A path from a register pointer (``XxxSFR->REG.U``, ``XxxPtr[i]->GRP.REG.B.FLD``)
    is written where ``=`` follows it outside of brackets, read and written where a
    compound assignment, ``++`` or ``--`` stands at it, and read elsewhere.  In a macro call the macro
    says what happens to the whole of its first path, whatever it starts with; what stands beside it is read.
    """
    words, lines = _tokens(text)
    out: list[tuple[str, str, str, int]] = []
    calls: list[tuple[tuple[str, ...] | None, bool]] = []  # what the open brackets' macros do, and whether to a path that is yet to come
    at = 0
    while at < len(words):
        word = words[at]
        if word == "(":
            does = next((d for pattern, d in _MACROS if at and pattern.search(words[at - 1])), None)
            calls.append((does, does is not None))
        elif word == ")" and calls:
            calls.pop()
        macro = next((k for k in range(len(calls) - 1, -1, -1) if calls[k][1]), None)
        if macro is not None and _NAME.match(word):
            names, field, after = _path(words, at)
            if field is not None:
                path = _VIEW_END.sub("", "".join(words[at:after]).rsplit("->", 1)[-1])
                out += [(path, "U", does, lines[at]) for does in calls[macro][0]]
                calls[macro] = (calls[macro][0], False)
                at = after
                continue
        table = _TABLE.match(word) and at + 1 < len(words) and words[at + 1] == "["
        first = _subscripts(words, at + 1)
        if (_BASE.match(word) or table) and first < len(words) and words[first] in ("->", "."):
            names, field, after = _path(words, first + 1)
            if field is not None:
                register = "_".join(n.split("[")[0] for n in names) if table else ".".join(names)
                follows, before = words[after] if after < len(words) else "", words[at - 1] if at else ""
                if follows in _COMPOUND or follows in ("++", "--") or before in ("++", "--"):
                    kinds = ("READ", "WRITE")
                else:
                    kinds = ("WRITE",) if follows == "=" else ("READ",)
                out += [(register, field, does, lines[at]) for does in kinds]
                at = after
                continue
        at += 1
    return out


def register_accesses(functions: DataFrame, id_col: str = "function_id", text_col: str = "body") -> DataFrame:
    """``id_col, register, field, access_type, line``: the register accesses in every function's text; null texts have none."""
    kind = functions.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = accesses(text) if text else []
                owners += [k] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *arrays], ["id", "register", "field", "access_type", "line"])

    rows = functions.select(id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, register string, field string, access_type string, line int").withColumnRenamed("id", id_col)
