"""What C files hold, one row per finding: functions, calls, variables, types, macros, includes, uses and branches.

A file is read by a small helper over its tokens; whatever needs more than one file
(calls, includes, variables behind pointers) is left to joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import c_access

# Words of the language that are no names, and those that open a declaration.
KEYWORDS = frozenset("if else for while do switch case default return break continue goto sizeof typedef struct union enum const volatile static extern inline register unsigned signed void char short int long float double auto restrict".split())
_QUALIFIERS = frozenset("const volatile static extern inline register struct union enum unsigned signed".split())
_BASIC = frozenset("void char short int long float double unsigned signed".split())
_COVER = re.compile(r"\[cover\s+parentID=\{([0-9A-Fa-f-]+)\}\]")
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', re.M)
_MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(?:\([^)\n]*\))?[ \t]*((?:[^\\\n]|\\.|\\\n)*)$", re.M)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\\\n]|\\.|\\\n)*$", re.M)
_CONSTANT = re.compile(r"(?:0[xX][0-9A-Fa-f]+|\d+)[uUlL]*$|[A-Z][A-Z0-9_]*$")
_NAME = re.compile(r"[A-Za-z_]\w*$")

#: kind; the file's own names; and what else the kind has: see :func:`findings`.
FIELDS = "kind string, name string, owner string, value string, detail string, branch string, position int, line int, end int, flag boolean"


def _blank(match: re.Match) -> str:
    return "\n" * match.group().count("\n")


def _close(words: list[str], at: int, opening: str, closing: str) -> int:
    """The place of the bracket that closes the one at ``at``, or the end."""
    depth = 0
    for k in range(at, len(words)):
        depth += (words[k] == opening) - (words[k] == closing)
        if not depth:
            return k
    return len(words)


def _commas(words: list[str]) -> list[list[str]]:
    """Parts between commas outside of brackets."""
    parts, depth = [[]], 0
    for word in words:
        depth += (word in "([{") - (word in ")]}")
        if word == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(word)
    return [p for p in parts if p]


def _chain(words: list[str], at: int) -> tuple[str, int]:
    """The member chain that starts with the name at ``at``, and the place behind it."""
    text, k = words[at], at + 1
    while k < len(words):
        if words[k] == "[":
            end = _close(words, k, "[", "]") + 1
            text, k = text + "".join(words[k:end]), end
        elif words[k] in (".", "->") and k + 1 < len(words) and _NAME.match(words[k + 1]):
            text, k = text + words[k] + words[k + 1], k + 2
        else:
            break
    return text, k


def _declared(words: list[str]) -> tuple[str, str, list[str]] | None:
    """(type, name, initial value) if the statement declares one variable."""
    k = 0
    while k < len(words) and words[k] in _QUALIFIERS - _BASIC:
        k += 1
    start = k
    while k < len(words) and words[k] in _BASIC:
        k += 1
    if k == start:
        if k >= len(words) or not _NAME.match(words[k]) or words[k] in KEYWORDS:
            return None
        k += 1
    kind = " ".join(words[start:k])
    while k < len(words) and words[k] in ("*", "const", "volatile"):
        k += 1
    if k >= len(words) or not _NAME.match(words[k]) or words[k] in KEYWORDS:
        return None
    name, k = words[k], k + 1
    while k < len(words) and words[k] == "[":
        k = _close(words, k, "[", "]") + 1
    if k == len(words):
        return kind, name, []
    return (kind, name, words[k + 1 :]) if words[k] == "=" else None


def _row(kind: str, name: str, **more) -> dict:
    return {"kind": kind, "name": name, "owner": None, "value": None, "detail": None, "branch": None, "position": None, "line": None, "end": None, "flag": None} | more


def _body(owner: str, parameters: list[str], words: list[str], lines: list[int]) -> Iterator[dict]:
    """Findings in a function's body: calls, constants, locals, uses of variables and branches on parameters."""
    order, chains = 0, 0
    blocks: list[tuple[str, str | None, str | None]] = []  # (branch, case label) to go back to, and the chain whose else may follow
    branch, label, chain = "B0", None, None
    pending: tuple[str, str] | None = None  # (branch, chain) of a condition whose block starts next
    single: list[tuple[int, str]] = []
    begins, at, n_branches = 0, 0, 0
    while at < len(words):
        word = words[at]
        if word == "if" and at + 1 < len(words) and words[at + 1] == "(":
            end = _close(words, at + 1, "(", ")")
            test = words[at + 2 : end]
            n_branches += 1
            if not (at and words[at - 1] == "else" and chain):
                chains += 1
                chain = f"C{chains}"
            pending = (f"B{n_branches}", chain)
            plain = [w for w in test if w not in ("(", ")")]
            on = len(plain) == 3 and plain[1] in ("==", "!=", "<", ">", "<=", ">=") and (plain[0] in parameters or plain[2] in parameters)
            flip = on and plain[0] not in parameters
            yield _row("branch", pending[0], owner=owner, value=plain[0 if flip else 2] if on else None, detail=plain[1] if on else None, branch=chain, position=parameters.index(plain[2 if flip else 0]) if on else None, line=lines[at], flag=False)
        elif word == "else" and (at + 1 >= len(words) or words[at + 1] != "if") and chain:
            n_branches += 1
            pending = (f"B{n_branches}", chain)
            yield _row("branch", pending[0], owner=owner, branch=chain, line=lines[at], flag=True)
        elif word == "{":
            blocks.append((branch, label, pending[1] if pending else None))
            branch, pending = (pending[0] if pending else branch), None
            begins = at + 1
        elif word == "}":
            if blocks:
                branch, label, chain = blocks.pop()
            begins = at + 1
        elif word in ("case", "default"):
            end = next((k for k in range(at, len(words)) if words[k] == ":"), len(words))
            label = " ".join(words[at + 1 : end]) if word == "case" else "default"
            begins, at = end + 1, end
        elif word == ";":
            while single and single[-1][0] <= at:
                branch = single.pop()[1]
            begins = at + 1
        elif _NAME.match(word) and word not in KEYWORDS:
            if pending and words[at - 1] in (")", "else") and not _inside(words, at):
                single.append((at, branch))
                branch, pending = pending[0], None
            if at == begins or (at > begins and all(w in _QUALIFIERS for w in words[begins:at])):
                stop = next((k for k in range(at, len(words)) if words[k] in ";{}"), len(words))
                found = _declared(words[begins:stop]) if stop < len(words) and words[stop] == ";" else None
                if found:
                    yield _row("local", found[1], owner=owner, value=found[0], detail=_alias(found[2]), line=lines[at], flag="*" in words[begins : begins + words[begins:stop].index(found[1], 1)])
                    at = begins + words[begins:stop].index(found[1], 1) + 1
                    continue
            text, after = _chain(words, at)
            follows, before = words[after] if after < len(words) else "", words[at - 1] if at else ""
            if follows == "(" and text == word:
                order += 1
                end = _close(words, after, "(", ")")
                yield _row("call", word, owner=owner, value=label, branch=branch, position=order, line=lines[at])
                for k, argument in enumerate(_commas(words[after + 1 : end])):
                    if len(argument) == 1 and _CONSTANT.match(argument[0]):
                        yield _row("constant", word, owner=owner, value=argument[0], position=k, line=lines[at])
            else:
                both = follows in c_access._COMPOUND or follows in ("++", "--") or before in ("++", "--")
                access = "READ_WRITE" if both else "WRITE" if follows == "=" else "READ"
                yield _row("use", text, owner=owner, value=access, branch=branch, line=lines[at])
                if follows == "=" and text == word:
                    stop = next((k for k in range(after, len(words)) if words[k] == ";"), len(words))
                    to = _alias(words[after + 1 : stop])
                    if to:
                        yield _row("alias", word, owner=owner, detail=to, line=lines[at])
                for k in range(at + 1, after):  # names inside subscripts are read
                    if _NAME.match(words[k]) and words[k - 1] not in (".", "->") and words[k] not in KEYWORDS and not (k + 1 < len(words) and words[k + 1] == "("):
                        yield _row("use", words[k], owner=owner, value="READ", branch=branch, line=lines[k])
                at = after
                continue
        at += 1


def _inside(words: list[str], at: int) -> bool:
    """Whether the place lies inside a condition's brackets."""
    depth = 0
    for k in range(at - 1, -1, -1):
        if words[k] in ";{}":
            break
        depth += (words[k] == ")") - (words[k] == "(")
        if depth < 0:
            return True
    return False


def _alias(words: list[str]) -> str | None:
    """What a pointer is set to, if the value is an address or a bare chain, behind casts or not."""
    while words and words[0] == "(" and ")" in words and len(words) > _close(words, 0, "(", ")") + 1:
        words = words[_close(words, 0, "(", ")") + 1 :]
    bare = words[1:] if words[:1] in (["&"], ["*"]) else words
    if not bare or not _NAME.match(bare[0]) or bare[0] in KEYWORDS:
        return None
    text, after = _chain(bare, 0)
    return "".join(words[: len(words) - len(bare)]) + text if after == len(bare) else None


def findings(text: str) -> list[dict]:
    """Everything found in one file, in its order.

    ``function`` (value: return type, detail: parameters joined by ``;``, flag: static, line to end), ``parameter`` (owner, position,
    value: type), ``call`` (owner, value: case label, position: order), ``constant`` (argument ``position`` of a call), ``local`` (owner, value: type, detail: what it is set to, flag: pointer),
    ``alias``, ``use`` (owner, value: access), ``branch`` (owner, detail and value: operator and constant, position: parameter, branch: chain,
    flag: else), ``register`` (owner, value: access, detail: field), ``global`` (value: type, flag: static), ``type`` (value: struct,
    union, enum or simple), ``member`` (owner: type, value: its type), ``macro`` (value), ``include``, ``cover`` (owner: the next function, or none).
    """
    out = [_row("include", m[1], line=text.count("\n", 0, m.start()) + 1) for m in _INCLUDE.finditer(text)]
    out += [_row("macro", m[1], value=" ".join(m[2].replace("\\\n", " ").split()), line=text.count("\n", 0, m.start()) + 1) for m in _MACRO.finditer(text)]
    covers = [(text.count("\n", 0, m.start()) + 1, m[1]) for m in _COVER.finditer(text)]
    words, lines = c_access._tokens(_DIRECTIVE.sub(_blank, text))
    at, starts = 0, 0
    functions = []
    while at < len(words):
        if words[at] == ";":
            out += _outer(words[starts:at], lines[starts] if starts < len(lines) else 0)
            starts = at + 1
        elif words[at] == "{":
            end = _close(words, at, "{", "}")
            head = words[starts:at]
            name_at = next((k for k in range(len(head) - 1) if head[k + 1] == "(" and _NAME.match(head[k]) and head[k] not in KEYWORDS | {"FUNC", "P2VAR", "P2CONST"}), None)
            if name_at is not None and "typedef" not in head and "=" not in head:
                name, close = head[name_at], _close(head, name_at + 1, "(", ")")
                parameters = []
                for k, given in enumerate(_commas(head[name_at + 2 : close])):
                    names = [w for w in given if _NAME.match(w) and w not in KEYWORDS]
                    if names and given != ["void"]:
                        parameters.append(names[-1])
                        out.append(_row("parameter", names[-1], owner=name, value=" ".join(given[: len(given) - 1 - given[::-1].index(names[-1])]), position=k))
                    else:
                        parameters.append("")
                kept = [p for p in parameters if p]
                out.append(_row("function", name, value=" ".join(w for w in head[:name_at] if w not in ("static", "inline", "extern")), detail=";".join(kept), line=lines[starts], end=lines[min(end, len(lines) - 1)], flag="static" in head[:name_at]))
                functions.append((lines[starts], name))
                out += _body(name, parameters, words[at + 1 : end], lines[at + 1 : end])
                out += [_row("register", r, owner=name, value=does, detail=field, line=lines[at] + line - 1) for r, field, does, line in c_access.accesses(_text(words[at + 1 : end], lines[at + 1 : end], lines[at]))]
                at = starts = end + 1
                continue
            at = end
        at += 1
    out += [_row("cover", guid, owner=next((n for k, n in sorted(functions) if k >= line), None), line=line) for line, guid in covers]
    return out


def _text(words: list[str], lines: list[int], first: int) -> str:
    """Tokens as text again, on their lines."""
    parts, now = [], first
    for word, line in zip(words, lines, strict=True):
        parts.append("\n" * (line - now) + word)
        now = line
    return " ".join(parts)


def _outer(words: list[str], line: int) -> list[dict]:
    """A declaration outside of functions: types with their members, and variables."""
    if "{" in words and words[:1] == ["typedef"] or words[:1] and words[0] in ("struct", "union", "enum") and "{" in words:
        at = words.index("{")
        end = _close(words, at, "{", "}")
        kind = next((w for w in words[:at] if w in ("struct", "union", "enum")), None)
        tail = [w for w in words[end + 1 :] if _NAME.match(w)]
        name = tail[0] if tail and words[0] == "typedef" else next((w for w in words[:at] if _NAME.match(w) and w not in KEYWORDS), None)
        if kind is None or name is None:
            return []
        rows = [_row("type", name, value=kind, line=line)]
        if kind == "enum":
            return rows + [_row("member", part[0], owner=name, value="enum", position=k) for k, part in enumerate(_commas(words[at + 1 : end]))]
        members, start, depth = [], at + 1, 0
        for k in range(at + 1, end):
            depth += (words[k] == "{") - (words[k] == "}")
            if words[k] == ";" and not depth:
                part = words[start:k]
                part = part[: part.index(":")] if ":" in part else part
                found = _declared(part)
                if found:
                    members.append(found)
                start = k + 1
        return rows + [_row("member", m, owner=name, value=t, position=k) for k, (t, m, _) in enumerate(members)]
    if words[:1] == ["typedef"]:
        names = [w for w in words if _NAME.match(w)]
        return [_row("type", names[-1], value="simple", detail=" ".join(words[1:-1]), line=line)] if len(names) > 2 else []
    if "(" in words[: words.index("=")] if "=" in words else "(" in words:
        return []  # a prototype
    if words[:1] == ["extern"]:
        return []
    found = _declared(words)
    return [_row("global", found[1], value=found[0], line=line, flag="static" in words)] if found else []


def c_findings(files: DataFrame) -> DataFrame:
    """``file`` and :data:`FIELDS` for every finding in C files (``file, text``); null texts have none."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = findings(text) if text else []
                owners += [k] * len(own)
                rows += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True))], ["file", *names])

    return files.select("file", F.col("text").cast("string")).mapInArrow(run, f"file string, {FIELDS}")
