"""Chunking of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_paragraphs(text: str, most: int, overlap: int) -> list[str]:
    """Greedy chunks of whole paragraphs up to ``most`` characters; each starts with the last ``overlap`` of the one before.

    A paragraph longer than ``most`` is cut at that length.
    """
    pieces = [p[i : i + most] for p in text.split("\n") if p.strip() for i in range(0, len(p), most)]
    out, held = [], ""
    for piece in pieces:
        if held and len(held) + 1 + len(piece) > most:
            out.append(held)
            tail = held[-overlap:] if overlap else ""
            held = f"{tail}\n{piece}" if tail and len(tail) + 1 + len(piece) <= most else piece
        else:
            held = f"{held}\n{piece}" if held else piece
    return [*out, held] if held else out


def overlap_chunks(docs: DataFrame, id_col: str, text_col: str, most: int, overlap: int) -> DataFrame:
    """``id_col, chunk_no, chunk`` of every document; the greedy fill depends on order, so it runs per text in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, chunk) for i, text in zip(batch["_id"], batch["_text"], strict=True) for k, chunk in enumerate(split_paragraphs(text or "", most, overlap))]
            yield pd.DataFrame(rows, columns=["_id", "chunk_no", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {kind}, chunk_no int, chunk string").withColumnRenamed("_id", id_col)


def sections(docs: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """``id_col, section_no, title, n_lines, body``: lines grouped under the heading before them; lines before the first one form section 0.

    Lines stay inside their document's array, so sections cost no shuffle; each line is copied once.
    """
    lined = docs.select(F.col(id_col).alias("_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("_lines"))
    heads = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.get("_lines", i - 1).rlike(heading))
    cuts = lined.withColumn("_cuts", F.concat(F.array(F.lit(0)), heads))
    until = lambda k: F.coalesce(F.get("_cuts", k + 1), F.size("_lines") + 1)
    made = F.transform("_cuts", lambda c, k: F.struct(F.get("_lines", c - 1).alias("title"), F.slice("_lines", c + 1, until(k) - c - 1).alias("body")))
    each = cuts.select("_id", F.posexplode(made).alias("section_no", "_s"))
    return each.select(F.col("_id").alias(id_col), "section_no", F.col("_s.title").alias("title"), F.size("_s.body").alias("n_lines"), F.array_join("_s.body", "\n").alias("body"))


def parents(headings: DataFrame, doc: str, number: str) -> DataFrame:
    """Add ``parent``: the row of the same document whose number lacks the last dotted segment, null if there is none."""
    up = headings.select(F.col(doc), F.col(number).alias("parent")).distinct()
    wanted = F.when(F.col(number).contains("."), F.regexp_replace(F.col(number), r"\.[^.]*$", ""))
    return headings.withColumn("_up", wanted).join(up.withColumnRenamed("parent", "_up").withColumn("parent", F.col("_up")), [doc, "_up"], "left").drop("_up")


def merge_small(chunks: DataFrame, doc: str, order: str, text: str, least: int, most: int) -> DataFrame:
    """Consecutive chunks below ``least`` characters merged with what precedes them, by gaps and islands, up to about ``most``."""
    window = Window.partitionBy(doc).orderBy(order)
    opens = (F.length(text) >= least) | F.lag(text).over(window).isNull()
    total = F.sum(F.length(text)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    island = chunks.withColumn("_open", opens.cast("int")).withColumn("_island", F.sum("_open").over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_block", F.floor(total / most))
    grouped = island.groupBy(doc, "_island", "_block").agg(F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(order, text))).alias("_parts"))
    return grouped.select(doc, order, F.array_join(F.transform("_parts", lambda x: x[text]), "\n").alias(text))


#: Headings with a number, whose depth is the number of its parts, and any others, whose depth is that of their marks.
_NUMBERED = re.compile(r"^#{1,6}[ \t]+(\d+(?:\.\d+)*)\.?[ \t]+(\S.*?)[ \t]*$", re.M)
_PLAIN = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t]*$", re.M)


def headings(text: str) -> list[tuple[int, str, str, int]]:
    """``(start, number, title, depth)`` of a markdown text's headings.

    If none has a number, all are numbered as they nest: a deeper count starts anew under each shallower heading.
    """
    found = [(m.start(), m[1], m[2], m[1].count(".") + 1) for m in _NUMBERED.finditer(text)]
    if found:
        return found
    counts: dict[int, int] = {}
    for m in _PLAIN.finditer(text):
        depth = len(m[1])
        counts[depth] = counts.get(depth, 0) + 1
        for deeper in [d for d in counts if d > depth]:
            counts[deeper] = 0
        found.append((m.start(), ".".join(str(counts.get(d, 0)) for d in range(min(counts), depth + 1)), m[2], depth))
    return found


def split_depth(heads: list[tuple[int, str, str, int]], length: int, target: int | None = None) -> int:
    """The depth to split at: the shallowest with three headings or more, else the shallowest there is, 2 without headings.

    With ``target``, the depth whose sections come nearest to that many characters on average (the shallower of equal ones), all depths in one pass.
    """
    counts: dict[int, int] = {}
    for head in heads:
        counts[head[3]] = counts.get(head[3], 0) + 1
    if not counts:
        return 2
    if target is not None:
        return min(sorted(counts), key=lambda d: abs(length / counts[d] - target))
    return next((d for d in sorted(counts) if counts[d] >= 3), min(counts))


def at_depth(text: str, depth: int | None = None, target: int | None = None) -> list[tuple[str, str, int, int]]:
    """``(number, title, start, end)`` of the sections at one depth, each up to the next heading as shallow or shallower with another number.

    Of sections with one number (a table of contents repeats them) the longest stays, the first of equal ones.
    """
    heads = headings(text)
    depth = split_depth(heads, len(text), target) if depth is None else depth
    best: dict[str, tuple[str, str, int, int]] = {}
    for k, (start, number, title, own) in enumerate(heads):
        if own == depth:
            end = next((h[0] for h in heads[k + 1 :] if h[3] <= depth and h[1] != number), len(text))
            if number not in best or len(text[start:end].strip()) > len(text[best[number][2] : best[number][3]].strip()):
                best[number] = (number, title, start, end)
    return sorted(best.values(), key=lambda s: s[2])


def split_large(text: str, most: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters that cover ``text`` in order.

    A text above the bound is cut at its shallowest headings (but for one at its start), each part again in the
    same way; without headings at the ends of paragraphs, as few parts as they allow, and inside a
    paragraph only where it is too long itself.  Parts cut at paragraphs start ``overlap``
    characters early, as far as the bound allows; without overlap the spans join to the text.
    """
    if overlap >= most > 0:
        raise ValueError("the overlap must be below the bound")
    out: list[tuple[int, int]] = []
    todo = [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= most:
            if end > start:
                out.append((start, end))
            continue
        heads = [(m.start(), len(m[1])) for m in _PLAIN.finditer(text, start, end) if m.start() > start]
        if heads:
            shallow = min(d for _, d in heads)
            cuts = [start, *(at for at, d in heads if d == shallow), end]
            todo += reversed(list(zip(cuts, cuts[1:], strict=False)))
            continue
        room = most - overlap
        at = start
        while at < end:
            limit = min(at + (most if at == start else room), end)
            stop = limit
            if limit < end:
                stop = max((m.end() for m in re.finditer(r"\n[ \t]*\n+", text[at:limit])), default=0) + at
                if stop == at:
                    stop = max(text.rfind("\n", at, limit) + 1, at) or limit
                    stop = stop if stop > at else limit
            out.append((max(start, at - overlap), stop))
            at = stop
    return out


def _spans(docs: DataFrame, id_col: str, text_col: str, find, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *found) for i, text in zip(batch["_id"], batch["_text"], strict=True) for k, found in enumerate(find(text or ""))]
            yield pd.DataFrame(rows, columns=["_id", "no", *(c.split()[0] for c in schema.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {kind}, no int, {schema}").withColumnRenamed("_id", id_col)


def large_pieces(docs: DataFrame, id_col: str, text_col: str, most: int, overlap: int = 0) -> DataFrame:
    """``id_col, no, start, end, piece`` of every text, by :func:`split_large`."""
    return _spans(docs, id_col, text_col, lambda t: [(a, b, t[a:b]) for a, b in split_large(t, most, overlap)], "start int, end int, piece string")


def depth_sections(docs: DataFrame, id_col: str, text_col: str, depth: int | None = None, target: int | None = None) -> DataFrame:
    """``id_col, no, number, title, content`` of every markdown text, by :func:`at_depth`."""
    return _spans(docs, id_col, text_col, lambda t: [(n, h, t[a:b].strip()) for n, h, a, b in at_depth(t, depth, target)], "number string, title string, content string")
