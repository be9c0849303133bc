"""Operator 1: main text of web pages by site template removal.

Every page is parsed into an element tree.  Subtrees outside running text are
hashed, Spark counts in how many pages of a host each hash occurs, and subtrees
that recur across the host's pages are deleted before the text is read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt option legend summary figcaption".split())
SCOPE = frozenset("table td th caption html body template button object".split())
# What is not main text, by element name, role, parts of a class or id, and whole classes or ids.
NEVER = frozenset("head script style noscript template iframe object svg canvas nav header footer aside form menu button select textarea input dialog audio video math title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar advertisement".split())
JUNK_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs masthead disqus cookie cookies consent gdpr popup newsletter "
    "comment comments respond footer sidebar menu submenu nav navbar navigation".split()
)
JUNK = JUNK_PARTS | frozenset("promotion banner header aside widget widgets reply replies discussion notice notices modal overlay subscribe subscription signup login share sharing social related recommended pagination pager toc skip".split())
# Beside one of these, a word of a class says what is not there.
UNLESS = frozenset("no non not without free has have with open closed on off enabled disabled".split())
# Never dropped for a class, id or role; nor is what holds an article or main.
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z!?])(?:[^>]*>|.*\Z)|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Node:
    tag: str
    marks: str = ""
    drop: bool = False
    parent: Node | None = None
    core: bool = False  # is or holds an article or main
    hint: int = 0  # how strongly class, id or role speak of furniture
    code: int = 0  # hash of the subtree
    children: list = field(default_factory=list)


def _hint(marks: str, role: str) -> int:
    """3 if the role or a whole class or id names page furniture, 2 if a part of one does, 1 if a whole one does with a word that texts go by as well."""
    if role in ROLES:
        return 3
    hint = 0
    for mark in marks.split():
        words = [w.lower() for w in _NAMES.findall(mark)]
        if mark.lower() in JUNK:
            hint = max(hint, 3 if mark.lower() in JUNK_PARTS else 1)
        elif not UNLESS.intersection(words) and JUNK_PARTS.intersection(words):
            hint = max(hint, 2)
    return hint


def _judged(tag: str, attributes: str) -> tuple[str, bool, int]:
    """What of an element's attributes counts in its hash, whether the element can't be main text, and whether its class, id or role hints at furniture."""
    drop = tag in NEVER
    if not attributes.strip():
        return "", drop, 0
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
    hint = _hint(f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower()) if marks and tag not in KEPT else 0
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return marks.lower(), (drop or hidden) and tag not in ("html", "body", "main"), hint


def _sizes(root: Node) -> dict[int, tuple[int, int]]:
    """Characters of text and of links in each element (by ``id``), without what is dropped."""
    size: dict[int, tuple[int, int]] = {}
    for node, _ in reversed(list(_preorder(root))):
        own, links = 0, 0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
            elif not child.drop:
                own, links = own + size[id(child)][0], links + size[id(child)][1]
        size[id(node)] = (own, own if node.tag == "a" else links)
    return size


def _around(node: Node) -> Node:
    """The article or main around an element, or else the root."""
    at = node.parent
    while at.parent is not None and at.tag not in ("article", "main"):
        at = at.parent
    return at


def _settle(root: Node, hinted: list[Node], parted: bool) -> None:
    """Decide which elements with a hint go: never what holds an article or main, nor what holds most of its surroundings' text as prose.

    The surroundings are the article or main around the element, or else the page.
    Beside an article (the page is ``parted``), what a strong hint names goes whatever its size.  A
    header inside an article stays if it holds a heading.  Sizes are taken only where they decide.
    """
    within = [(node, _around(node)) for node in hinted if not node.core]
    plain = lambda node, above: node.hint >= 2 and parted and above is root
    size = _sizes(root) if any(node.hint and not node.drop and not plain(node, above) for node, above in within) else {}
    for node, above in within:
        if node.tag == "header" and node.drop and above is not root and any(not isinstance(c, str) and c.tag in KEPT for c in node.children):
            node.drop = False
        if node.hint and not node.drop:
            if plain(node, above):
                node.drop = True
                continue
            text, links = size[id(node)]
            node.drop = not (2 * text + (node.hint == 2) > size[id(above)][0] and 5 * links < 3 * text)


def parse(page: str) -> Node:
    """A lenient element tree: unclosed and misplaced tags, cut-off pages and stray ``<`` never fail."""
    root = top = Node("#root")
    opened: dict[str, int] = {}
    place, parted, hinted = 0, False, []

    def back_to(node: Node) -> None:
        nonlocal top
        while top is not node:
            opened[top.tag] -= 1
            top = top.parent

    while place < len(page):
        m = _TOKEN.match(page, place)
        place = m.end()
        slash, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                top.children.append(html.unescape(piece) if "&" in piece else piece)
            continue
        name = name.lower()
        if slash:
            at = top if opened.get(name) else root
            while at.parent is not None and at.tag != name:
                if at.tag in ("td", "th", "article") and name not in ("tr", "table", "tbody", "article", "main", "body", "html"):
                    at = root
                    break
                at = at.parent
            if at.parent is not None:
                back_to(at.parent)
            continue
        if name in CLOSES_P or name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            peers = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
            stop = ("ul", "ol", "dl", "select") if name in ("li", "dd", "dt", "option") else ()
            at = closed = top
            while at.parent is not None and at.tag not in stop and (at.tag not in SCOPE or at.tag in peers):
                if at.tag == "p" or at.tag in peers:
                    closed = at.parent
                elif at.tag in BLOCK and at.tag not in peers and not peers:
                    break
                at = at.parent
            back_to(closed)
        marks, drop, hint = _judged(name, attributes)
        node = Node(name, marks, drop, top, hint=hint)
        top.children.append(node)
        if hint or name == "header":
            hinted.append(node)
        if name in ("article", "main"):
            at, parted = node, True
            while at is not None and not at.core:
                at.core, at = True, at.parent
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        top = node
        opened[name] = opened.get(name, 0) + 1
        if name in RAW:  # no markup inside, up to its own end tag
            end = _RAW_END[name].search(page, place)
            if end or name in ("script", "style"):
                node.children.append(page[place : end.start() if end else len(page)])
                place = end.start() if end else len(page)
            else:  # never closed: empty
                back_to(node.parent)
    if hinted:
        _settle(root, hinted, parted)
    return root


def _preorder(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element, parents first, and whether it is or lies inside an article or main; without recursion, so any nesting will do."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        yield node, inside
        stack += [(child, inside) for child in reversed(node.children) if not isinstance(child, str)]


def _print(root: Node, seed: int) -> list[Node]:
    """Hash all subtrees by element names, class marks and text, seeded by the host; returns those that may be template parts."""
    nodes = list(_preorder(root))
    for node, _ in reversed(nodes):  # children before their parents
        parts = [node.tag, node.marks, *(" ".join(c.split()) if isinstance(c, str) else format(c.code, "x") for c in node.children)]
        node.code = xxhash.xxh3_64_intdigest("\x1f".join(parts), seed) >> 1
    return [node for node, inside in nodes if node.tag in BLOCK and node.tag not in ("#root", "html", "body", "head") and not inside and not node.core]


def subtree_hashes(page: str | None, host: str) -> tuple[int, list[int]]:
    """A hash of the page's text without furniture, and the distinct hashes of its subtrees that may be template parts of its host (-1 if there is none, so that the page counts)."""
    root = parse(page or "")
    found = _print(root, xxhash.xxh3_64_intdigest(host))
    return xxhash.xxh3_64_intdigest(_read(root)) >> 1, sorted({node.code for node in found}) or [-1]


def main_text(page: str | None, host: str = "", recurring: Set[int] = frozenset()) -> str:
    """The page's blocks, without subtrees whose hash is in ``recurring`` and without page furniture."""
    root = parse(page or "")
    for node in _print(root, xxhash.xxh3_64_intdigest(host)) if recurring else ():
        if node.code in recurring:
            node.drop = True
    return _read(root)


def _blocks(roots: list[Node], without: Set[int] = frozenset()) -> list[str]:
    """The text blocks under ``roots`` in page order, without what is dropped and the elements (by ``id``) in ``without``."""
    blocks: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        text = " ".join("".join(open_block).split())
        if text:
            blocks.append(text)
        open_block.clear()

    stack: list = []
    for root in reversed(roots):
        stack += [None, *reversed(root.children), None]
    while stack:
        child = stack.pop()
        if child is None:
            close()
        elif isinstance(child, str):
            open_block.append(child)
        elif not child.drop and id(child) not in without:
            if child.tag in BLOCK:
                close()
                stack.append(None)
            elif child.tag == "br":
                open_block.append("\n")
            stack += reversed(child.children)
    close()
    return blocks


def _read(root: Node) -> str:
    """The blocks of the tree's articles if they have at least half of its text, else all of it; without what is dropped."""
    cores: list[Node] = []
    stack = [root]
    while stack:
        for child in reversed(stack.pop().children):
            if not isinstance(child, str) and not child.drop:
                if child.tag in ("article", "main"):
                    cores.append(child)
                else:
                    stack.append(child)
    if not cores:
        return "\n".join(_blocks([root]))
    order = {id(node): k for k, (node, _) in enumerate(_preorder(root))}
    cores.sort(key=lambda node: order[id(node)])
    inside, outside = _blocks(cores), _blocks([root], {id(c) for c in cores})
    return "\n".join(inside if sum(map(len, inside)) >= sum(map(len, outside)) else _blocks([root]))


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 3, least_share: float = 0.02, broadcast_rows: int = 500_000, enough_pages: int = 100
) -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, ``text``, one row per input row.

    A subtree is a template part if it occurs in at least ``least_pages`` pages of
    its host and in ``least_share`` of them or in ``enough_pages``.  Pages of one
    text count as one page, so copies of a page make no template.  Nothing inside
    ``article`` or ``main`` and nothing that holds one counts as template, since
    copied passages recur as well.  Null or empty html gives an empty text; a null
    url or one without host belongs to the host ``''``; repeated rows give repeated
    results; other columns are ignored.

    Counting shuffles one (host, text, hash) triple per subtree and distinct page, then
    pre-aggregated counts, so a host with a third of all pages only adds counts.  The recurring hashes (seeded by
    their host) are broadcast while there are at most ``broadcast_rows``; beyond
    that each page gets its own by a join on the hash, which AQE splits where one is hot.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).withColumn("_host", _host())

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(subtree_hashes, batch.column(1).to_pylist(), batch.column(0).to_pylist()))
            sizes = np.fromiter((len(f) for _, f in found), np.int64, len(found))
            take = np.repeat(np.arange(len(found)), sizes)
            codes = np.fromiter((c for _, f in found for c in f), np.int64, int(sizes.sum()))
            texts = np.fromiter((t for t, _ in found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), batch.column(2).take(pa.array(take)), pa.array(texts[take]), pa.array(codes)], ["_host", "_page", "_text", "_code"])

    page_key = F.xxhash64("_id", "_url", "_html")
    printed = rows.select("_host", "_html", page_key.alias("_page")).mapInArrow(prints, "_host string, _page long, _text long, _code long")
    once = printed.select("_host", "_text", "_code").distinct()
    sizes = once.groupBy("_host", "_text").agg(F.count("_code").alias("_codes")).groupBy("_host").agg(F.count("*").alias("_pages"))
    counted = once.groupBy("_host", "_code").agg(F.count("*").alias("_n")).filter((F.col("_n") >= least_pages) & (F.col("_code") >= 0))
    often = (F.col("_n") >= enough_pages) | (F.col("_n") >= least_share * F.col("_pages"))
    recurring = cut(counted.join(sizes, "_host").filter(often).select("_code"))
    if recurring.count() <= broadcast_rows:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in recurring.toLocalIterator()))
        given = rows.select("_id", "_url", "_html", "_host", F.lit(None).cast("array<bigint>").alias("_marks"))
    else:
        shared = None
        own = printed.join(recurring, "_code").groupBy("_page").agg(F.collect_set("_code").alias("_marks"))
        given = rows.withColumn("_page", page_key).join(own, "_page", "left").select("_id", "_url", "_html", "_host", "_marks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                main_text(page, host, shared.value if shared else frozenset(own or ()))
                for page, host, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["_id", "_url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return given.mapInArrow(read, f"_id {kinds['_id']}, _url {kinds['_url']}, text string").withColumnsRenamed({"_id": id_col, "_url": url_col})
