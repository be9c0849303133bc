"""Operator 11: source divergence audit.

Term counts of every (lang, source) group become exact integer shares.  Pairs of
sources are compared over the terms that occur; the many terms that occur in
neither come in as one baseline.  A group's leading terms are found by radix
selection: histograms over the values' bits give the value of the k-th place, and
ties there are told apart by their UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running
from .common import cut, release

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
SCALE_DIGITS = 3  # of 1000 each: shares are in billionths


def _slices(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's terms, a slice at a time; slices end where no term does."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def _packed(lang: str, docs: Counter, counts: dict[str, Counter]) -> pa.RecordBatch:
    """A row for each term of a lang: the documents that have it, and its sources with their counts side by side."""
    names = list(counts)
    sizes = [len(counts[s]) for s in names]
    terms = pa.array([t for s in names for t in counts[s]], pa.binary()).dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    n = np.fromiter((v for s in names for v in counts[s].values()), dtype=np.int64, count=len(codes))[order]
    source = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), sizes)[order]))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms.dictionary)))]).astype(np.int32))
    found = terms.dictionary
    columns = [pa.array([lang] * len(found), pa.string()), found, pa.array([docs[t] for t in found.to_pylist()], pa.int64()), pa.ListArray.from_arrays(offsets, source), pa.ListArray.from_arrays(offsets, pa.array(n))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "n_docs", "sources", "counts"])


def term_counts(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """``lang, term, n_docs, sources, counts`` from rows ``lang, source, text`` without nulls, combined inside each task.

    A row holds the counts of all sources that the task has met the term in.  A task holds about ``most``
    counts and those of one document; it hands them on and starts anew then, so a term can come more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        docs: dict[str, Counter] = {}
        counts: dict[str, dict[str, Counter]] = {}
        met = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                rows = _packed(lang, docs[lang], own)
                for at in range(0, rows.num_rows, 20_000):
                    yield rows.slice(at, 20_000)
            docs.clear()
            counts.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                own = counts.setdefault(langs[k], {}).setdefault(sources[k], Counter())
                have: set[bytes] = set()
                for terms in _slices(batch.column(2)[k].as_py().lower()):  # bytes: only A-Z change
                    own.update(terms)
                    have.update(terms)
                docs.setdefault(langs[k], Counter()).update(have)
                met += len(have)
                if met > most:  # an upper bound of what is held: look again
                    met = sum(len(c) for by in counts.values() for c in by.values())
                    if met > most // 2:
                        yield from hand_on()
                        met = 0
        yield from hand_on()

    found = rows.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, "lang string, term binary, n_docs long, sources array<string>, counts array<long>")
    return found.withColumn("term", F.col("term").cast("string"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10**9 * (count + 2) / (total + 2 * terms))``, three decimal digits at a time, so that no step leaves 64 bits."""
    whole = total + 2 * terms
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(SCALE_DIGITS):
        rest = rest * 1000
        out = out * 1000 + _div(rest, whole)
        rest = rest % whole
    return out + 1


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / (p + q))``; for shares of a billion it is below 2**30."""
    return _div((p - q) * (p - q), p + q)


def _beside(rows: DataFrame, small: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    return rows.join(F.broadcast(small) if broadcast else small, keys)


def thresholds(rows: DataFrame, group: list[str], value: str, item: str, k: int, bits: int = 30, digit: int = 10, broadcast: bool = True) -> DataFrame:
    """``_least, _last`` of each group: a row is among its group's first ``k`` if its value is above ``_least``, or equals it and its item is not after ``_last``.

    Values (0 up to ``2**bits``) are read from the highest bits down, ``digit`` at a
    time: a histogram of the digit among rows that share the digits found so far, at
    most ``2**digit`` counts a group, tells the digit of the ``k``-th value.  Ties
    at that value are then read at the first byte where the group's least and
    greatest tied items differ, until no more are left than there are places.
    No group's rows ever meet in one task.  Items are distinct inside a group.
    """
    found = None
    for shift in range(bits - digit, -1, -digit):
        live = rows if found is None else _beside(rows, found, group, broadcast).filter(F.shiftright(value, shift + digit) == F.col("_prefix"))
        carried = {"_prefix": F.lit(0).cast("long"), "_left": F.lit(k).cast("long")} if found is None else {"_prefix": F.first("_prefix"), "_left": F.first("_left")}
        counts = live.groupBy(*group, (F.shiftright(value, shift).bitwiseAND(2**digit - 1)).alias("_digit")).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in carried.items()])
        above = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.desc("_digit"))) - F.col("_n")
        reached = counts.withColumn("_above", above).filter(F.col("_above") < F.col("_left"))
        chosen = reached.groupBy(*group).agg(F.min(F.struct("_digit", "_above", "_prefix", "_left")).alias("_c"))
        found = cut(chosen.select(*group, (F.col("_c._prefix") * 2**digit + F.col("_c._digit")).alias("_prefix"), (F.col("_c._left") - F.col("_c._above")).alias("_left")))

    ties = _beside(rows, found, group, broadcast).filter(F.col(value) == F.col("_prefix")).select(*group, F.col(item).cast("binary").alias("_item"), "_prefix", "_left")
    done: list[DataFrame] = []
    while True:
        ends = cut(ties.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_item").alias("_lo"), F.max("_item").alias("_hi"), F.first("_prefix").alias("_prefix"), F.first("_left").alias("_left")))
        done.append(ends.filter(F.col("_n") <= F.col("_left")).select(*group, F.col("_prefix").alias("_least"), F.col("_hi").alias("_last")))
        tight = ends.filter(F.col("_n") > F.col("_left"))
        if tight.isEmpty():
            break
        steps = F.sequence(F.lit(1), F.length("_hi"))
        differs = F.exists(steps, lambda i: F.substring("_lo", i, F.lit(1)) != F.substring("_hi", i, F.lit(1)))
        byte = F.array_position(F.transform(steps, lambda i: F.substring("_lo", i, F.lit(1)) != F.substring("_hi", i, F.lit(1))), F.lit(True))
        spots = tight.filter(differs).select(*group, byte.cast("int").alias("_byte"))
        marked = _beside(ties, spots, group, broadcast).withColumn("_mark", F.substring("_item", F.col("_byte"), F.lit(1)))
        counts = marked.groupBy(*group, "_mark").agg(F.count("*").alias("_n"), F.first("_left").alias("_left"))
        before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_mark")) - F.col("_n")
        reached = counts.withColumn("_before", before).filter(F.col("_before") < F.col("_left"))
        chosen = reached.groupBy(*group).agg(F.max(F.struct("_mark", "_before", "_left")).alias("_c")).select(*group, F.col("_c._mark").alias("_kept"), (F.col("_c._left") - F.col("_c._before")).alias("_now"))
        ties = cut(_beside(marked, chosen, group, broadcast).filter(F.col("_mark") == F.col("_kept")).select(*group, "_item", "_prefix", F.col("_now").alias("_left")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def leading(rows: DataFrame, group: list[str], value: str, item: str, k: int, bits: int = 30, digit: int = 10, broadcast: bool = True) -> DataFrame:
    """The first ``k`` rows of each group, by descending value, then ascending UTF-8 item, with ``rank``."""
    bound = thresholds(rows, group, value, item, k, bits, digit, broadcast)
    own = F.col(item).cast("binary")
    first = _beside(rows, bound, group, broadcast).filter((F.col(value) > F.col("_least")) | ((F.col(value) == F.col("_least")) & (own <= F.col("_last"))))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), own))  # of k rows at most
    return first.withColumn("rank", place).drop("_least", "_last")


def _pairs(entries: DataFrame, groups: DataFrame, broadcast: bool) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of a lang's sources.

    The sum of gaps over all V terms is V gaps between the two baselines (the shares
    of a term with count 0), corrected at the terms of one source, and again at
    those of both.  Corrections at one source's terms depend on the share alone, so
    equal shares are counted first.  The join by term gives a row for every two
    sources that have it, which are summed inside the task.
    """
    mine = groups.select("lang", "source", F.col("p0").alias("p0_a"), "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p0_b"))
    apart = F.col("source") != F.col("item")
    base = _beside(mine, other, ["lang"], broadcast).filter(apart).select("lang", "source", "item", F.coalesce(F.col("terms") * gap(F.col("p0_a"), F.col("p0_b")), F.lit(0).cast("long")).alias("v"))
    alike = entries.groupBy("lang", "source", "p", F.col("p0").alias("p0_a")).agg(F.count("*").alias("m"))
    one = _beside(alike, other, ["lang"], broadcast).filter(apart)
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (gap(F.col("p"), F.col("p0_b")) - gap(F.col("p0_a"), F.col("p0_b")))).alias("v"))
    left = entries.select("lang", "term", "source", F.col("p").alias("p_a"), F.col("p0").alias("p0_a"))
    right = entries.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("p0").alias("p0_b"))
    a, b, a0, b0 = map(F.col, ("p_a", "p_b", "p0_a", "p0_b"))
    both = left.join(right, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    both = both.groupBy("lang", "source", "item").agg(F.sum(gap(a, b) - gap(a, b0) - gap(a0, b) + gap(a0, b0)).alias("v"))
    turned = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    parts = base.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, k: int = 10, few: int = 100_000) -> DataFrame:
    """How far the sources of each lang differ, and which terms mark each of them: ``lang, source, part, item, value, rank``.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII;
    a lang keeps those in at least ``least_docs`` of its documents.  Part ``pair``:
    every other source of the lang by descending divergence.  Part ``term``: the
    group's ``k`` leading terms among those with a larger share here than in the lang.

    Null texts, langs and sources count as ``''``.  A group without kept terms has
    pairs but no terms; a lang that keeps none has pairs of value 0.  Repeated rows
    count each.  An empty table gives no rows.  Other columns are ignored.  Texts are
    read once, whole, and never shuffled; groups are broadcast while they number at
    most ``few``.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    by_term = Window.partitionBy("lang", "term")
    found = term_counts(rows).repartition("lang", "term").withColumn("docs", F.sum("n_docs").over(by_term)).filter(F.col("docs") >= least_docs)
    each = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    summed = each.groupBy("lang", "term", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    known = summed.withColumn("in_lang", F.sum("n").over(by_term)).withColumn("opens", F.min("source").over(by_term) == F.col("source"))
    kept = cut(known.select("lang", "term", "source", "n", "in_lang", "opens"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("opens").cast("long")).alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("terms", none).alias("terms"), "lang_total")
    groups = cut(groups.withColumn("p0", F.when(F.col("terms") > 0, share(none, F.col("total"), F.when(F.col("terms") > 0, F.col("terms")).otherwise(1)))))
    broadcast = groups.count() <= few

    own = _beside(kept, groups, ["lang", "source"], broadcast)
    entries = cut(own.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"), "p0"))
    pairs = running(cut(_pairs(entries, groups, broadcast)), ["lang", "source"], [F.desc("value"), F.asc("item")], None, "ahead")
    marks = entries.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = leading(cut(marks), ["lang", "source"], "value", "item", k, broadcast=broadcast)
    shown = lambda x, part, rank: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.cast("int").alias("rank"))
    return shown(pairs, "pair", F.col("ahead") + 1).unionByName(shown(terms, "term", F.col("rank")))
