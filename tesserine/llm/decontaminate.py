"""Operator 2 (native): benchmark decontamination by spaced-seed hashing.

DataFrame functions only.  A seed is the hash of the tokens that a fixed mask
selects, so tokens at its ignored positions may differ.  Seeds of the corpus meet
those of the test items in a hash join; around each hit the two texts are aligned
and compared token by token, so substitutions cost agreement, not the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ("111011", "1101101", "10110011")
WINDOW = 20
AGREEMENT = 0.75
_SPLIT = "[\\x00-/:-@\\[-`{-\x7f]+"


def _hashes(text: Column) -> Column:
    """Hashes of the lower-case tokens: runs of characters other than ASCII space, punctuation and control characters.

    A text that starts or ends with such a character has an empty token there,
    which no test item has.
    """
    return F.transform(F.split(F.lower(text), _SPLIT), lambda x: F.xxhash64(x))


def _seeds(codes: str, at: str, masks: tuple[str, ...]) -> Column:
    """The seed of every mask at one position; null where the mask reaches beyond the end."""
    n = F.size(codes)
    out = []
    for k, mask in enumerate(masks):
        picks = [F.get(codes, F.col(at) + i) for i, bit in enumerate(mask) if bit == "1"]
        out.append(F.when(F.col(at) + len(mask) <= n, F.xxhash64(F.lit(k), *picks)))
    return F.array(*out)


def _seeded(rows: DataFrame, keep: list[str], masks: tuple[str, ...], margin: int, block: int = 1024) -> DataFrame:
    """A row for every position and mask of ``_codes``: ``keep``, ``_seed``, ``_at`` (in the text), ``_local`` and ``_part``.

    ``_part`` is the position's block of the text with ``margin`` tokens on either
    side, and ``_local`` the position in it: a row carries a bounded piece, however
    long its text is.
    """
    n, shortest = F.size("_codes"), min(map(len, masks))
    blocks = rows.select(*keep, "_codes", F.explode(F.when(n >= shortest, F.sequence(F.lit(0), F.expr(f"(size(_codes) - {shortest}) div {block}")))).alias("_block"))
    first = F.col("_block").cast("int") * block
    start = F.greatest(first - margin, F.lit(0))
    parts = blocks.select(*keep, start.alias("_start"), (first - start).alias("_lead"), F.slice("_codes", start + 1, F.lit(block + 2 * margin)).alias("_part"))
    last = F.least(F.col("_lead") + block - 1, F.size("_part") - shortest)
    at = parts.select(*keep, "_start", "_part", F.explode(F.sequence("_lead", last)).alias("_local"))
    seeds = at.select(*keep, (F.col("_start") + F.col("_local")).alias("_at"), "_local", "_part", F.explode(_seeds("_part", "_local", masks)).alias("_seed"))
    return seeds.filter(F.col("_seed").isNotNull())


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = WINDOW,
    agreement: float = AGREEMENT,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """Documents that repeat a test passage: ``id_col``, ``item_col``, ``n_equal``, ``n_window``, ``n_places``.

    A document and an item overlap if, on some alignment that shares a seed, some
    ``window`` consecutive item tokens (all, if the item has fewer) agree with the
    document at ``agreement`` of the positions or more.  One row per pair:
    ``n_equal`` of ``n_window`` tokens is the best agreement, ``n_places`` the
    number of alignments that qualify.

    Null and empty texts, and texts or items shorter than the shortest mask, match
    nothing.  Rows with one id count as one document; a null id or item is reported
    as null.  Repeated items give one row.  Other columns are ignored.

    The corpus is read once and never shuffled: the verified pairs alone are
    grouped.  The seeds of the items, each with its item's tokens, are broadcast while
    they number at most ``broadcast_rows`` and their tokens ten times that (160 MB);
    beyond that the join shuffles the texts' seeds, each with the part of the text
    around it.
    """
    split = F.trim(F.regexp_replace(F.lower(F.col(item_text_col)), _SPLIT, " "))
    items = benchmark.select(F.col(item_col).alias("_item"), F.transform(F.split(split, " "), lambda x: F.xxhash64(x)).alias("_codes"))
    longest = max(items.agg(F.max(F.size("_codes"))).first()[0] or 0, *map(len, masks))
    tests = _seeded(items.withColumn("_test", F.col("_codes")), ["_item", "_test"], masks, longest)
    seeds = tests.select("_seed", "_item", F.col("_at").alias("_item_at"), "_test").distinct()
    n, tokens = seeds.agg(F.count("*"), F.sum(F.size("_test"))).first()
    if n <= broadcast_rows and (tokens or 0) <= 10 * broadcast_rows:
        seeds = F.broadcast(seeds)
    rows = docs.select(F.col(id_col).alias("_id"), _hashes(F.col(text_col)).alias("_codes"))
    hits = _seeded(rows, ["_id"], masks, longest).join(seeds, "_seed").withColumn("_shift", F.col("_local") - F.col("_item_at"))

    span = F.least(F.size("_test"), F.lit(window))
    enough = F.ceil(span * F.lit(agreement))
    equal = F.transform("_test", lambda x, k: F.when(F.get("_part", F.col("_shift") + k) == x, 1).otherwise(0))
    added = lambda a, x: a + x
    sums = F.transform(F.sequence(F.lit(1), F.size("_test") - span + 1), lambda s: F.aggregate(F.slice(equal, s, span), F.lit(0), added))
    best = F.when(F.aggregate(equal, F.lit(0), added) >= enough, F.array_max(sums))
    scored = hits.select("_id", "_item", (F.col("_at") - F.col("_item_at")).alias("_from"), span.alias("_span"), best.alias("_best"))
    placed = scored.groupBy("_id", "_item", "_from").agg(F.max("_best").alias("_best"), F.max("_span").alias("_span"))
    good = placed.filter(F.col("_best") >= F.ceil(F.col("_span") * F.lit(agreement)))
    out = good.groupBy("_id", "_item").agg(F.max("_best").cast("long").alias("n_equal"), F.max("_span").cast("long").alias("n_window"), F.count("*").alias("n_places"))
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})
