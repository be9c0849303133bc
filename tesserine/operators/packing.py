"""Order-dependent packing of context items under token budgets, and confidence scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONATES, RECEIVES = 0.3, 0.9


def pack_group(items: pd.DataFrame, budgets: dict[str, int], cap: int) -> pd.DataFrame:
    """Fill each slot by score, skipping what doesn't fit; slots little used give their rest to full ones; then a hard cap.

    ``items``: ``item_id, slot, score, tokens``; ties go by id.
    """
    kept = fill_slots(items, budgets)
    return kept[kept["tokens"].cumsum() <= cap]


def fill_slots(items: pd.DataFrame, budgets: dict[str, int]) -> pd.DataFrame:
    """What the slots take, best first, before the hard cap."""
    items = items.sort_values(["score", "item_id"], ascending=[False, True], kind="stable")
    budget = dict(budgets)
    taken: dict[str, list[int]] = {}

    def fill(slot: str) -> int:
        used, chosen = 0, []
        own = items[items["slot"] == slot]
        for i, tokens in zip(own.index, own["tokens"], strict=True):
            if used + tokens <= budget[slot]:
                used += tokens
                chosen.append(i)
        taken[slot] = chosen
        return used

    used = {slot: fill(slot) for slot in budget}
    spare = sum(budget[s] - used[s] for s in budget if used[s] < DONATES * budget[s])
    full = [s for s in budget if used[s] >= RECEIVES * budget[s]]
    if full and spare:
        for s in budget:
            if used[s] < DONATES * budget[s]:
                budget[s] = used[s]
        for s in full:
            budget[s] += spare // len(full)
            used[s] = fill(s)
    return items.loc[[i for own in taken.values() for i in own]].sort_values(["score", "item_id"], ascending=[False, True], kind="stable")


def pack(items: DataFrame, budgets: dict[str, int], cap: int) -> DataFrame:
    """``query_id, item_id, slot, score, tokens`` that fit, query by query (greedy with skips is no running sum).

    A size once refused never fits again, so of each size only the best ``total
    budget / tokens`` items of a slot can be taken, and only these are grouped.
    Items without tokens always fit their slot; they stay out of the groups and go
    only where the hard cap came before them.
    """
    columns = ["query_id", "item_id", "slot", "score", "tokens"]
    own = items.select(*columns).filter(F.col("slot").isin(*budgets))
    rank = F.row_number().over(Window.partitionBy("query_id", "slot", "tokens").orderBy(F.desc_nulls_last("score"), "item_id"))
    few = own.filter(F.col("tokens") > 0).withColumn("_r", rank).filter(F.col("_r") * F.col("tokens") <= sum(budgets.values())).drop("_r")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        taken = fill_slots(group, budgets)
        over = taken["tokens"].cumsum() > cap
        return pd.concat([taken[~over], taken[over].head(1)])[columns].assign(_over=[False] * int((~over).sum()) + [True] * int(over.any()))

    packed = few.groupBy("query_id").applyInPandas(one, few.select(*columns, F.lit(False).alias("_over")).schema)
    first = packed.filter("_over").select(F.col("query_id").alias("_q"), F.col("score").alias("_s"), F.col("item_id").alias("_i"))
    zero = own.filter(F.col("tokens") == 0).join(first, F.col("query_id").eqNullSafe(F.col("_q")), "left")
    before = F.expr("_i is null or score > _s or (score is not null and _s is null) or (score <=> _s and item_id < _i)")
    return packed.filter("not _over").select(*columns).unionByName(zero.filter(before).select(*columns))


def running_budget(items: DataFrame, budget: int) -> DataFrame:
    """Admit items in order until the window is full; the one that crosses the budget is cut to what is left."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("query_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    return items.withColumn("admitted", F.least("tokens", left)).filter(F.col("admitted") > 0)


def confidence(signals: DataFrame, weights: dict[str, int], base: int = 20) -> DataFrame:
    """``response_id, score, route``: base plus weights (whole if true, a clamped share if numeric), clipped to 0..100.

    ``signals``: ``response_id, signal, bool_value, num_value``; unknown signals count
    nothing; numbers truncate toward zero.
    """
    names = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    weight = F.coalesce(F.try_element_at(names, F.col("signal")), F.lit(0))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("num_value")))
    part = F.when(F.col("bool_value"), weight).when(F.col("num_value").isNotNull(), (weight * share).cast("int")).otherwise(0)
    total = signals.groupBy("response_id").agg(F.least(F.lit(100), F.greatest(F.lit(0), base + F.sum(part))).cast("long").alias("score"))
    return total.withColumn("route", route(F.col("score")))


def route(score: Column) -> Column:
    return F.when(score >= 80, "AUTO").when(score >= 50, "QUICK").otherwise("FULL")


def take_in_order(items: DataFrame, budget: int, order: str = "item_id", query: str = "query_id", tokens: str = "tokens") -> DataFrame:
    """The items that a single queue takes: each in ``order`` if it still fits the budget, else it is skipped.

    Of each size only the first ``budget / size`` items can be taken, so only these
    are grouped, whatever a query's number of items; items without tokens always fit.
    """
    rank = F.row_number().over(Window.partitionBy(query, tokens).orderBy(order))
    able = items.filter((F.col(tokens) > 0) & (F.col(tokens) <= budget)).select(query, order, tokens).withColumn("_r", rank).filter(F.col("_r") <= F.floor(F.lit(budget) / F.col(tokens))).drop("_r")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        for size in own.sort_values(order, kind="stable")[tokens]:
            kept.append(size <= left)
            left -= size if kept[-1] else 0
        return own.sort_values(order, kind="stable")[kept][[query, order]]

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    taken = able.groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, {order} {kinds[order]}")
    return items.join(taken, [query, order], "left_semi").unionByName(items.filter(F.col(tokens) == 0))
