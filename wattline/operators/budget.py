"""Which interventions one budget for a whole region buys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _checkpoint
from .ranking import running

#: Multipliers tried in one pass over the items, and passes; each narrows the bracket by GRID + 1.
GRID, PASSES = 16, 7


def budgeted_mix(items: DataFrame, budget: float, group: str | None = None) -> tuple[DataFrame, float, float]:
    """(chosen items with rank, bound, gap): the items of largest total value that ``budget`` buys, and how far from the best that can be.

    items: item_id, value, cost (above 0), and the group of which at most one item is taken, if named. A price of money is
    sought at which what every group would rather buy costs just the budget: the Lagrangian's one multiplier, bracketed by
    passes over the items that try ``GRID`` prices at once, each a best item a group and one sum, both with partial
    sums on the map side. The smallest Lagrangian value seen bounds every selection that the budget allows (``bound``). The choice at
    the dearer end of the bracket fits the budget; the groups that would buy more at the cheaper end do so in order of
    extra value for extra cost (ties: smaller item_id), up to the first that does not fit. ``gap`` is bound less value; without
    groups it is below the value of one item. Rows without value or with no positive cost are left out.
    """
    rows = items.where("value IS NOT NULL AND value > 0 AND cost > 0").select("item_id", F.col("value").cast("double").alias("value"), F.col("cost").cast("double").alias("cost"), F.col(group or "item_id").alias("g"))
    rows = _checkpoint(rows)
    top = rows.agg(F.max(F.col("value") / F.col("cost")).alias("r")).first().r
    if top is None:
        return rows.limit(0).select("item_id", "g", "value", "cost", F.lit(0).cast("long").alias("rank")), 0.0, 0.0
    bound = float("inf")

    def tried(prices: list[float]) -> list[tuple[float, float]]:
        """(cost, Lagrangian value) at each price; of a group's equally good items the cheapest, none if none pays."""
        offers = [F.struct((F.col("value") - p * F.col("cost")).alias("net"), (-F.col("cost")).alias("c")) for p in prices]
        if group:
            best = rows.groupBy("g").agg(*(F.max(o).alias(f"b{i}") for i, o in enumerate(offers)))
        else:  # every item is a group: nothing to shuffle
            best = rows.select(*(o.alias(f"b{i}") for i, o in enumerate(offers)))
        some = lambda i, x: F.sum(F.when(F.col(f"b{i}.net") > 0, x).otherwise(0.0))
        r = best.agg(*(c for i in range(len(prices)) for c in (some(i, -F.col(f"b{i}.c")).alias(f"c{i}"), some(i, F.col(f"b{i}.net")).alias(f"n{i}")))).first()
        return [(r[f"c{i}"], p * budget + r[f"n{i}"]) for i, p in enumerate(prices)]

    low, high = 0.0, float(top) * (1 + 1e-12) + 1e-12
    first = tried([low])[0]
    bound = first[1]
    if first[0] > budget:
        for _ in range(PASSES):
            step = (high - low) / (GRID + 1)
            prices = [low + step * (k + 1) for k in range(GRID)]
            seen = tried(prices)
            bound = min(bound, *(x[1] for x in seen))
            fits = [p for p, (cost, _) in zip(prices, seen, strict=True) if cost <= budget]
            high = min([high, *fits])
            low = max([low, *(p for p in prices if p < high)])
            if high - low <= 1e-15 * high:
                break
    else:
        high = low

    def choice(price: float) -> DataFrame:
        net = F.col("value") - price * F.col("cost")
        if not group:
            return rows.where(net > 0).select("g", "item_id", "value", "cost")
        best = rows.groupBy("g").agg(F.max(F.struct(net.alias("net"), (-F.col("cost")).alias("c"), "value", "item_id")).alias("b"))
        return best.where("b.net > 0").select("g", "b.item_id", "b.value", (-F.col("b.c")).alias("cost"))

    kept = _checkpoint(choice(high))
    spent = kept.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).first().c
    was = kept.select("g", F.col("item_id").alias("_id"), F.col("value").alias("_v"), F.col("cost").alias("_c"))
    more = choice(low).join(was, "g", "left").where("_id IS NULL OR item_id <> _id").withColumns({"dc": F.col("cost") - F.coalesce("_c", F.lit(0.0)), "dv": F.col("value") - F.coalesce("_v", F.lit(0.0))}).where("dc > 0 AND dv > 0")
    more = _checkpoint(more.withColumn("_ratio", F.round(F.col("dv") / F.col("dc"), 9)))
    added = _checkpoint(running(more, [], "_ratio", "item_id", "dc").where(F.col("upto") <= budget - spent + 1e-9).select("g", "item_id", "value", "cost"))
    chosen = _checkpoint(kept.join(added.select("g"), "g", "left_anti").unionByName(added))
    value = chosen.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("v")).first().v
    out = running(chosen.withColumn("_r", F.round(F.col("value") / F.col("cost"), 9)), [], "_r", "item_id", "cost")
    return out.select("item_id", "g", "value", "cost", "rank", F.when(F.col("upto") <= budget / 3, 1).when(F.col("upto") <= 2 * budget / 3, 2).otherwise(3).alias("phase")), bound, max(0.0, bound - value)


def regional_mix(items: DataFrame, budget: float, group: str | None = None) -> DataFrame:
    """``budgeted_mix`` with bound and gap as columns."""
    chosen, bound, gap = budgeted_mix(items, budget, group)
    return chosen.withColumns({"bound": F.lit(bound), "gap": F.lit(gap)})
