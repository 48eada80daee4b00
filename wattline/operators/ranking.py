"""Ranks and running sums over one order of many rows, without one task that holds them all.

Quantiles of the value cut the order into ranges; each range is ordered by a task of its own and offset by what the ranges
before it hold. The quantiles may be approximate: they only balance the tasks. They come out differently when they are
computed again from blocks in another order, so each row's range is stored once and both counted and ranked from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import _checkpoint

RANGES = 64


def running(df: DataFrame, by: list[str], value: str, tie: str, amount: str | None = None) -> DataFrame:
    """df with ``rank`` (1 is the largest value; ties: smaller tie) and, of an amount, ``before`` and ``upto``, its sums over the rows before and with each."""
    rest = df.columns
    keys = by or ["_all"]
    d = df if by else df.withColumn("_all", F.lit(1))
    edges = d.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10000).alias("_e"))
    d = _checkpoint(d.join(edges, keys).withColumn("_part", F.size(F.filter("_e", lambda x: x > F.col(value)))).drop("_e"))
    sums = [F.count("*").alias("_k"), *([F.sum(amount).alias("_s")] if amount else [])]
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*keys, "_part").agg(*sums)  # RANGES rows a key
    before = before.select(*keys, "_part", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_k0"), *([F.coalesce(F.sum("_s").over(ahead), F.lit(0.0)).alias("_s0")] if amount else []))
    own = Window.partitionBy(*keys, "_part").orderBy(F.desc(value), tie)
    out = d.withColumn("_n", F.row_number().over(own))
    if amount:
        out = out.withColumn("_u", F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(before, [*keys, "_part"])
    more = [(F.col("_s0") + F.col("_u") - F.col(amount)).alias("before"), (F.col("_s0") + F.col("_u")).alias("upto")] if amount else []
    return out.select(*rest, (F.col("_k0") + F.col("_n")).alias("rank"), *more)
