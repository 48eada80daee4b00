"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sampled_ids(rows: DataFrame, by: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, by): for each value of ``by`` the ``most`` ids with the smallest hash.

    A count per value gives a hash bound under which ``most`` ids lie with 8 standard deviations to
    spare, so ranking a frequent value sees a bounded number of rows however many it has.
    """
    ids = rows.select(id_col, by).where(F.col(id_col).isNotNull() & F.col(by).isNotNull()).distinct()
    ids = ids.withColumn("_hash", F.xxhash64(id_col, F.lit(17)))
    bounds = ids.groupBy(by).agg((F.lit(most + 8 * most**0.5 + 64) / F.count("*")).alias("_bound"))
    low = ids.join(bounds, by).where(F.col("_hash").cast("double") / 2.0**64 + 0.5 <= F.col("_bound"))
    w = Window.partitionBy(by).orderBy("_hash", id_col)
    return low.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).select(id_col, by)
