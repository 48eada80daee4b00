"""Cluster memberships over time: (snapshot, building_id, cluster_id) and single assignments (building_id, cluster_id).

Overlaps come from equi-joins and counts keyed by building or cluster; no two clusters are compared
unless they share a building.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_and_last(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assignments of each building at its first and at its last snapshot."""
    g = m.groupBy("building_id").agg(F.min_by("cluster_id", "snapshot").alias("first"), F.max_by("cluster_id", "snapshot").alias("last"))
    return g.select("building_id", F.col("first").alias("cluster_id")), g.select("building_id", F.col("last").alias("cluster_id"))


def temporal_stability(m: DataFrame, last: int = 10) -> DataFrame:
    """Mean Jaccard index of a cluster's members with those of its previous snapshot, over its last snapshots."""
    of_cluster = Window.partitionBy("cluster_id").orderBy("snapshot")
    size = m.groupBy("cluster_id", "snapshot").agg(F.count("*").alias("n"))
    size = size.withColumns({"before": F.lag("snapshot").over(of_cluster), "n_before": F.lag("n").over(of_cluster)}).where("before IS NOT NULL")
    seen = m.withColumn("was", F.lag("snapshot").over(Window.partitionBy("cluster_id", "building_id").orderBy("snapshot")))
    both = seen.where("was IS NOT NULL").groupBy("cluster_id", "snapshot", F.col("was").alias("before")).agg(F.count("*").alias("shared"))
    j = size.join(both, ["cluster_id", "snapshot", "before"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    newest = Window.partitionBy("cluster_id").orderBy(F.desc("snapshot"))
    j = j.withColumns({"jaccard": F.col("shared") / (F.col("n") + F.col("n_before") - F.col("shared")), "rank": F.row_number().over(newest)})
    return j.where(F.col("rank") <= last).groupBy("cluster_id").agg(F.avg("jaccard").alias("stability"), F.count("*").alias("steps"))


def _overlaps(before: DataFrame, after: DataFrame) -> DataFrame:
    old, new = before.withColumnRenamed("cluster_id", "old_id"), after.withColumnRenamed("cluster_id", "new_id")
    return old.join(new, "building_id").groupBy("old_id", "new_id").agg(F.count("*").alias("shared"))


def _sizes(assignment: DataFrame, name: str) -> DataFrame:
    return assignment.groupBy(F.col("cluster_id").alias(f"{name}_id")).agg(F.count("*").alias(f"n_{name}"))


def cluster_matching(before: DataFrame, after: DataFrame, least: float = 0.7) -> DataFrame:
    """Old and new clusters that are each other's best match by Jaccard index (ties: smaller id)."""
    j = _overlaps(before, after).join(_sizes(before, "old"), "old_id").join(_sizes(after, "new"), "new_id")
    j = j.withColumn("jaccard", F.col("shared") / (F.col("n_old") + F.col("n_new") - F.col("shared")))
    best = lambda one, other: F.row_number().over(Window.partitionBy(one).orderBy(F.desc("jaccard"), other))
    j = j.withColumns({"a": best("old_id", "new_id"), "b": best("new_id", "old_id")}).where("a = 1 AND b = 1")
    return j.select("old_id", "new_id", "jaccard", (F.col("jaccard") > least).alias("same"))


def cluster_transition(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: share and number of changed buildings, clusters split below half, clusters gone."""
    moved = _overlaps(before, after).agg((F.sum(F.when(F.col("old_id") == F.col("new_id"), F.col("shared")).otherwise(0)) / F.sum("shared")).alias("stability"), F.sum(F.when(F.col("old_id") != F.col("new_id"), F.col("shared")).otherwise(0)).alias("changed"))
    parts = _overlaps(before, after).groupBy("old_id").agg(F.max("shared").alias("largest"))
    old, new = _sizes(before, "old"), _sizes(after, "new")
    split = old.join(parts, "old_id", "left").agg(F.count_if(F.coalesce("largest", F.lit(0)) < 0.5 * F.col("n_old")).alias("split"))
    gone = old.join(new, F.col("old_id") == F.col("new_id"), "left_anti").agg(F.count("*").alias("vanished"))
    return moved.crossJoin(split).crossJoin(gone)  # one-row frames


def split_by_group(assignment: DataFrame, groups: DataFrame, least: int = 3) -> DataFrame:
    """Clusters cut along LV groups; parts below ``least`` buildings go."""
    j = assignment.join(groups.select("building_id", "lv_group"), "building_id")
    kept = j.groupBy("cluster_id", "lv_group").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return j.join(kept, ["cluster_id", "lv_group"]).select("building_id", "cluster_id", "lv_group", "n")


def cluster_structure(assignment: DataFrame, groups: DataFrame, smallest: int = 3, largest: int = 20) -> DataFrame:
    """One row: sizes, shares of valid and single-building clusters and of clusters inside one LV group."""
    g = assignment.join(groups.select("building_id", "lv_group"), "building_id", "left").groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("lv_group").alias("lv"))
    share = lambda c: F.avg(c.cast("int"))
    return g.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("buildings"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("size_std"),
        share(F.col("n").between(smallest, largest)).alias("valid_share"), share(F.col("n") == 1).alias("single_share"), share(F.col("lv") <= 1).alias("lv_compliance"),
    )
