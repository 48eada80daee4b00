"""Energy states as a fact table by day, joined with its time slots and buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import _checkpoint
from ..operators.profiles import timeslots

#: Up to so many ids stand in the scan's own filter; more are a table whose values reach the scan at run time.
LISTED = 1000
#: Up to so many slots (a century of hours has fewer) are broadcast, once stored and counted.
SLOTS = 1_000_000


def write_states(states: DataFrame, path: str, files_a_day: int = 1) -> None:
    """states (building_id, ts, ...) as Parquet by day, sorted by building inside each file so that its row groups can be skipped."""
    s = states.withColumn("day", F.to_date("ts"))
    part = F.pmod(F.xxhash64("building_id"), F.lit(files_a_day))
    s.repartition("day", part).sortWithinPartitions("day", "building_id", "ts").write.mode("overwrite").partitionBy("day").parquet(path)


def days_of(slots: DataFrame) -> DataFrame:
    """A time-slot dimension (slot_id, ts, year, month, ...) with the day that the fact is partitioned by."""
    return slots.withColumn("day", F.to_date(F.to_timestamp("slot_id", "yyyyMMdd_HHmm")))


def star_join(spark: SparkSession, path: str, slots: DataFrame, buildings: DataFrame, ids: list | DataFrame | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The fact's rows with their slot's and building's columns.

    slots: slot_id (yyyyMMdd_HHmm of the full hour) and any columns, filtered as wished: their days prune the fact's partitions at run time. buildings: building_id and any
    columns. They are stored and counted first. ids: a list, or a frame with building_id. since and until (timestamps, until excluded) become a filter on the partitions and on the rows. A
    state without a building or a slot in the dimensions is left out.
    """
    f = spark.read.parquet(path)
    if since is not None:
        f = f.where((F.col("day") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since).cast("timestamp")))
    if until is not None:
        f = f.where((F.col("day") <= F.to_date(F.lit(until))) & (F.col("ts") < F.lit(until).cast("timestamp")))
    b = buildings
    if isinstance(ids, list) and len(ids) <= LISTED:
        f = f.where(F.col("building_id").isin(ids))
    elif ids is not None:
        listed = spark.createDataFrame([(i,) for i in ids], "building_id long") if isinstance(ids, list) else ids.select("building_id").distinct()
        b = b.join(listed, "building_id", "left_semi")
    f = f.withColumn("slot_id", F.date_format("ts", "yyyyMMdd_HH00"))
    s = _checkpoint(days_of(slots)).where(F.col("slot_id") > "")  # Spark prunes by a dimension only if that is filtered
    s = F.broadcast(s) if s.count() <= SLOTS else s  # its days then reach the scan before it starts
    return f.join(s.drop(*(c for c in s.columns if c in f.columns and c not in ("slot_id", "day"))), ["day", "slot_id"]).join(b.drop(*(c for c in b.columns if c in f.columns and c != "building_id")), "building_id")


def slots_of(states: DataFrame) -> DataFrame:
    """The hours that states fall in, as a dimension."""
    return timeslots(states)
