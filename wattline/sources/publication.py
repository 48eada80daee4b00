"""Publishing ranked results, and an append-only log of what was computed from what."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import running

_RUN = "task string, created_at timestamp, inputs string, outputs string, status string, affected long"
#: The columns that each task publishes beside the rank, its program's totals, and the name of a program.
TASKS = {
    "solar": (("capacity", "score", "roi_years"), {"total_capacity_kwp": ("sum", "capacity"), "avg_roi_years": ("avg", "roi_years")}, "SOLAR"),
    "retrofit": (("savings", "cost"), {"total_investment": ("sum", "cost"), "total_savings_potential": ("sum", "savings"), "avg_savings": ("avg", "savings")}, "RETROFIT"),
    "electrification": (("hp_capacity",), {"total_hp_capacity": ("sum", "hp_capacity")}, "ELECTRIFICATION"),
    "battery": (("capacity", "score"), {"total_capacity_kwh": ("sum", "capacity"), "avg_value_score": ("avg", "score")}, "BATTERY"),
    "p2p": (("compatibility", "volume", "price", "value"), {"total_volume_kwh": ("sum", "volume"), "total_value_eur": ("sum", "value")}, "P2P"),
    "congestion": (("severity",), {"max_severity": ("max", "severity")}, "CONGESTION"),
    "thermal": (("heat_shared",), {"total_heat_shared": ("sum", "heat_shared")}, "THERMAL"),
}


def publish_ranked(results: DataFrame, task: str, by: str, key: str = "building_id") -> tuple[DataFrame, DataFrame]:
    """(ranked rows, one program row) of a task's results.

    The rank is by falling ``by`` (ties: smaller key) over all rows, in ranges and not in one task; each published column is named
    after the task. The program row has the number of rows and the task's totals. Upsert the rows into the buildings with
    ``tables.upsert``. Rows without ``by`` are not ranked and not published.
    """
    columns, totals, name = TASKS[task]
    r = running(results.where(F.col(by).isNotNull()).select(key, *dict.fromkeys([*columns, by])), [], by, key)
    rows = r.select(key, F.col("rank").alias(f"{task}_rank"), *(F.col(c).alias(f"{task}_{c}") for c in columns))
    one = results.where(F.col(by).isNotNull()).agg(F.count("*").alias("num"), *(getattr(F, f)(c).alias(k) for k, (f, c) in totals.items()))
    return rows, one.select(F.lit(name).alias("program"), "*")


def append_lineage(spark: SparkSession, path: str, run_id: str, task: str, inputs: dict, outputs: dict, affected: DataFrame, created_at: str) -> None:
    """Log a run: first the rows it affected (``id``), then the run itself, whose row commits both.

    Each run has a folder of its own under each of the two tables, so runs never touch each other's files; a run
    that is repeated under its id replaces what it had logged, and one that died between the two writes is not in the log.
    """
    ids = affected.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    ids.write.mode("overwrite").parquet(f"{path}/affected/run_id={run_id}")
    n = spark.read.schema("id string").parquet(f"{path}/affected/run_id={run_id}").agg(F.count("*").alias("affected"))
    said = [F.lit(task).alias("task"), F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(json.dumps(inputs, sort_keys=True)).alias("inputs"), F.lit(json.dumps(outputs, sort_keys=True)).alias("outputs"), F.lit("COMPLETED").alias("status")]
    n.select(*said, "affected").coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")


def lineage_history(spark: SparkSession, path: str, limit: int = 10, task: str | None = None) -> DataFrame:
    """The newest committed runs first (ties: run id)."""
    runs = spark.read.schema(_RUN + ", run_id string").option("basePath", f"{path}/runs").parquet(f"{path}/runs")
    return (runs.where(F.col("task") == task) if task else runs).orderBy(F.desc("created_at"), "run_id").limit(limit)


def affected_by(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, task, created_at, id): what each committed run affected."""
    runs = spark.read.schema(_RUN + ", run_id string").option("basePath", f"{path}/runs").parquet(f"{path}/runs")
    ids = spark.read.schema("id string, run_id string").option("basePath", f"{path}/affected").parquet(f"{path}/affected")
    return ids.join(runs.select("run_id", "task", "created_at"), "run_id").select("run_id", "task", "created_at", "id")
