"""Priority weights that learn from installations, kept as versions that a repeated batch cannot count twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.solar import WEIGHTS

#: The error from which weights change, the share they change by, and which weight rises and falls for which finding.
ERROR, RATE = 0.2, 0.1
RAISED = {"n_sufficiency": ("demand_match", "energy_label"), "n_roi": ("roof_potential", "cascade_impact")}
_SCHEMA = "version long, " + ", ".join(f"{k} double" for k in WEIGHTS) + ", deployments long, mean_error double"


def findings(deployments: DataFrame) -> DataFrame:
    """One row: deployments, their mean error, and how many with a large error did better than predicted in self-sufficiency and in payback.

    deployments: predicted and actual generation, roi_years and sufficiency. A row with a null among them is left out.
    """
    names = ("generation", "roi_years", "sufficiency")
    d = deployments.dropna(subset=[f"{side}_{n}" for side in ("predicted", "actual") for n in names])
    off = lambda n: F.abs(F.col(f"predicted_{n}") - F.col(f"actual_{n}")) / (F.col(f"actual_{n}") + 1e-6)
    error = (off("generation") + off("roi_years")) / 2
    large = F.round(error, 9) > ERROR
    return d.agg(F.count("*").alias("deployments"), F.avg(error).alias("mean_error"), F.count_if(large & (F.col("actual_sufficiency") > F.col("predicted_sufficiency"))).alias("n_sufficiency"), F.count_if(large & (F.col("actual_roi_years") < F.col("predicted_roi_years"))).alias("n_roi"))


def updated(weights: DataFrame, deployments: DataFrame, rate: float = RATE) -> DataFrame:
    """weights (one row) after all deployments.

    One deployment multiplies two weights for each finding and all are scaled back to a sum of 1. Factors commute and the scaling
    cancels, so any number of deployments in any order is the product of powers that the counts of ``findings`` give:
    an aggregate, not a walk.
    """
    j = weights.limit(1).drop("deployments", "mean_error").crossJoin(findings(deployments))  # one-row frames
    power = dict.fromkeys(WEIGHTS, F.lit(0.0))
    for count, (up, down) in RAISED.items():
        power[up] = power[up] + F.col(count) * F.log1p(F.lit(rate))
        power[down] = power[down] + F.col(count) * F.log1p(F.lit(-rate / 2))
    logs = {k: F.ln(F.col(k)) + power[k] for k in WEIGHTS}
    top = F.greatest(*logs.values())  # so that no power runs over
    j = j.select("*", *((F.exp(v - top)).alias(f"_{k}") for k, v in logs.items()))
    total = sum((F.col(f"_{k}") for k in WEIGHTS), F.lit(0.0))
    return j.select("version", *((F.col(f"_{k}") / total).alias(k) for k in WEIGHTS), "deployments", "mean_error")


def start(spark: SparkSession, path: str, weights: dict | None = None) -> None:
    """Version -1 of the table, unless the caller gives others the fixed weights; a start over an existing table only puts that version back."""
    w = weights or WEIGHTS
    row = spark.createDataFrame([(-1, *(float(w[k]) for k in WEIGHTS), 0, None)], _SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/v=-1")


def weights_before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """The newest version, or the newest before a batch: one row."""
    t = spark.read.schema(_SCHEMA + ", v long").option("basePath", path).parquet(path)
    if batch_id is not None:
        t = t.where(F.col("v") < batch_id)
    return t.orderBy(F.desc("version")).limit(1).drop("v")


def learn(path: str, rate: float = RATE):
    """For ``writeStream.foreachBatch``: batch n writes version n from the newest version before it.

    A batch that Spark runs again reads the same version and overwrites its own, so it changes nothing; a batch without
    deployments keeps the weights. Versions are one-row files in one folder each, so a half-written one is never read.
    """

    def batch(deployments: DataFrame, batch_id: int) -> None:
        spark = deployments.sparkSession
        new = updated(weights_before(spark, path, batch_id), deployments, rate).withColumn("version", F.lit(batch_id).cast("long"))
        new.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return batch
