"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table up to which the rounds of an iteration broadcast it.
ROUND_BYTES = 1 << 16


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder; only where that is unset and Spark runs on one machine, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wattline-cc-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _checkpoint(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, so lineage stays short and lost executors are harmless."""
    path = fresh_folder(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark broadcasts only tables of at most ``ROUND_BYTES``: rounds are many, and what they send through the driver adds up."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    was = [spark.conf.get(k, None) for k in keys]
    for k in keys:
        spark.conf.set(k, str(ROUND_BYTES))
    try:
        yield
    finally:
        for k, v in zip(keys, was, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    A large-star step links every larger neighbour of a node to the node's smallest neighbour, a
    small-star step does so for the smaller ones; the edge set shrinks to stars in O(log n) rounds, so
    long chains do not need one round per hop. Each step is one aggregate and one join on the node;
    AQE splits the joins' hot nodes. Rows with a null end and self loops are no edges.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = _checkpoint(e)
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        e = _checkpoint(small)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("connected_components did not converge")
    leaf = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.union(e.select("v", "v").distinct())
