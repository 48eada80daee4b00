"""Readers and writers of the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.spatial import wkt_points

#: The columns of the two network files.
NETWORKS = "id string, component_id int, x double, y double, mv_transformer_id string, capacity_kva int, geometry string"
TRANSFORMERS = "id string, x double, y double, capacity_kva int, substation_id string, geometry string"


def read_energy_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Parquet profiles; an integer timestamp is epoch milliseconds."""
    df = spark.read.parquet(path)
    return df.withColumn("timestamp", F.timestamp_millis("timestamp")) if dict(df.dtypes).get("timestamp") in ("bigint", "int") else df


def read_network_csv(spark: SparkSession, path: str, schema: str = NETWORKS) -> DataFrame:
    """LV networks, or with ``TRANSFORMERS`` the transformers, with schema's columns; x and y come from the WKT column where they are missing.

    Columns are found by their name in the header, whatever their order; others are ignored and missing ones are null. A value
    that is not of its column's type is null.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    have = {c.lower(): c for c in df.columns}
    fields = StructType.fromDDL(schema).fields
    df = df.select(*((F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))
    at = wkt_points(df.withColumns({"_x": F.col("x"), "_y": F.col("y")}), "geometry")  # its x and y are those of the text
    return at.withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).drop("_x", "_y")


def read_relational(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A JDBC table with its decimals as doubles."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def read_metric_history(spark: SparkSession, path: str, since: str) -> DataFrame:
    """JSON snapshots whose file name holds a yyyyMMdd_HHmmss stamp from ``since`` (a date) on."""
    stamp = F.to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]{8}_[0-9]{6})", 1), "yyyyMMdd_HHmmss")
    return spark.read.json(path).withColumn("snapshot", stamp).where(F.col("snapshot") >= F.lit(since).cast("timestamp"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with source's rows put in by key: non-null source values win."""
    rest = [c for c in target.columns if c not in keys]
    s = source.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in rest if c in source.columns))
    return target.join(s, keys, "full").select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) if c in source.columns else F.col(c) for c in rest))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def layer_counts(**tables: DataFrame) -> DataFrame:
    """(layer, n) of all tables."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("layer"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
