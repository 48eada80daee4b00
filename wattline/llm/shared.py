"""Where operators put intermediate tables: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many ids (8 bytes each) are broadcast; more meet the other side in a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows a record batch of texts; the session's own setting holds where it is smaller.
BATCH_ROWS = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and Spark runs on one machine (tests, a laptop) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wattline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(ids: DataFrame, name: str) -> DataFrame:
    """A table of ids, stored and counted: marked for broadcast only if it is small enough."""
    ids = stored(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand texts to Python in record batches of at most ``BATCH_ROWS`` rows: a batch is held in the executor and in its worker, twice while it grows."""
    if not 0 < int(spark.conf.get(_BATCHES)) <= BATCH_ROWS:
        spark.conf.set(_BATCHES, str(BATCH_ROWS))


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be none of ``columns`` (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs but for the rows whose id is in ``gone``; null ids stay."""
    return docs.join(sized(gone.select(id_col).where(F.col(id_col).isNotNull()).distinct(), "gone"), id_col, "left_anti").select(*docs.columns)
