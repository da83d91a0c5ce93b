"""Helpers shared by the operators: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, a folder beside the warehouse serves, which they share too. It is never a machine's own
    temporary folder: on a cluster without a shared warehouse, set ``spark.checkpoint.dir``.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("livetext.shared.dir", None)
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = warehouse.rstrip("/") + "/_livetext"
        spark.conf.set("livetext.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/livetext/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives a lost
    executor and gives later joins true sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing lazy reads it any more."""
    delete_path(df.sparkSession, df._written_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts make Arrow batches large, so hold fewer rows in each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def whole(col: str):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))
