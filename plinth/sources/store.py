"""Tables written between the steps of an iteration, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where none is set and all runs in one process is it a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/plinth-shared").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table: cuts its lineage, and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/plinth-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
