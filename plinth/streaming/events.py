"""Structured Streaming forms of the versioned tables (an extension: the batch operators are the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, when: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Tumbling counts and sums; rows later than the watermark are dropped and closed windows leave the state."""
    return events.withWatermark(when, late).groupBy(F.window(when, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def first_versions(events: DataFrame, when: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark: replays of an observation are dropped with bounded state."""
    return events.withWatermark(when, late).dropDuplicatesWithinWatermark(keys)


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The versions of a table that were written to the end, oldest first. The path may be in any store that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return [(n, f"{path}/v{n}") for n in numbers if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}/_SUCCESS"))]


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest whole version."""
    return spark.read.schema(schema).parquet(versions(spark, path)[-1][1])


def upsert_sink(path: str, key: str, order: str):
    """foreachBatch function: keeps the newest row of each key in a Parquet table. Each batch writes a version of its own beside the last whole one, whatever
    the stream's batch number is, so a failed batch leaves the last one as it was and a new checkpoint goes on with an old table. A replayed batch
    changes nothing. The version before the last is kept for readers; older ones are removed."""
    from ..operators.temporal import best

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        there = versions(spark, path)
        rows = spark.read.schema(batch.schema).parquet(there[-1][1]).unionByName(batch) if there else batch
        new = there[-1][0] + 1 if there else 0
        best(rows, [key], [F.col(order)], [c for c in batch.columns if c != key]).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{new}")
        for _, old in there[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return put
