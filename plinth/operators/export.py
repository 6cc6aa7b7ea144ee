"""Bundles, manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's values, nulls told apart from empty text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and order-free fingerprint of a table: equal for equal multisets of rows."""
    h = row_hash(df, columns)
    low = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(low).cast("string").alias("sum"), F.max(h).alias("greatest"))


def bundle_index(df: DataFrame, key: str, series: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(series).alias("series_count"), F.count("*").alias("observation_count"))


def bundles(obs: DataFrame, key: str, series: str, fields: list[str]) -> DataFrame:
    """One nested document a key: its series, each with its observations in order."""
    per = obs.groupBy(key, series).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("observations"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(series, "observations"))).alias("series"))


def write_bundles(df: DataFrame, path: str, *keys: str) -> None:
    """One folder of JSON a key (nested ones for several, such as level and code); a key's rows are brought together first, so each
    folder has one file unless it is large."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


def write_with_manifest(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Bundles, and beside them their manifest: each file with its rows' keys, size and SHA-256, in order of the files' names."""
    write_bundles(df, f"{path}/bundles", *keys)
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{path}/bundles")
    found = manifest(files).select(*[F.regexp_extract("path", f"/{k}=([^/]+)/", 1).alias(k) for k in keys], "file", "bytes", "sha256")
    found.orderBy(*keys, "file").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/manifest")
    return found


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, arrays joined by |."""
    flat = [F.array_join(c.name, "|").alias(c.name) if c.dataType.typeName() == "array" else F.col(c.name) for c in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """Rows of indented JSON, one document a row, parted by line feeds."""
    text = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def verified(files: DataFrame, stated: DataFrame) -> DataFrame:
    """file and finding: files (file, bytes, sha256) against what a manifest states of them."""
    j = files.select("file", F.col("bytes").alias("b"), F.col("sha256").alias("s")).join(stated.select("file", F.col("bytes").alias("sb"), F.col("sha256").alias("ss")), "file", "full_outer")
    finding = F.when(F.col("s").isNull(), "missing").when(F.col("ss").isNull(), "not in the manifest").when(F.col("b") != F.col("sb"), "bytes differ").when(F.col("s") != F.col("ss"), "checksum differs").otherwise("ok")
    return j.select("file", finding.alias("finding"))


def manifest(df: DataFrame) -> DataFrame:
    """Files of a binaryFile scan with size and SHA-256, in order of their names."""
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
