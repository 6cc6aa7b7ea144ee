"""Composite indices, their sensitivity, gaps and the gates before publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def included(df: DataFrame, metric: str, entity: str, entities: int, has_direction: Column) -> DataFrame:
    """Metrics with a value in every entity and a direction."""
    return df.filter(F.col("value").isNotNull() & has_direction).groupBy(metric).agg(F.count_distinct(entity).alias("n")).filter(F.col("n") == entities).select(metric)


def weighted_composite(scaled: DataFrame, weights: DataFrame, entity: str, metric: str) -> DataFrame:
    """Score of each entity under each scenario: weighted mean of the scaled metrics. weights: scenario, metric, weight."""
    j = scaled.join(F.broadcast(weights), metric)
    return j.groupBy("scenario", entity).agg((F.sum(F.col("scaled") * F.col("weight")) / F.sum("weight")).alias("score"))


def bands(scores: DataFrame, group: str, entity: str, score: str, classes: int = 5) -> DataFrame:
    """Rank in each scenario, and the band: the class of rank / n."""
    w = Window.partitionBy(group)
    r = scores.withColumns({"rank": F.rank().over(w.orderBy(F.col(score).desc())).cast("long"), "n": F.count("*").over(w)})
    return r.withColumn("band", F.ceil(F.col("rank") * classes / F.col("n"))).drop("n")


def robustness(banded: DataFrame, entity: str) -> DataFrame:
    """Over all scenarios: best and worst rank and band, and whether the band moves by one at most."""
    s = banded.groupBy(entity).agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), F.min("band").alias("low_band"), F.max("band").alias("high_band"))
    return s.withColumns({"spread": F.col("worst") - F.col("best"), "steady": F.col("high_band") - F.col("low_band") <= 1})


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str, tie: str) -> DataFrame:
    """1 - 6 * sum(d^2) / (n * (n^2 - 1)) on ordinal ranks; null for fewer than two."""
    w = Window.partitionBy(*keys)
    r = pairs.withColumns({"rx": F.row_number().over(w.orderBy(F.desc(x), tie)), "ry": F.row_number().over(w.orderBy(F.desc(y), tie))})
    s = r.groupBy(*keys).agg(F.sum((F.col("rx") - F.col("ry")).cast("long") ** 2).cast("long").alias("d2"), F.count("*").alias("n"))
    n = F.col("n")
    return s.select(*keys, "n", "d2", F.when(n >= 2, 1 - (F.col("d2") * 6) / (n * (n * n - 1))).alias("rho"))


def gaps(df: DataFrame, metric: str, tier: str, value: str, up: Column) -> DataFrame:
    """Distance to the benchmark: the peers' median where a tier has two members or more, else the national one; and whether it is favourable."""
    nat = df.groupBy(metric).agg(F.median(value).alias("national"))
    peer = df.groupBy(metric, tier).agg(F.when(F.count("*") >= 2, F.median(value)).alias("peer"))
    j = df.join(nat, metric).join(peer, [metric, tier])
    j = j.withColumn("benchmark", F.coalesce("peer", "national"))
    gap = F.col(value) - F.col("benchmark")
    return j.withColumns({"gap": gap, "favourable": F.when(gap == 0, F.lit(None).cast("boolean")).when(up, gap > 0).otherwise(gap < 0)})


def pillars(wide: DataFrame, parts: list[str], cap: float = 100.0) -> DataFrame:
    """Mean of capped parts for complete cases only; else null with the list of what is missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parts]))
    score = sum((F.least(F.col(p), F.lit(cap)) for p in parts), F.lit(0.0)) / len(parts)
    return wide.withColumns({"missing": missing, "score": F.when(F.size(missing) == 0, score)})


def panel_gaps(df: DataFrame, entities: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected cells (each entity x each row of a fixed small table) that have no row."""
    return entities.crossJoin(F.broadcast(expected)).join(df.select(*keys).distinct(), keys, "left_anti")
