"""Aggregates with stated rules for ties, small groups and zero spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_or_null(value: Column) -> Column:
    """Population standard deviation; null for fewer than two values."""
    return F.when(F.count(value) >= 2, F.stddev_pop(value))


def placed_values(df: DataFrame, keys: list[str], value: str, cuts: int = 64) -> DataFrame:
    """keys, value, same, below, n: for each distinct value of a group, how many rows have it, how many are less, and the group's size; nulls are left out.
    No group is sorted in one task: rows are counted by value, which combines before the shuffle; the values of a group are dealt to buckets by cut points
    from a sketch (any cut points give the same result), and the counts before a value are those of the buckets before and of its own."""
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("same"))
    c = v.groupBy(*keys).agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 1000).alias("cuts"))
    j = v.join(c, keys) if keys else v.crossJoin(F.broadcast(c))  # without keys the cuts are one row
    b = j.withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col(value)))).drop("cuts")
    group = Window.partitionBy(*keys)
    per = b.groupBy(*keys, "bucket").agg(F.sum("same").alias("inside"))
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"offset": F.coalesce(F.sum("inside").over(before), F.lit(0)), "n": F.sum("inside").over(group)}).drop("inside")
    own = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    at = b.withColumn("less", F.coalesce(F.sum("same").over(own), F.lit(0))).join(per, [*keys, "bucket"])
    return at.select(*keys, value, "same", (F.col("offset") + F.col("less")).alias("below"), "n")


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column], bounded: bool = False) -> DataFrame:
    """The values at given 0-based places of each group's ascending order. picks: name -> place, an expression of n (the group's size).
    bounded: the caller knows that groups have few rows (places, years): they are sorted as arrays, in one shuffle."""
    if bounded:
        held = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("t_values")).withColumn("n", F.size("t_values"))
        return held.select(*keys, *[F.get("t_values", p.cast("int")).alias(k) for k, p in picks.items()])
    held = lambda p: (F.col("below") <= p) & (p < F.col("below") + F.col("same"))
    return placed_values(df, keys, value).groupBy(*keys).agg(*[F.min(F.when(held(p), F.col(value))).alias(k) for k, p in picks.items()])


def winsorised(df: DataFrame, keys: list[str], value: str, up: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """scaled: the value cut at two quantiles and put on 0 to 100, turned over where less is better; null where the quantiles are equal."""
    cuts = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"))
    j = df.join(cuts, keys)
    lo, hi = F.col("q")[0], F.col("q")[1]
    raw = F.try_divide((F.least(F.greatest(F.col(value).cast("double"), lo), hi) - lo) * 100, hi - lo)
    return j.withColumn("scaled", F.when(up, raw).otherwise(100 - raw)).drop("q")


def correlations(long: DataFrame, entity: str, name: str, value: str) -> DataFrame:
    """Pearson correlation of each pair of metrics over shared entities; null where one doesn't vary."""
    a, b = long.select(entity, F.col(name).alias("a"), F.col(value).cast("double").alias("x")), long.select(entity, F.col(name).alias("b"), F.col(value).cast("double").alias("y"))
    pairs = a.join(b, entity).filter("a < b")
    s = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.when((F.col("n") >= 2) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy")))
    return s.select("a", "b", "n", r.alias("r"), (F.abs(r) > 0.8).alias("multicollinear"))


def weighted_rate(rate: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(rate * weight), F.sum(weight))


def errors(observed: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE, and MAPE over the rows with a non-zero observation."""
    e = F.abs(predicted - observed)
    return {"mae": F.avg(e), "rmse": F.sqrt(F.avg((predicted - observed) ** 2)), "mape": F.avg(F.when(observed != 0, F.try_divide(e, F.abs(observed)) * 100))}


def buckets(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """Label of the first bound the value is below; the last label beyond all; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for b, label in zip(bounds, labels):
        out = out.when(value < b, label)
    return out.otherwise(labels[-1])


def majority(df: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The most frequent vote of each key, ties to the least, with its share and whether it has no rival."""
    per = df.groupBy(*keys, vote).agg(F.count("*").alias("n"))
    top = per.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(vote).alias("v"))).alias("b"), F.sum("n").alias("votes"), F.max("n").alias("most"))
    rivals = per.join(top.select(*keys, "most"), keys).filter("n = most").groupBy(*keys).agg(F.count("*").alias("leaders"))
    return top.join(rivals, keys).select(*keys, F.col("b.v").alias("winner"), (-F.col("b.m")).alias("n"), "votes", (F.col("leaders") == 1).alias("clear"))
