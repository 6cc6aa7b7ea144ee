"""Allocation of whole numbers, and weights that must add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(df: DataFrame, parent: list[str], child: str, total: str, weight: str) -> DataFrame:
    """`allocated`: whole shares of each parent's total that add up to it exactly. Children get the floor of their share; what is left goes one
    each to the largest remainders, ties by child. Weights are whole numbers, so remainders are exact. A parent whose weights are all 0 is given null."""
    w = Window.partitionBy(*parent)
    product = F.col(total) * F.col(weight)
    d = df.withColumn("sum_w", F.sum(weight).over(w)).withColumns({"base": F.when(F.col("sum_w") > 0, F.floor(F.try_divide(product, F.col("sum_w")))), "rest": F.when(F.col("sum_w") > 0, product - F.floor(F.try_divide(product, F.col("sum_w"))) * F.col("sum_w"))})
    d = d.withColumns({"left": F.col(total) - F.sum("base").over(w), "place": F.row_number().over(w.orderBy(F.col("rest").desc(), child))})
    return d.withColumn("allocated", F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).drop("sum_w", "base", "rest", "left", "place")


def weight_violations(df: DataFrame, source: list[str], weight: str, tolerance: float) -> DataFrame:
    """Sources whose weights don't add up to 1."""
    s = df.groupBy(*source).agg(F.sum(weight).alias("total"))
    return s.filter(F.abs(F.col("total") - 1) > tolerance)
