"""Ledgers: every expected cell with its disposition, reasons as a dictionary, and audits over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(entities: DataFrame, slots: DataFrame, cells: DataFrame, explicit: DataFrame, keys: list[str], rules: list[tuple[Column, str, str]]) -> DataFrame:
    """Entities x slots (a small fixed table), each with a status and a reason by the first that holds: a value in `cells`;
    an explicit state in `explicit` (keys, state, reason; unique by key); a structural rule (condition, status, reason); unavailable."""
    grid = entities.crossJoin(F.broadcast(slots))
    j = grid.join(cells, keys, "left").join(explicit, keys, "left")
    status = F.when(F.col("value").isNotNull(), "value").when(F.col("state").isNotNull(), F.col("state"))
    reason = F.when(F.col("value").isNotNull(), F.lit(None).cast("string")).when(F.col("state").isNotNull(), F.col("reason"))
    for holds, s, r in rules:
        status, reason = status.when(holds, s), reason.when(holds, r)
    return j.select(*keys, "value", status.otherwise("unavailable").alias("status"), reason.otherwise("no source publishes it").alias("reason"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def dictionary(df: DataFrame, column: str, prefix: str, width: int = 3) -> DataFrame:
    """id (prefix and number by sorted order) of each distinct value. The values are few: they are dealt to one group to be numbered."""
    d = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("cells"))
    at = F.row_number().over(Window.partitionBy(F.lit(prefix)).orderBy(column))
    return d.select(F.concat(F.lit(prefix), F.lpad(at.cast("string"), width, "0")).alias("id"), column, "cells")


def coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    s = df.groupBy(*keys).agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "value").alias("with_value"), F.count_if(F.col("status") == "unavailable").alias("unavailable"))
    return s.withColumn("full", F.col("cells") == F.col("with_value"))


def conflicts(df: DataFrame, keys: list[str], value: str, lineage: str) -> DataFrame:
    """Keys with two distinct values or more from two lineages or more."""
    s = df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.count_distinct(lineage).alias("n_lineages"), F.count("*").alias("candidates"))
    return s.filter("n_values >= 2 AND n_lineages >= 2")


def tranche(ranked: DataFrame, board: list[str], family: str, place: str, most_rows: int, most_families: int) -> DataFrame:
    """Greedy choice by place of at most most_rows rows from at most most_families families, where a row of a further family is skipped and
    the choice goes on. In closed form: the families are the first most_families by their best place; then the first rows of these."""
    f = ranked.groupBy(*board, family).agg(F.min(place).alias("best"))
    f = f.withColumn("k", F.row_number().over(Window.partitionBy(*board).orderBy("best"))).filter(F.col("k") <= most_families).select(*board, family)
    return ranked.join(f, [*board, family]).withColumn("k", F.row_number().over(Window.partitionBy(*board).orderBy(place))).filter(F.col("k") <= most_rows).drop("k")


def terminal_coverage(queue: DataFrame, states: DataFrame, key: str, state: str) -> DataFrame:
    """Per key a finding: open (queued, no state), conflicting (two states or more), extraneous (not queued), closed."""
    s = states.groupBy(key).agg(F.count_distinct(state).alias("n_states"))
    j = queue.select(key).distinct().withColumn("queued", F.lit(True)).join(s, key, "full_outer")
    return j.select(key, F.coalesce("n_states", F.lit(0)).cast("long").alias("n_states"), F.when(F.col("queued").isNull(), "extraneous").when(F.col("n_states").isNull(), "open").when(F.col("n_states") > 1, "conflicting").otherwise("closed").alias("finding"))
