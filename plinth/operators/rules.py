"""Integrity rules. A rule is a function of frames that returns violations (rule, key, detail); rules report and reject nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    violations: Callable[[], DataFrame]


def found(df: DataFrame, key: list[str], detail: Column) -> DataFrame:
    return df.select(F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"), detail.cast("string").alias("detail"))


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    return found(df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), key, F.concat(F.col("n").cast("string"), F.lit(" rows")))


def foreign_key(df: DataFrame, key: list[str], column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    gone = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")
    return found(gone, key, F.concat(F.lit(f"{column} "), F.col(column).cast("string"), F.lit(" unknown")))


def member(df: DataFrame, key: list[str], column: str, allowed: list[str]) -> DataFrame:
    return found(df.filter(~F.col(column).isin(allowed)), key, F.col(column))


def forbidden(df: DataFrame, key: list[str], column: str, words: list[str]) -> DataFrame:
    return found(df.filter(F.lower(F.col(column)).isin(words)), key, F.col(column))


def holds(df: DataFrame, key: list[str], condition: Column, detail: Column) -> DataFrame:
    """Rows whose condition is false; null counts as held, as in a SQL check."""
    return found(df.filter(~condition), key, detail)


def required_if(df: DataFrame, key: list[str], when: Column, column: str) -> DataFrame:
    return found(df.filter(when & F.col(column).isNull()), key, F.lit(f"{column} is required"))


def exactly_one(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    return found(df.filter(F.col(a).isNull() == F.col(b).isNull()), key, F.lit(f"exactly one of {a}, {b}"))


def same_as_parent(child: DataFrame, key: list[str], link: str, copy: str, parent: DataFrame, parent_key: str, parent_column: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias(link), F.col(parent_column).alias("of_parent"))
    return found(child.join(p, link).filter(~F.col(copy).eqNullSafe(F.col("of_parent"))), key, F.concat_ws(" <> ", F.col(copy).cast("string"), F.col("of_parent").cast("string")))


def code_agrees(df: DataFrame, key: list[str], code: str, form: str, part: str, column: str) -> DataFrame:
    """Codes that are malformed, or of which a numeric part differs from the column it stands for."""
    well, said = F.col(code).rlike(form), F.nullif(F.regexp_extract(code, part, 1), F.lit("")).try_cast("int")
    bad = df.filter(~well | (said != F.col(column)))
    return found(bad, key, F.concat(F.col(code), F.when(~well, F.lit(" is malformed")).otherwise(F.concat(F.lit(" is not of "), F.col(column).cast("string")))))


def degenerate(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """Groups in which the label says nothing: fewer than two distinct ones."""
    per = df.groupBy(*group).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).filter("labels < 2")
    return found(per, group, F.concat(F.col("n").cast("string"), F.lit(" rows, one label")))


def check(rules: list[Rule]) -> DataFrame:
    """All violations of all rules."""
    return reduce(DataFrame.unionByName, [r.violations().select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "key", "detail") for r in rules])


def capped(violations: DataFrame, most: int) -> DataFrame:
    """A report: at most `most` violations of each rule, with how many more there are."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule")
    v = violations.withColumns({"k": F.row_number().over(w.orderBy("key", "detail")), "all": F.count("*").over(w)})
    return v.filter(F.col("k") <= most).withColumn("suppressed", F.greatest(F.col("all") - most, F.lit(0))).drop("k", "all")
