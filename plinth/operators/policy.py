"""Policies as data: lookups with overrides and patterns, states by rule, records of decisions, and source chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def classified(df: DataFrame, code: str, words: Column, overrides: DataFrame, patterns: list[tuple[str, str]], default: str, out: str) -> DataFrame:
    """out: the class that `overrides` (code, class; a small fixed table) gives, else that of the first pattern which the words match, else the default."""
    low = F.lower(words)
    by_pattern = reduce(lambda c, p: c.when(low.rlike(p[0]), p[1]), patterns[1:], F.when(low.rlike(patterns[0][0]), patterns[0][1])).otherwise(default)
    given = overrides.select(F.col(overrides.columns[0]).alias(code), F.col(overrides.columns[1]).alias("given"))
    return df.join(F.broadcast(given), code, "left").withColumn(out, F.coalesce("given", by_pattern)).drop("given")


def ruled(df: DataFrame, code: str, rules: DataFrame) -> DataFrame:
    """The columns of a small fixed rule table by code; null where there is no rule."""
    return df.join(F.broadcast(rules), code, "left")


def publication_state(active: Column, lifecycle: Column) -> Column:
    low = F.lower(F.coalesce(lifecycle, F.lit("")))
    return F.when((low == "planned") | F.coalesce(~active, F.lit(False)), "planned").when(low == "sourced", "candidate").when((low == "active") | F.coalesce(active, F.lit(False)), "published").when(low == "", "unknown").otherwise(low)


def evidence_status(badge: Column, method: Column) -> Column:
    """From a badge letter and a method's name; no method is a direct one. The four states are fixed values."""
    b, m = F.upper(F.coalesce(badge, F.lit(""))), F.lower(F.coalesce(method, F.lit("direct")))
    return F.when(b == "E", "external_verified").when((b == "D") | m.contains("model"), "published_modelled").when(b.isin("B", "C") | (m != "direct"), "published_derived").otherwise("published_direct")


def decision_records(candidates: DataFrame, keys: list[str], value: str, lineage: str, tier: str, shown: int) -> DataFrame:
    """One record for each key with two distinct values and two lineages or more: the candidate of the best tier is selected (then the least lineage), and the
    first `shown` candidates are listed, with how many more there are. Candidates equal in all three are one; they are written, so that what is counted, chosen and listed comes from one reading of the source."""
    d = written(candidates.groupBy(*keys, tier, lineage, value).agg(F.count("*").alias("rows")))
    per = d.groupBy(*keys).agg(
        F.count_distinct(value).alias("n_values"), F.count_distinct(lineage).alias("lineages"), F.count("*").alias("candidates"), F.min(F.struct(tier, lineage, value)).alias("best"), F.max(tier).alias("worst_tier")
    ).filter("n_values >= 2 AND lineages >= 2")
    first = d.join(per.select(*keys), keys, "left_semi").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(tier, lineage, value))).filter(F.col("k") <= shown)
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in (tier, lineage, value)])
    listed = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x.t), "; ").alias("listed"))
    return per.join(listed, keys).select(
        *keys, "candidates", "lineages", "n_values", F.col(f"best.{tier}").alias("selected_tier"), F.col(f"best.{lineage}").alias("selected_lineage"), F.col(f"best.{value}").alias("selected_value"),
        "worst_tier", "listed", F.greatest(F.col("candidates") - shown, F.lit(0)).alias("suppressed"), F.when(F.col(f"best.{tier}") == F.col("worst_tier"), "medium").otherwise("high").alias("confidence"),
    )


def first_available(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of the first source that has any, with its name; rows of two sources are never mixed. One plan, no count on the driver:
    the least number of a source that has rows is a one-row table."""
    rows = reduce(DataFrame.unionByName, [df.withColumns({"source": F.lit(name), "nth": F.lit(i)}) for i, (name, df) in enumerate(sources)])
    return rows.join(F.broadcast(rows.agg(F.min("nth").alias("nth"))), "nth", "left_semi").drop("nth")
