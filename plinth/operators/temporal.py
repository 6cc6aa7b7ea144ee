"""Versions of observations: what is active, latest, chosen, canonical; what changed between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None, largest: bool = True) -> DataFrame:
    """The row of each key with the largest (or least) order. An aggregation of structs: it combines before the shuffle and
    never sorts a group. Ties go by the order's last members, so make these unique."""
    keep = keep or [c for c in df.columns if c not in keys]
    pick = F.max if largest else F.min
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(pick(F.struct(o.alias("o"), F.struct(*keep).alias("row"))).alias("b")).select(*keys, "b.row.*")


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return best(df, keys, [F.col(c) for c in by])


def active(df: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no row supersedes. A target that doesn't exist is ignored."""
    gone = df.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return df.join(gone, key, "left_anti")


def revisions(df: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that some row supersedes."""
    return df.join(df.select(F.col(supersedes).alias(key)), key, "left_semi")


def pinned_or_latest(df: DataFrame, keys: list[str], by: list[str], pinned: Column) -> DataFrame:
    """A pinned row wins if there is one; else the latest."""
    return best(df, keys, [F.coalesce(pinned, F.lit(False)), *[F.col(c) for c in by]])


def choose_series(obs: DataFrame, entity: list[str], series: str, when: str) -> DataFrame:
    """One series for each entity: the newest, then the longest, then the least code."""
    per = obs.groupBy(*entity, series).agg(F.max(when).alias("newest"), F.count("*").alias("n"))
    return best(per.withColumns({"minus_newest": -F.col("newest"), "minus_n": -F.col("n")}), entity, [F.col("minus_newest"), F.col("minus_n"), F.col(series)], [series, "newest", "n"], largest=False)


def canonical(df: DataFrame, keys: list[str], superseded: Column, published: list[str]) -> DataFrame:
    """Of each period: a row that isn't superseded if there is one, then the one published last."""
    return best(df, keys, [(~superseded).cast("int"), *[F.col(c) for c in published]])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either snapshot with its state: new, gone, changed, unchanged."""
    o, n = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    j = o.withColumn("in_old", F.lit(True)).join(n.withColumn("in_new", F.lit(True)), key, "full_outer")
    state = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return j.select(key, "old", "new", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones by key; null fields of a new row keep the old value."""
    both = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in both])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_prefix(old: DataFrame, new: DataFrame, key: str, prefix: str) -> DataFrame:
    """Delete the rows whose key starts with the prefix, then insert: an idempotent replace."""
    return old.filter(~F.col(key).startswith(prefix) | F.col(key).isNull()).unionByName(new, allowMissingColumns=True)


def clone_insert(old: DataFrame, new: DataFrame, series: str, order: list[str], fields: list[str]) -> DataFrame:
    """New rows take the fields they lack from the first row of their series."""
    template = best(old, [series], [F.col(c) for c in order], fields, largest=False)
    return old.unionByName(new.join(template, series, "inner").select(*old.columns))


def lookback(df: DataFrame, keys: list[str], when: str, span: int, at_least: int) -> DataFrame:
    """Rows within `span` of the group's last; where these are fewer than at_least, the last at_least rows."""
    w = Window.partitionBy(*keys)
    back = F.row_number().over(w.orderBy(F.col(when).desc()))
    inside = F.col(when) >= F.max(when).over(w) - span
    marked = df.withColumns({"in_span": inside, "back": back})
    n = F.sum(F.col("in_span").cast("int")).over(w)
    return marked.withColumn("n_in", n).filter(F.col("in_span") | ((F.col("n_in") < at_least) & (F.col("back") <= at_least))).drop("in_span", "back", "n_in")


def asof(left: DataFrame, right: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """Each left row with the right value at or before it: one union, one sort by key and time."""
    both = left.withColumns({"is_left": F.lit(1), "v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(*keys, when, F.lit(0).alias("is_left"), F.col(value).alias("v")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(when, "is_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("asof", F.last("v", ignorenulls=True).over(w)).filter("is_left = 1").drop("is_left", "v")
