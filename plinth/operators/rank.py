"""Ranks, peer tiers, trends and series transforms. Every window is partitioned by metric, place or series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(rules: list[tuple[Column, str]]) -> Column:
    """Reason of the first rule that fails (a rule's column is true where it fails); null if none does. eligible is `reason IS NULL`."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in rules])


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rank: 1 + values above; percentile: share of values at or below, in percent; both within keys, null for null."""
    w = Window.partitionBy(*keys, F.col(value).isNull())
    has = F.col(value).isNotNull()
    return df.withColumns({"rank": F.when(has, F.rank().over(w.orderBy(F.col(value).desc())).cast("long")), "percentile": F.when(has, F.cume_dist().over(w.orderBy(F.col(value).asc())) * 100)})


def ranked_by_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same as `ranked` for groups of any size, from counts of distinct values; a value that a third of the rows has is joined back in parts."""
    from .stats import placed_values

    at = placed_values(df, keys, value)
    places = at.select(*keys, value, (F.col("n") - F.col("below") - F.col("same") + 1).alias("rank"), ((F.col("below") + F.col("same")) / F.col("n") * 100).alias("percentile"))
    return df.join(places, [*keys, value], "left")


def ranked_if_full(df: DataFrame, keys: list[str], value: str, all_: DataFrame) -> DataFrame:
    """rank: 1 + values above, only within groups that have as many rows as `all_` (one row, column all) says; else null."""
    whole = df.groupBy(*keys).agg(F.count("*").alias("all")).join(F.broadcast(all_), "all", "left_semi").select(*keys, F.lit(True).alias("whole"))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())).cast("long")
    return df.join(whole, keys, "left").withColumn("rank", F.when(F.col("whole"), rank)).drop("whole")


def directed(df: DataFrame, keys: list[str], value: str, higher_is_better: Column) -> DataFrame:
    """Rank by merit: descending where more is better, ascending where less is."""
    merit = F.when(higher_is_better, F.col(value)).otherwise(-F.col(value))
    return df.withColumn("merit_rank", F.rank().over(Window.partitionBy(*keys).orderBy(merit.desc())).cast("long"))


def median_gap(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    med = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return df.join(med, keys).withColumn("gap", F.col(value) - F.col("median"))


def peer_tiers(df: DataFrame, keys: list[str], value: str, bounded: bool = False) -> DataFrame:
    """tier 1 to 4 by cuts that are order statistics: the values at floor(n * k / 4); equal values share a tier. bounded: groups are known to have few rows."""
    from .stats import order_statistics

    n = F.col("n")
    cuts = order_statistics(df, keys, value, {f"cut{k}": F.floor(n * k / 4) for k in (1, 2, 3)}, bounded)
    j = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))
    v = F.col(value)
    return j.withColumn("tier", F.when(v <= F.col("cut1"), 1).when(v <= F.col("cut2"), 2).when(v <= F.col("cut3"), 3).otherwise(4).cast("long")).drop("cut1", "cut2", "cut3")


def peer_ranks(df: DataFrame, metric: str, tier: str, value: str) -> DataFrame:
    """National and peer rank, percentile and median of each metric."""
    nation = ranked(df, [metric], value).withColumnsRenamed({"rank": "national_rank", "percentile": "national_percentile"})
    peer = ranked(nation, [metric, tier], value).withColumnsRenamed({"rank": "peer_rank", "percentile": "peer_percentile"})
    nm = df.groupBy(metric).agg(F.median(value).alias("national_median"))
    pm = df.groupBy(metric, tier).agg(F.median(value).alias("peer_median"), F.count("*").alias("peers"))
    return peer.join(nm, metric).join(pm, [metric, tier])


def top_with_ties(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    return df.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())).cast("long")).filter(F.col("place") <= n)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("place") <= k)


def trend(df: DataFrame, keys: list[str], when: str, value: str, higher_is_better: Column) -> DataFrame:
    """One row a series: first and last value, change over all and over the last step, and a word for the direction
    (which only speaks of better or worse where the metric has a direction)."""
    ends = df.groupBy(*keys, higher_is_better.alias("hib")).agg(F.min_by(value, when).alias("first"), F.max_by(value, when).alias("last"), F.count("*").alias("n"))
    change = F.col("last") - F.col("first")
    word = F.when(F.col("n") < 2, "single").when(F.col("hib").isNull(), F.when(change > 0, "rising").when(change < 0, "falling").otherwise("flat"))
    word = word.when(change == 0, "stable").when((change > 0) == F.col("hib"), "improving").otherwise("worsening")
    return ends.select(*keys, "first", "last", "n", change.alias("change"), word.alias("direction"))


def lags(df: DataFrame, keys: list[str], when: str, value: str, steps: list[int]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(when)
    return df.withColumns({f"change_{k}": F.col(value) - F.lag(value, k).over(w) for k in steps})


def volatility(df: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """Population standard deviation of successive differences."""
    from .stats import spread_or_null

    d = lags(df, keys, when, value, [1])
    return d.groupBy(*keys).agg(spread_or_null(F.col("change_1").cast("double")).alias("volatility"), F.count("change_1").alias("steps"))


def break_flag(df: DataFrame, keys: list[str], when: str, mark: str) -> DataFrame:
    """Whether any row's mark differs from the first row's."""
    first = df.groupBy(*keys).agg(F.min_by(mark, when).alias("first_mark"), F.collect_set(mark).alias("marks"))
    return first.select(*keys, "first_mark", (F.size("marks") > 1).alias("broken"))


def transforms(df: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """change_pct, change_abs, and index_100 on the first value that isn't zero."""
    w = Window.partitionBy(*keys).orderBy(when)
    before, v = F.lag(value).over(w), F.col(value)
    base = F.first(F.when(v != 0, v), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({"change_abs": v - before, "change_pct": F.try_divide((v - before) * 100, before), "index_100": F.try_divide(v * 100, base)})


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers: first, last, length."""
    d = df.select(*keys, number).distinct()
    g = d.withColumn("island", F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number)))
    return g.groupBy(*keys, "island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("island")


def sequence_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Numbers missing between each group's least and greatest: only gaps are expanded, not the whole range."""
    d = df.select(*keys, number).distinct()
    nxt = d.withColumn("next", F.lead(number).over(Window.partitionBy(*keys).orderBy(number))).filter(F.col("next") - F.col(number) > 1)
    return nxt.select(*keys, F.explode(F.sequence(F.col(number) + 1, F.col("next") - 1)).alias("missing"))


def quantile_class(df: DataFrame, keys: list[str], value: str, classes: int = 5) -> DataFrame:
    cuts = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(i / classes) for i in range(1, classes)])).alias("q"))
    j = df.join(cuts, keys)
    return j.withColumn("class", F.size(F.filter("q", lambda c: c < F.col(value))).cast("long") + 1).drop("q")
