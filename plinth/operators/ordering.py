"""A total order by several keys, by the rules of a locale, with numbers from 1 on and no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def by_locale(text: Column, collation: str = "UNICODE_CI") -> Column:
    """Text that compares as the collation says: accents and case by the locale's rules, not by code point."""
    return F.collate(text, collation)


def natural(text: Column) -> Column:
    """A key under which runs of digits compare as numbers: each is preceded by its length and loses leading zeros."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 4, "0"), digits(x))).otherwise(x)), "")


def numbered(df: DataFrame, order: list[Column], ways: int | None = None) -> DataFrame:
    """df with place: 1 for the first row in the order (which should tell all rows apart), and so on. Rows are dealt to ranges of the order and written;
    a row's place is that within its range after the sizes of the ranges before."""
    n = ways or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("t_part", F.spark_partition_id()))
    sizes = {r.t_part: r.n for r in dealt.groupBy("t_part").agg(F.count("*").alias("n")).collect()}
    before = [sum(m for q, m in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    within = F.row_number().over(Window.partitionBy("t_part").orderBy(*order))
    return dealt.select(*df.columns, (F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("t_part")) + within).alias("place"))
