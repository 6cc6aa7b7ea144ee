"""Base views over the driver's tables, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What stands for "today" in freshness rules.
AS_OF = "2001-12-31"


def query(name: str, sql: str | None = None):
    """Register fn(tables) -> DataFrame under a name, with the SQL it is compared with."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return fn

    return put


class Tables:
    """The tables of one folder, read lazily, and the views that many queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def places(self) -> DataFrame:
        """Nations with their regions; a dimension of fixed size."""
        return self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))

    def per_order(self) -> DataFrame:
        """Sums of an order's lines. Grouped by the join key, so the join with orders that follows moves nothing again."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        pct = F.round(F.col("l_discount") * 100).cast("long")
        return self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.sum(cents * (100 - pct)).alias("rev"), F.sum(F.round("l_quantity").cast("long")).alias("qty"), F.sum(cents * pct).alias("disc"), F.sum(cents).alias("cents"), F.count("*").alias("lines")
        )

    def sales(self) -> DataFrame:
        """One row an order: nation, region, customer, year, sums of its lines."""
        orders = self.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.year("o_orderdate").cast("long").alias("yr"))
        customer = self.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        rows = self.per_order().join(orders, "o_orderkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return rows.join(F.broadcast(self.places()), F.col("c_nationkey") == F.col("n_nationkey"))

    def wide(self) -> DataFrame:
        """nation x year: the four measures as integers."""
        return self.sales().groupBy("n_nationkey", "r_regionkey", "yr").agg(
            F.sum("rev").alias("REV"), F.sum("qty").alias("QTY"), F.count("*").alias("ORDERS"), F.sum("disc").alias("DISC")
        )

    def obs(self) -> DataFrame:
        """The long metric table: n_nationkey, r_regionkey, metric, yr, value."""
        return self.wide().unpivot(["n_nationkey", "r_regionkey", "yr"], ["REV", "QTY", "ORDERS", "DISC"], "metric", "value")

    def latest_obs(self) -> DataFrame:
        """Each nation's and metric's row of its latest year in which it has all months' worth of data (the latest year)."""
        from ..operators.temporal import latest

        return latest(self.obs(), ["n_nationkey", "r_regionkey", "metric"], ["yr"])


#: The same views as SQL; every query that needs them starts with these.
VIEWS = """
per_order AS (SELECT l_orderkey AS o_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)))::BIGINT AS rev,
  sum(CAST(round(l_quantity) AS BIGINT))::BIGINT AS qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS disc,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
sales AS (SELECT p.*, o_custkey, o_orderstatus, o_orderdate, year(o_orderdate)::BIGINT AS yr, c_custkey, c_nationkey, c_mktsegment, n_nationkey, n_name, n_regionkey, r_regionkey, r_name
  FROM per_order p JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
wide AS (SELECT n_nationkey, r_regionkey, yr, sum(rev)::BIGINT AS REV, sum(qty)::BIGINT AS QTY, count(*)::BIGINT AS ORDERS, sum(disc)::BIGINT AS DISC FROM sales GROUP BY ALL),
obs AS (SELECT n_nationkey, r_regionkey, yr, 'REV' AS metric, REV AS value FROM wide UNION ALL SELECT n_nationkey, r_regionkey, yr, 'QTY', QTY FROM wide
  UNION ALL SELECT n_nationkey, r_regionkey, yr, 'ORDERS', ORDERS FROM wide UNION ALL SELECT n_nationkey, r_regionkey, yr, 'DISC', DISC FROM wide),
latest_obs AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey, metric ORDER BY yr DESC) AS k FROM obs) WHERE k = 1)
"""


def with_views(sql: str) -> str:
    """SQL that uses the views; further common tables may come first, before SELECT."""
    sql = sql.strip()
    return f"WITH {VIEWS.strip()}{', ' + sql[5:] if sql[:5].upper() == 'WITH ' else ' ' + sql}"
