"""Trees and graphs: ancestors, nesting, shares of a parent, walks along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ancestors(tree: DataFrame, node: str, parent: str, depth: int) -> DataFrame:
    """node, ancestor, distance for a tree of at most `depth` levels: one self-join a level, on broadcastable parents."""
    up = tree.select(F.col(node).alias("p_node"), F.col(parent).alias("p_parent")).filter("p_parent IS NOT NULL")
    level = tree.select(node, F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("distance")).filter("ancestor IS NOT NULL")
    out = level
    for _ in range(depth - 1):
        level = level.join(up, F.col("ancestor") == F.col("p_node")).select(node, F.col("p_parent").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        out = out.unionByName(level)
    return out


def share_of_parent(df: DataFrame, parent: list[str], child: str, value: str, siblings: DataFrame, additive: bool = True) -> DataFrame:
    """Rank among siblings and share of their sum, null unless all siblings have a value (and it can be added up)."""
    total = siblings.groupBy(*parent).agg(F.count_distinct(child).alias("n_siblings"))
    w = Window.partitionBy(*parent)
    j = df.join(total, parent).withColumns({"n_with": F.count(value).over(w), "sum_all": F.sum(value).over(w), "sibling_rank": F.rank().over(w.orderBy(F.col(value).desc_nulls_last())).cast("long")})
    share = F.when((F.col("n_with") == F.col("n_siblings")) & F.lit(additive), F.try_divide(F.col(value) * 100, F.col("sum_all")))
    return j.select(*df.columns, "sibling_rank", share.alias("share"))


def spread(edges: DataFrame, start: str, steps: int) -> DataFrame:
    """Nodes within so many steps of `start` along edges in either direction, with the fewest steps. Each step joins the last
    step's new nodes only (breadth first), so nothing is visited twice."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, steps long")
    edge_of = seen
    for i in range(1, steps + 1):
        new = edge_of.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        edge_of = new.join(seen, "node", "left_anti").withColumn("steps", F.lit(i).cast("long"))
        seen = seen.unionByName(edge_of)
    return seen
