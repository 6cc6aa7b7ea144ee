"""Queries over ranks, peers, trends and series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hierarchy, rank, stats, temporal
from .base import Tables, query, with_views

#: Whether more of a metric is better; DISC: less is; QTY has no direction.
def up():
    return F.when(F.col("metric").isin("REV", "ORDERS"), True).when(F.col("metric") == "DISC", False)


UP_SQL = "CASE WHEN metric IN ('REV', 'ORDERS') THEN true WHEN metric = 'DISC' THEN false END"


@query(
    "q_rank",
    with_views("SELECT metric, n_nationkey, value, rank() OVER (PARTITION BY metric ORDER BY value DESC)::BIGINT AS rank, cume_dist() OVER (PARTITION BY metric ORDER BY value) * 100 AS percentile FROM latest_obs"),
)
def ranks(t: Tables):
    return rank.ranked(t.latest_obs(), ["metric"], "value").select("metric", "n_nationkey", "value", "rank", "percentile")


@query("q_median_gap", with_views("SELECT metric, n_nationkey, value, median(value) OVER (PARTITION BY metric) AS median, value - median(value) OVER (PARTITION BY metric) AS gap FROM latest_obs"))
def median_gap(t: Tables):
    return rank.median_gap(t.latest_obs(), ["metric"], "value").select("metric", "n_nationkey", "value", "median", "gap")


TIERS = """ax AS (SELECT c_nationkey AS n_nationkey, count(*)::BIGINT AS customers FROM customer GROUP BY 1),
od AS (SELECT *, row_number() OVER (ORDER BY customers) - 1 AS pos, count(*) OVER () AS n FROM ax),
cu AS (SELECT min(customers) FILTER (WHERE pos = floor(n * 1 / 4)) AS c1, min(customers) FILTER (WHERE pos = floor(n * 2 / 4)) AS c2, min(customers) FILTER (WHERE pos = floor(n * 3 / 4)) AS c3 FROM od),
tiers AS (SELECT n_nationkey, customers, CASE WHEN customers <= c1 THEN 1 WHEN customers <= c2 THEN 2 WHEN customers <= c3 THEN 3 ELSE 4 END::BIGINT AS tier FROM ax, cu)"""


def tiers(t: Tables):
    axis = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers")).withColumn("axis", F.lit("customers"))
    return rank.peer_tiers(axis, ["axis"], "customers", bounded=True).select("n_nationkey", "customers", "tier")


@query("q_peer_tier", f"WITH {TIERS} SELECT * FROM tiers")
def peer_tier(t: Tables):
    return tiers(t)


@query(
    "q_peer_rank",
    with_views(f"""WITH {TIERS}, x AS (SELECT l.*, tier FROM latest_obs l JOIN tiers USING (n_nationkey))
    SELECT metric, n_nationkey, tier, value, rank() OVER (PARTITION BY metric ORDER BY value DESC)::BIGINT AS national_rank, cume_dist() OVER (PARTITION BY metric ORDER BY value) * 100 AS national_percentile,
    median(value) OVER (PARTITION BY metric) AS national_median, rank() OVER (PARTITION BY metric, tier ORDER BY value DESC)::BIGINT AS peer_rank, cume_dist() OVER (PARTITION BY metric, tier ORDER BY value) * 100 AS peer_percentile,
    median(value) OVER (PARTITION BY metric, tier) AS peer_median, count(*) OVER (PARTITION BY metric, tier)::BIGINT AS peers FROM x"""),
)
def peer_rank(t: Tables):
    x = t.latest_obs().join(F.broadcast(tiers(t)), "n_nationkey")
    out = rank.peer_ranks(x.select("metric", "n_nationkey", "tier", "value"), "metric", "tier", "value")
    return out.select("metric", "n_nationkey", "tier", "value", "national_rank", "national_percentile", "national_median", "peer_rank", "peer_percentile", "peer_median", "peers")


@query("q_dir_rank", with_views(f"SELECT metric, n_nationkey, value, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN {UP_SQL} THEN value ELSE -value END DESC)::BIGINT AS merit_rank FROM latest_obs WHERE metric <> 'QTY'"))
def dir_rank(t: Tables):
    return rank.directed(t.latest_obs().filter("metric <> 'QTY'"), ["metric"], "value", up()).select("metric", "n_nationkey", "value", "merit_rank")


@query(
    "q_leaderboard",
    with_views("""WITH s AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE value END AS score FROM latest_obs JOIN nation USING (n_nationkey) WHERE metric = 'REV'),
    k AS (SELECT n_nationkey, rank() OVER (ORDER BY score DESC)::BIGINT AS r, count(*) OVER () AS n FROM s WHERE score IS NOT NULL)
    SELECT s.n_nationkey, n_name, score, r AS place, ceil(r * 5 / n)::BIGINT AS band, row_number() OVER (ORDER BY r ASC NULLS LAST, n_name)::BIGINT AS line FROM s LEFT JOIN k USING (n_nationkey)"""),
)
def leaderboard(t: Tables):
    # Every sixth nation has no score: unranked ones come last, by name.
    s = t.latest_obs().filter("metric = 'REV'").join(F.broadcast(t.nation.select("n_nationkey", "n_name")), "n_nationkey").withColumn("score", F.when(F.col("n_nationkey") % 6 != 0, F.col("value")))
    k = rank.ranked(s.withColumn("board", F.lit("REV")), ["board"], "score")
    w = Window.partitionBy("board").orderBy(F.col("rank").asc_nulls_last(), "n_name")
    n = F.count("score").over(Window.partitionBy("board"))
    return k.select("n_nationkey", "n_name", "score", F.col("rank").alias("place"), F.ceil(F.col("rank") * 5 / n).alias("band"), F.row_number().over(w).cast("long").alias("line"))


@query(
    "q_topn_ties",
    """WITH q AS (SELECT p_type, p_brand, count(*)::BIGINT // 10 AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT * FROM (SELECT p_type, p_brand, score, rank() OVER (PARTITION BY p_type ORDER BY score DESC)::BIGINT AS place FROM q) WHERE place <= 5""",
)
def topn_ties(t: Tables):
    q = t.lineitem.join(t.part.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.floor(F.count("*") / 10).alias("score"))
    return rank.top_with_ties(q, ["p_type"], "score", 5)


@query(
    "q_topk_group",
    """WITH q AS (SELECT r_name, p_brand, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT * FROM (SELECT r_name, p_brand, cents, row_number() OVER (PARTITION BY r_name ORDER BY cents DESC, p_brand)::BIGINT AS place FROM q) WHERE place <= 3""",
)
def topk_group(t: Tables):
    j = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.places()), F.col("s_nationkey") == F.col("n_nationkey"))
    q = j.groupBy("r_name", "p_brand").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return rank.top_k(q, ["r_name"], [F.col("cents").desc(), F.col("p_brand")], 3)


#: Revenue of a customer by year: series with gaps where a customer ordered nothing.
CUSTOMER_YEARS = "own AS (SELECT c_custkey, 'REV' AS metric, yr, sum(rev)::BIGINT AS value FROM sales GROUP BY ALL)"


def customer_years(t: Tables):
    return t.sales().groupBy("c_custkey", F.lit("REV").alias("metric"), "yr").agg(F.sum("rev").alias("value"))


@query(
    "q_trend",
    with_views(f"""WITH {CUSTOMER_YEARS}, e AS (SELECT c_custkey, metric, {UP_SQL} AS hib, arg_min(value, yr) AS first, arg_max(value, yr) AS last, count(*)::BIGINT AS n FROM own GROUP BY ALL)
    SELECT c_custkey, metric, first, last, n, last - first AS change, CASE WHEN n < 2 THEN 'single' WHEN hib IS NULL THEN CASE WHEN last > first THEN 'rising' WHEN last < first THEN 'falling' ELSE 'flat' END
      WHEN last = first THEN 'stable' WHEN (last > first) = hib THEN 'improving' ELSE 'worsening' END AS direction FROM e"""),
)
def trend(t: Tables):
    return rank.trend(customer_years(t), ["c_custkey", "metric"], "yr", "value", up())


@query("q_klag", with_views("SELECT n_nationkey, metric, yr, value, value - lag(value, 1) OVER w AS change_1, value - lag(value, 3) OVER w AS change_3, value - lag(value, 5) OVER w AS change_5 FROM obs WINDOW w AS (PARTITION BY n_nationkey, metric ORDER BY yr)"))
def klag(t: Tables):
    return rank.lags(t.obs(), ["n_nationkey", "metric"], "yr", "value", [1, 3, 5]).select("n_nationkey", "metric", "yr", "value", "change_1", "change_3", "change_5")


@query(
    "q_volatility",
    with_views(f"""WITH {CUSTOMER_YEARS}, d AS (SELECT c_custkey, value - lag(value) OVER (PARTITION BY c_custkey ORDER BY yr) AS d FROM own)
    SELECT c_custkey, CASE WHEN count(d) >= 2 THEN CAST(round(stddev_pop(d) * 10) AS BIGINT) END AS volatility_10, count(d)::BIGINT AS steps FROM d GROUP BY ALL"""),
)
def volatility(t: Tables):
    v = rank.volatility(customer_years(t), ["c_custkey"], "yr", "value")
    return v.select("c_custkey", F.round(F.col("volatility") * 10).cast("long").alias("volatility_10"), "steps")


@query("q_break_flag", "SELECT conv_id, arg_min(role, turn) AS first_mark, count(DISTINCT role) > 1 AS broken FROM conversations GROUP BY conv_id")
def break_flag(t: Tables):
    return rank.break_flag(t.conversations, ["conv_id"], "turn", "role")


@query(
    "q_matched_change",
    with_views(f"""WITH {TIERS}, o AS (SELECT obs.*, tier FROM obs JOIN tiers USING (n_nationkey)),
    nm AS (SELECT metric, yr, median(value) AS m FROM o GROUP BY ALL), pm AS (SELECT metric, tier, yr, median(value) AS m FROM o GROUP BY ALL),
    l AS (SELECT n_nationkey, metric, tier, max(yr) AS y1 FROM o GROUP BY ALL), p AS (SELECT l.*, (SELECT max(yr) FROM o WHERE o.n_nationkey = l.n_nationkey AND o.metric = l.metric AND o.yr < l.y1) AS y0 FROM l)
    SELECT p.n_nationkey, p.metric, y0, y1, b.value - a.value AS own_change, nb.m - na.m AS national_change, pb.m - pa.m AS peer_change
    FROM p JOIN o a ON a.n_nationkey = p.n_nationkey AND a.metric = p.metric AND a.yr = y0 JOIN o b ON b.n_nationkey = p.n_nationkey AND b.metric = p.metric AND b.yr = y1
    JOIN nm na ON na.metric = p.metric AND na.yr = y0 JOIN nm nb ON nb.metric = p.metric AND nb.yr = y1 JOIN pm pa ON pa.metric = p.metric AND pa.tier = p.tier AND pa.yr = y0 JOIN pm pb ON pb.metric = p.metric AND pb.tier = p.tier AND pb.yr = y1"""),
)
def matched_change(t: Tables):
    o = t.obs().join(F.broadcast(tiers(t)), "n_nationkey")
    w = Window.partitionBy("n_nationkey", "metric").orderBy(F.desc("yr"))
    last = o.withColumns({"back": F.row_number().over(w), "y0": F.lead("yr").over(w), "v0": F.lead("value").over(w)}).filter("back = 1 AND y0 IS NOT NULL")
    nm = o.groupBy("metric", "yr").agg(F.median("value").alias("m"))
    pm = o.groupBy("metric", "tier", "yr").agg(F.median("value").alias("m"))
    at = lambda df, y, name: F.broadcast(df.withColumnsRenamed({"yr": y, "m": name}))
    j = last.withColumnRenamed("yr", "y1").join(at(nm, "y0", "na"), ["metric", "y0"]).join(at(nm, "y1", "nb"), ["metric", "y1"]).join(at(pm, "y0", "pa"), ["metric", "tier", "y0"]).join(at(pm, "y1", "pb"), ["metric", "tier", "y1"])
    return j.select("n_nationkey", "metric", "y0", "y1", (F.col("value") - F.col("v0")).alias("own_change"), (F.col("nb") - F.col("na")).alias("national_change"), (F.col("pb") - F.col("pa")).alias("peer_change"))


@query(
    "q_lookback",
    with_views(f"""WITH {CUSTOMER_YEARS}, m AS (SELECT *, max(yr) OVER p AS last, row_number() OVER (PARTITION BY c_custkey ORDER BY yr DESC) AS back FROM own WINDOW p AS (PARTITION BY c_custkey)),
    c AS (SELECT *, count(*) FILTER (WHERE yr >= last - 2) OVER (PARTITION BY c_custkey) AS n_in FROM m) SELECT c_custkey, yr, value FROM c WHERE yr >= last - 2 OR (n_in < 2 AND back <= 2)"""),
)
def lookback(t: Tables):
    return temporal.lookback(customer_years(t), ["c_custkey"], "yr", 2, 2).select("c_custkey", "yr", "value")


@query(
    "q_transforms",
    with_views("""WITH o AS (SELECT n_nationkey, yr, CASE WHEN yr = 1995 AND n_nationkey % 2 = 0 THEN 0 ELSE value END AS value FROM obs WHERE metric = 'ORDERS'),
    b AS (SELECT *, lag(value) OVER w AS before, first_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY n_nationkey ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM o WINDOW w AS (PARTITION BY n_nationkey ORDER BY yr))
    SELECT n_nationkey, yr, value, value - before AS change_abs, (value - before) * 100 / nullif(before, 0) AS change_pct, value * 100 / nullif(base, 0) AS index_100 FROM b"""),
)
def transforms(t: Tables):
    o = t.obs().filter("metric = 'ORDERS'").select("n_nationkey", "yr", F.when((F.col("yr") == 1995) & (F.col("n_nationkey") % 2 == 0), F.lit(0).cast("long")).otherwise(F.col("value")).alias("value"))
    return rank.transforms(o, ["n_nationkey"], "yr", "value")


@query(
    "q_share_of_parent",
    with_views("""WITH l AS (SELECT * FROM latest_obs WHERE metric = 'ORDERS' AND n_nationkey <> 7), s AS (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1)
    SELECT r_regionkey, n_nationkey, value, rank() OVER (PARTITION BY r_regionkey ORDER BY value DESC)::BIGINT AS sibling_rank, CASE WHEN count(value) OVER p = n THEN value * 100 / sum(value) OVER p END AS share FROM l JOIN s USING (r_regionkey) WINDOW p AS (PARTITION BY r_regionkey)"""),
)
def share_of_parent(t: Tables):
    l = t.latest_obs().filter("metric = 'ORDERS' AND n_nationkey <> 7").select("r_regionkey", "n_nationkey", "value")  # noqa: E741
    return hierarchy.share_of_parent(l, ["r_regionkey"], "n_nationkey", "value", t.nation.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey"))


@query(
    "q_children_rank",
    with_views("""WITH l AS (SELECT r_regionkey, metric, n_nationkey, CASE WHEN n_nationkey % 8 = 0 THEN yr - 1 ELSE yr END AS yr, value FROM latest_obs), s AS (SELECT n_regionkey AS r_regionkey, count(*)::BIGINT AS places FROM nation GROUP BY 1)
    SELECT r_regionkey, metric, n_nationkey, value, rank() OVER (PARTITION BY r_regionkey, metric ORDER BY value DESC)::BIGINT AS place, count(*) OVER (PARTITION BY r_regionkey, metric)::BIGINT AS covered, places,
    (max(yr) OVER (PARTITION BY r_regionkey, metric)) <> (min(yr) OVER (PARTITION BY r_regionkey, metric)) AS mixed_periods FROM l JOIN s USING (r_regionkey)"""),
)
def children_rank(t: Tables):
    l = t.latest_obs().withColumn("yr", F.when(F.col("n_nationkey") % 8 == 0, F.col("yr") - 1).otherwise(F.col("yr")))  # noqa: E741
    places = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("places"))
    w = Window.partitionBy("r_regionkey", "metric")
    j = l.join(F.broadcast(places), "r_regionkey")
    return j.select("r_regionkey", "metric", "n_nationkey", "value", F.rank().over(w.orderBy(F.desc("value"))).cast("long").alias("place"), F.count("*").over(w).alias("covered"), "places", (F.max("yr").over(w) != F.min("yr").over(w)).alias("mixed_periods"))


@query("q_availability", with_views("SELECT metric, r_regionkey, count(DISTINCT n_nationkey)::BIGINT AS places, min(yr) AS first_year, max(yr) AS last_year, count(*)::BIGINT AS n FROM obs GROUP BY ALL"))
def availability(t: Tables):
    return t.obs().groupBy("metric", "r_regionkey").agg(F.count_distinct("n_nationkey").alias("places"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year"), F.count("*").alias("n"))


@query(
    "q_quantile_class",
    with_views("""WITH q AS (SELECT metric, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM latest_obs GROUP BY 1)
    SELECT metric, n_nationkey, value, (len(list_filter(q, lambda c: c < value)) + 1)::BIGINT AS class FROM latest_obs JOIN q USING (metric)"""),
)
def quantile_class(t: Tables):
    return rank.quantile_class(t.latest_obs(), ["metric"], "value").select("metric", "n_nationkey", "value", "class")


@query(
    "q_islands",
    """WITH d AS (SELECT DISTINCT o_custkey % 50 AS place, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS day FROM orders), g AS (SELECT *, day - row_number() OVER (PARTITION BY place ORDER BY day) AS island FROM d)
    SELECT place, min(day) AS first, max(day) AS last, count(*)::BIGINT AS length FROM g GROUP BY place, island""",
)
def islands(t: Tables):
    d = t.orders.select((F.col("o_custkey") % 50).alias("place"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"))
    return rank.islands(d, ["place"], "day")


@query(
    "q_sequence_gaps",
    """WITH d AS (SELECT DISTINCT o_custkey, year(o_orderdate)::BIGINT AS yr FROM orders), b AS (SELECT o_custkey, min(yr) AS lo, max(yr) AS hi FROM d GROUP BY 1), x AS (SELECT o_custkey, unnest(range(lo, hi + 1)) AS missing FROM b)
    SELECT o_custkey, missing FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.o_custkey = x.o_custkey AND d.yr = x.missing)""",
)
def sequence_gaps(t: Tables):
    return rank.sequence_gaps(t.orders.select("o_custkey", F.year("o_orderdate").cast("long").alias("yr")), ["o_custkey"], "yr")


@query(
    "q_overlay_clip",
    with_views("""WITH p AS (SELECT metric, min(yr) AS lo, max(yr) AS hi FROM obs WHERE n_nationkey = 1 AND yr BETWEEN 1996 AND 1999 GROUP BY 1) SELECT n_nationkey, metric, yr, value FROM obs JOIN p USING (metric) WHERE yr BETWEEN lo AND hi"""),
)
def overlay_clip(t: Tables):
    obs = t.obs()
    span = obs.filter("n_nationkey = 1 AND yr BETWEEN 1996 AND 1999").groupBy("metric").agg(F.min("yr").alias("lo"), F.max("yr").alias("hi"))
    return obs.join(F.broadcast(span), "metric").filter("yr BETWEEN lo AND hi").select("n_nationkey", "metric", "yr", "value")


@query(
    "q_nearest_rank",
    """WITH c AS (SELECT c_nationkey AS n_nationkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey), p AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY cents) - 1 AS pos, count(*) OVER (PARTITION BY n_nationkey) AS n FROM c)
    SELECT n_nationkey, min(cents) FILTER (WHERE pos = floor(n / 2)) AS upper_median, min(cents) FILTER (WHERE pos = ceil((n - 1) * 9 / 10)) AS p90 FROM p GROUP BY 1""",
)
def nearest_rank(t: Tables):
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return stats.order_statistics(c, ["n_nationkey"], "cents", {"upper_median": F.floor(F.col("n") / 2), "p90": F.ceil((F.col("n") - 1) * 9 / 10)})


@query(
    "q_frames",
    """WITH m AS (SELECT c_nationkey AS n_nationkey, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS month, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT n_nationkey, month, cents, sum(cents) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS last_three, count(*) OVER (w RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS months_of_three,
      max(cents) OVER (w RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS high_of_year, cents - lag(cents) OVER w AS change, lead(cents) OVER w AS next_cents,
      first_value(cents) OVER w AS first_cents, ntile(4) OVER (PARTITION BY n_nationkey ORDER BY cents, month)::BIGINT AS quarter
    FROM m WINDOW w AS (PARTITION BY n_nationkey ORDER BY month)""",
)
def frames(t: Tables):
    """Frames of rows and of months over a nation's monthly sums, so a window sorts as many rows as there are months."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month")
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), month).agg(cents.alias("cents"))
    w = Window.partitionBy("n_nationkey").orderBy("month")
    return m.select(
        "n_nationkey", "month", "cents",
        F.sum("cents").over(w.rowsBetween(-2, 0)).alias("last_three"),
        F.count("*").over(w.rangeBetween(-2, 0)).alias("months_of_three"),
        F.max("cents").over(w.rangeBetween(-11, 0)).alias("high_of_year"),
        (F.col("cents") - F.lag("cents").over(w)).alias("change"),
        F.lead("cents").over(w).alias("next_cents"),
        F.first("cents").over(w).alias("first_cents"),
        F.ntile(4).over(Window.partitionBy("n_nationkey").orderBy("cents", "month")).cast("long").alias("quarter"),
    )
