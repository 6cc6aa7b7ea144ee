"""Queries over composites, gaps, gates and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import allocate, composite, gates, rank, stats
from ..sources.store import written
from .base import Tables, query, with_views
from .ranking import TIERS, UP_SQL, tiers, up

SCALED = f"""q AS (SELECT metric, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM latest_obs GROUP BY 1),
scaled AS (SELECT metric, n_nationkey, value, CASE WHEN {UP_SQL} THEN (least(greatest(value, lo), hi) - lo) * 100 / nullif(hi - lo, 0) ELSE 100 - (least(greatest(value, lo), hi) - lo) * 100 / nullif(hi - lo, 0) END AS scaled
  FROM latest_obs JOIN q USING (metric) WHERE metric <> 'QTY')"""


def scaled(t: Tables):
    return stats.winsorised(t.latest_obs().filter("metric <> 'QTY'").select("metric", "n_nationkey", "value"), ["metric"], "value", up())


@query("q_winsor", with_views(f"WITH {SCALED} SELECT metric, n_nationkey, value, CAST(round(scaled * 10000) AS BIGINT) AS scaled_e4 FROM scaled"))
def winsor(t: Tables):
    return scaled(t).select("metric", "n_nationkey", "value", F.round(F.col("scaled") * 10000).cast("long").alias("scaled_e4"))


@query("q_inclusion", with_views(f"SELECT metric FROM latest_obs WHERE {UP_SQL} IS NOT NULL AND NOT (metric = 'ORDERS' AND n_nationkey = 4) GROUP BY metric HAVING count(DISTINCT n_nationkey) = 25"))
def inclusion(t: Tables):
    return composite.included(t.latest_obs().filter("NOT (metric = 'ORDERS' AND n_nationkey = 4)"), "metric", "n_nationkey", 25, up().isNotNull())


#: Scenarios of weights: all equal; by domain (money: REV, DISC; activity: ORDERS); one domain alone.
WEIGHTS = [("equal", "REV", 1), ("equal", "DISC", 1), ("equal", "ORDERS", 1), ("domain", "REV", 1), ("domain", "DISC", 1), ("domain", "ORDERS", 2), ("money", "REV", 1), ("money", "DISC", 1), ("activity", "ORDERS", 1)]
SCORES = f"""wt AS (SELECT * FROM (VALUES {', '.join(map(str, WEIGHTS))}) v(scenario, metric, weight)),
scores AS (SELECT scenario, n_nationkey, sum(CAST(round(scaled * 10000) AS BIGINT) * weight) / sum(weight) AS score FROM scaled JOIN wt USING (metric) GROUP BY ALL),
banded AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY score DESC)::BIGINT AS rank, ceil(rank() OVER (PARTITION BY scenario ORDER BY score DESC) * 5 / count(*) OVER (PARTITION BY scenario))::BIGINT AS band FROM scores)"""


def scores(t: Tables):
    whole = scaled(t).withColumn("scaled", F.round(F.col("scaled") * 10000).cast("long"))
    return composite.weighted_composite(whole, t.values(WEIGHTS, "scenario string, metric string, weight int"), "n_nationkey", "metric")


@query("q_composite", with_views(f"WITH {SCALED}, {SCORES} SELECT * FROM banded"))
def composites(t: Tables):
    return composite.bands(scores(t), "scenario", "n_nationkey", "score")


ROBUST = "robust AS (SELECT n_nationkey, min(rank) AS best, max(rank) AS worst, min(band) AS low_band, max(band) AS high_band, max(rank) - min(rank) AS spread, max(band) - min(band) <= 1 AS steady FROM banded GROUP BY 1)"


@query("q_bands", with_views(f"WITH {SCALED}, {SCORES}, {ROBUST} SELECT * FROM robust"))
def bands(t: Tables):
    return composite.robustness(composite.bands(scores(t), "scenario", "n_nationkey", "score"), "n_nationkey")


@query(
    "q_release_gate",
    with_views(f"""WITH {SCALED}, {SCORES}, {ROBUST}, a AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE steady)::BIGINT AS n_steady FROM robust), s AS (SELECT count(DISTINCT scenario)::BIGINT AS scenarios FROM banded)
    SELECT scenarios, n, n_steady, n_steady * 100 / n AS steady_pct, CASE WHEN scenarios < 2 THEN 'too few scenarios' WHEN n_steady * 100 / n < 85 THEN 'ranks move with the weights' ELSE 'publish' END AS decision FROM a, s"""),
)
def release_gate(t: Tables):
    b = written(composite.bands(scores(t), "scenario", "n_nationkey", "score"))  # a row a scenario and nation, read twice
    a = composite.robustness(b, "n_nationkey").agg(F.count("*").alias("n"), F.count_if("steady").alias("n_steady"))
    g = a.crossJoin(b.agg(F.count_distinct("scenario").alias("scenarios"))).withColumn("steady_pct", F.col("n_steady") * 100 / F.col("n"))
    return g.withColumn("decision", gates.decision([(gates.at_least(F.col("scenarios"), 2), "too few scenarios"), (gates.at_least(F.col("steady_pct"), 85), "ranks move with the weights")])).select("scenarios", "n", "n_steady", "steady_pct", "decision")


@query(
    "q_corr_matrix",
    with_views("""WITH o AS (SELECT n_nationkey, metric, value::DOUBLE AS v FROM latest_obs UNION ALL SELECT n_nationkey, 'ONES', 1.0 FROM nation)
    SELECT a.metric AS a, b.metric AS b, count(*)::BIGINT AS n, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN CAST(round(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) * 1e6) AS BIGINT) END AS r_e6,
    CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN abs(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v))) > 0.8 END AS multicollinear FROM o a JOIN o b ON a.n_nationkey = b.n_nationkey AND a.metric < b.metric GROUP BY ALL"""),
)
def corr_matrix(t: Tables):
    o = t.latest_obs().select("n_nationkey", "metric", F.col("value").cast("double").alias("value")).unionByName(t.nation.select("n_nationkey", F.lit("ONES").alias("metric"), F.lit(1.0).alias("value")))
    return stats.correlations(o, "n_nationkey", "metric", "value").select("a", "b", "n", F.round(F.col("r") * 1e6).cast("long").alias("r_e6"), "multicollinear")


@query(
    "q_spearman",
    with_views("""WITH p AS (SELECT metric, n_nationkey, a.value AS x, b.value AS y FROM obs a JOIN obs b USING (metric, n_nationkey) WHERE a.yr = 1999 AND b.yr = 2000),
    r AS (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY x DESC, n_nationkey) AS rx, row_number() OVER (PARTITION BY metric ORDER BY y DESC, n_nationkey) AS ry FROM p)
    SELECT metric, count(*)::BIGINT AS n, sum((rx - ry) * (rx - ry))::BIGINT AS d2, 1 - (sum((rx - ry) * (rx - ry)) * 6) / (count(*) * (count(*) * count(*) - 1)) AS rho FROM r GROUP BY 1"""),
)
def spearman(t: Tables):
    obs = t.obs().filter("yr IN (1999, 2000)")
    p = obs.groupBy("metric", "n_nationkey").agg(F.max(F.when(F.col("yr") == 1999, F.col("value"))).alias("x"), F.max(F.when(F.col("yr") == 2000, F.col("value"))).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return composite.spearman(p, ["metric"], "x", "y", "n_nationkey")


@query(
    "q_rank_change",
    with_views("""WITH m AS (SELECT metric, yr, min(value) AS lo, max(value) AS hi FROM obs GROUP BY ALL), s AS (SELECT n_nationkey, yr, sum(CAST(floor((value - lo) * 10000 / (hi - lo)) AS BIGINT))::BIGINT AS score FROM obs JOIN m USING (metric, yr) GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY yr ORDER BY score DESC)::BIGINT AS rank FROM s) SELECT n_nationkey, yr, score, rank, lag(rank) OVER (PARTITION BY n_nationkey ORDER BY yr) - rank AS climbed FROM r"""),
)
def rank_change(t: Tables):
    from pyspark.sql import Window

    obs = t.obs()
    m = obs.groupBy("metric", "yr").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    s = obs.join(F.broadcast(m), ["metric", "yr"]).groupBy("n_nationkey", "yr").agg(F.sum(F.floor((F.col("value") - F.col("lo")) * 10000 / (F.col("hi") - F.col("lo")))).alias("score"))
    r = s.withColumn("rank", F.rank().over(Window.partitionBy("yr").orderBy(F.desc("score"))).cast("long"))
    return r.withColumn("climbed", F.lag("rank").over(Window.partitionBy("n_nationkey").orderBy("yr")) - F.col("rank"))


@query(
    "q_pillars",
    with_views("""WITH w AS (SELECT n_nationkey, max(REV) FILTER (WHERE yr = 2000) * 100 / max(REV) FILTER (WHERE yr = 1999) AS growth, max(ORDERS) FILTER (WHERE yr = 2000) * 100 / max(ORDERS) FILTER (WHERE yr = 1999) AS activity,
      CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE max(QTY) FILTER (WHERE yr = 2000) * 100 / max(QTY) FILTER (WHERE yr = 1999) END AS volume FROM wide GROUP BY 1)
    SELECT n_nationkey, list_filter(['growth', 'activity', 'volume'], lambda x: x = 'volume' AND volume IS NULL) AS missing, CASE WHEN volume IS NOT NULL THEN (0.0::DOUBLE + least(growth, 100) + least(activity, 100) + least(volume, 100)) / 3 END AS score FROM w"""),
)
def pillars(t: Tables):
    at = lambda c, y: F.max(F.when(F.col("yr") == y, F.col(c)))
    w = t.wide().groupBy("n_nationkey").agg(*[(at(c, 2000) * 100 / at(c, 1999)).alias(p) for c, p in (("REV", "growth"), ("ORDERS", "activity"), ("QTY", "volume"))])
    w = w.withColumn("volume", F.when(F.col("n_nationkey") % 6 != 0, F.col("volume")))
    return composite.pillars(w, ["growth", "activity", "volume"]).select("n_nationkey", "missing", "score")


GAPS = f"""{TIERS}, g0 AS (SELECT l.*, tier FROM latest_obs l JOIN tiers USING (n_nationkey)),
g1 AS (SELECT *, median(value) OVER (PARTITION BY metric) AS national, CASE WHEN count(*) OVER (PARTITION BY metric, tier) >= 2 THEN median(value) OVER (PARTITION BY metric, tier) END AS peer FROM g0),
gaps AS (SELECT metric, n_nationkey, tier, value, coalesce(peer, national) AS benchmark, value - coalesce(peer, national) AS gap FROM g1)"""


def gap_rows(t: Tables):
    return composite.gaps(t.latest_obs().join(F.broadcast(tiers(t)), "n_nationkey").select("metric", "n_nationkey", "tier", "value"), "metric", "tier", "value", up())


@query(
    "q_gaps",
    with_views(f"""WITH {GAPS} SELECT metric, n_nationkey, tier, value, benchmark, gap, CASE WHEN gap = 0 THEN NULL WHEN {UP_SQL} THEN gap > 0 ELSE gap < 0 END AS favourable, CASE WHEN metric = 'REV' AND gap < 0 THEN CAST(round(-gap / 10000) AS BIGINT) END AS worth FROM gaps WHERE metric <> 'QTY'"""),
)
def gaps(t: Tables):
    g = gap_rows(t).filter("metric <> 'QTY'")
    worth = F.when((F.col("metric") == "REV") & (F.col("gap") < 0), F.round(-F.col("gap") / 10000).cast("long"))
    return g.select("metric", "n_nationkey", "tier", "value", "benchmark", "gap", "favourable", worth.alias("worth"))


@query(
    "q_narrative",
    with_views("""WITH r AS (SELECT metric, n_nationkey, rank() OVER (PARTITION BY metric ORDER BY value DESC)::BIGINT AS rank, cume_dist() OVER (PARTITION BY metric ORDER BY value) * 100 AS pct FROM latest_obs WHERE metric <> 'QTY'),
    k AS (SELECT *, CASE WHEN pct >= 75 THEN 'strength' ELSE 'weakness' END AS kind FROM r WHERE pct >= 75 OR pct <= 25), o AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, kind ORDER BY CASE WHEN kind = 'strength' THEN rank ELSE -rank END, metric) AS k FROM k)
    SELECT n_nationkey, kind, metric, metric || ' is a ' || kind || ': place ' || rank || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END || ' of 25' AS sentence FROM o WHERE k <= 3"""),
)
def narrative(t: Tables):
    r = rank.ranked(t.latest_obs().filter("metric <> 'QTY'"), ["metric"], "value").filter("percentile >= 75 OR percentile <= 25")
    r = r.withColumn("kind", F.when(F.col("percentile") >= 75, "strength").otherwise("weakness"))
    k = rank.top_k(r, ["n_nationkey", "kind"], [F.when(F.col("kind") == "strength", F.col("rank")).otherwise(-F.col("rank")), F.col("metric")], 3)
    return k.select("n_nationkey", "kind", "metric", F.concat("metric", F.lit(" is a "), "kind", F.lit(": place "), text.ordinal(F.col("rank")), F.lit(" of 25")).alias("sentence"))


@query(
    "q_cycle_change",
    with_views("""WITH p AS (SELECT n_nationkey, metric, max(value) FILTER (WHERE yr = 1995) AS a0, max(value) FILTER (WHERE yr = 1997) AS a1, max(value) FILTER (WHERE yr = 1999) AS b0, max(value) FILTER (WHERE yr = 2000) AS b1 FROM obs GROUP BY ALL)
    SELECT n_nationkey, metric, a1 - a0 AS first_cycle, b1 - b0 AS second_cycle, (b1 - b0) - (a1 - a0) AS difference FROM p"""),
)
def cycle_change(t: Tables):
    # 1998 is the transition year and counts for neither cycle.
    at = lambda y: F.max(F.when(F.col("yr") == y, F.col("value")))
    p = t.obs().filter("yr <> 1998").groupBy("n_nationkey", "metric").agg((at(1997) - at(1995)).alias("first_cycle"), (at(2000) - at(1999)).alias("second_cycle"))
    return p.withColumn("difference", F.col("second_cycle") - F.col("first_cycle"))


@query(
    "q_panel",
    with_views("""WITH x AS (SELECT n_nationkey, yr, metric FROM nation, (SELECT unnest(range(1998, 2003)) AS yr), (SELECT unnest(['REV', 'QTY', 'ORDERS', 'DISC']) AS metric))
    SELECT n_nationkey, yr::BIGINT AS yr, metric FROM x WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.n_nationkey = x.n_nationkey AND o.yr = x.yr AND o.metric = x.metric AND NOT (o.n_nationkey = 3 AND o.metric = 'DISC'))"""),
)
def panel(t: Tables):
    expected = t.values([(y, m) for y in range(1998, 2003) for m in ("REV", "QTY", "ORDERS", "DISC")], "yr long, metric string")
    return composite.panel_gaps(t.obs().filter("NOT (n_nationkey = 3 AND metric = 'DISC')"), t.nation.select("n_nationkey"), expected, ["n_nationkey", "yr", "metric"])


@query("q_weighted_rate", "SELECT n_regionkey, c_mktsegment, sum((CASE WHEN c_acctbal < 0 THEN 100 ELSE 0 END) * (1 + c_custkey % 9)) / sum(1 + c_custkey % 9) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def weighted_rate(t: Tables):
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_regionkey", "c_mktsegment").agg(stats.weighted_rate(F.when(F.col("c_acctbal") < 0, 100).otherwise(0), 1 + F.col("c_custkey") % 9).alias("rate"))


#: Predictions for a year are the values of the year before, with a band of a tenth to either side.
HOLDOUT = """ho AS (SELECT b.metric, b.n_nationkey, b.r_regionkey, a.value AS predicted, b.value AS observed FROM obs a JOIN obs b ON a.metric = b.metric AND a.n_nationkey = b.n_nationkey AND a.yr = 1999 AND b.yr = 2000)"""


def holdout(t: Tables):
    obs = t.obs()
    a = obs.filter("yr = 1999").select("metric", "n_nationkey", F.col("value").alias("predicted"))
    return obs.filter("yr = 2000").select("metric", "n_nationkey", "r_regionkey", F.col("value").alias("observed")).join(a, ["metric", "n_nationkey"])


@query(
    "q_holdout_errors",
    with_views(f"""WITH {HOLDOUT} SELECT metric, CAST(round(avg(abs(predicted - observed)) * 10) AS BIGINT) AS mae_10, CAST(round(sqrt(avg((predicted - observed)::DOUBLE * (predicted - observed))) * 10) AS BIGINT) AS rmse_10,
    CAST(round(avg(abs(predicted - observed) / observed * 100) FILTER (WHERE observed <> 0) * 10000) AS BIGINT) AS mape_e4 FROM ho GROUP BY 1"""),
)
def holdout_errors(t: Tables):
    o, p = F.col("observed").cast("double"), F.col("predicted").cast("double")
    e = holdout(t).groupBy("metric").agg(*[c.alias(k) for k, c in stats.errors(o, p).items()])
    return e.select("metric", F.round(F.col("mae") * 10).cast("long").alias("mae_10"), F.round(F.col("rmse") * 10).cast("long").alias("rmse_10"), F.round(F.col("mape") * 10000).cast("long").alias("mape_e4"))


@query(
    "q_interval_gate",
    with_views(f"""WITH {HOLDOUT}, g AS (SELECT metric, count(*)::BIGINT AS n, count(*) FILTER (WHERE observed * 10 BETWEEN predicted * 9 AND predicted * 11)::BIGINT AS inside, median(predicted * 2) / 10 AS width FROM ho GROUP BY 1)
    SELECT metric, n, inside, inside * 100 / n AS coverage, width, inside * 100 / n >= 90 AS passed FROM g"""),
)
def interval_gate(t: Tables):
    inside = (F.col("observed") * 10).between(F.col("predicted") * 9, F.col("predicted") * 11)
    g = holdout(t).groupBy("metric").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), (F.median(F.col("predicted") * 2) / 10).alias("width")).withColumn("coverage", F.col("inside") * 100 / F.col("n"))
    return g.withColumn("passed", gates.at_least(F.col("coverage"), 90)).select("metric", "n", "inside", "coverage", "width", "passed")


@query(
    "q_back_agg",
    with_views("""WITH p AS (SELECT r_regionkey, metric, yr, sum(value)::BIGINT AS parent FROM obs GROUP BY ALL), c AS (SELECT r_regionkey, metric, yr, sum(value) FILTER (WHERE n_nationkey % 11 <> 0)::BIGINT AS children FROM obs GROUP BY ALL)
    SELECT r_regionkey, metric, yr, parent, children, (children - parent) * 100 / nullif(parent, 0) AS bias_pct, coalesce(abs((children - parent) * 100 / nullif(parent, 0)) <= 1, false) AS passed FROM p JOIN c USING (r_regionkey, metric, yr)"""),
)
def back_agg(t: Tables):
    # Nations 0, 11 and 22 are missing from the children, so their regions fail.
    s = t.obs().groupBy("r_regionkey", "metric", "yr").agg(F.sum("value").alias("parent"), F.sum(F.when(F.col("n_nationkey") % 11 != 0, F.col("value"))).alias("children"))
    s = s.withColumn("bias_pct", gates.back_aggregation_bias(F.col("parent"), F.col("children")))
    return s.withColumn("passed", gates.within(F.col("bias_pct"), 1))


@query(
    "q_publish_decision",
    with_views(f"""WITH {HOLDOUT}, g AS (SELECT metric, r_regionkey, sum(observed)::BIGINT AS parent, sum(observed) FILTER (WHERE n_nationkey <> 22)::BIGINT AS children, sum(abs(predicted - observed))::BIGINT AS miss, count(*)::BIGINT AS n FROM ho GROUP BY ALL)
    SELECT metric, r_regionkey, CASE WHEN (children - parent) <> 0 THEN 'blocked: does not add up' WHEN miss * 100 / parent > 5 THEN 'blocked: hold-out error' WHEN n < 5 THEN 'blocked: too few places' ELSE 'publish' END AS decision FROM g"""),
)
def publish_decision(t: Tables):
    g = holdout(t).groupBy("metric", "r_regionkey").agg(F.sum("observed").alias("parent"), F.sum(F.when(F.col("n_nationkey") != 22, F.col("observed"))).alias("children"), F.sum(F.abs(F.col("predicted") - F.col("observed"))).alias("miss"), F.count("*").alias("n"))
    steps = [
        (gates.within(gates.back_aggregation_bias(F.col("parent"), F.col("children")), 0), "blocked: does not add up"),
        (gates.within(F.try_divide(F.col("miss") * 100, F.col("parent")), 5), "blocked: hold-out error"),
        (gates.at_least(F.col("n"), 5), "blocked: too few places"),
    ]
    return g.select("metric", "r_regionkey", gates.decision(steps).alias("decision"))


@query(
    "q_spread",
    with_views("""WITH p AS (SELECT n_nationkey, metric, max(value) FILTER (WHERE yr = 1998) AS a, max(value) FILTER (WHERE yr = 1999) AS b, max(value) FILTER (WHERE yr = 2000) AS c FROM obs GROUP BY ALL)
    SELECT n_nationkey, metric, least(a, b, c) AS low, greatest(a, b, c) AS high, CAST(round((greatest(a, b, c) - least(a, b, c)) / ((a + b + c) / 3) * 1e6) AS BIGINT) AS spread_e6, (greatest(a, b, c) - least(a, b, c)) / ((a + b + c) / 3) <= 0.15 AS eligible FROM p"""),
)
def spread(t: Tables):
    at = lambda y: F.max(F.when(F.col("yr") == y, F.col("value")))
    p = t.obs().groupBy("n_nationkey", "metric").agg(at(1998).alias("a"), at(1999).alias("b"), at(2000).alias("c"))
    three = [F.col(x) for x in "abc"]
    s = gates.spread(three)
    return p.select("n_nationkey", "metric", F.least(*three).alias("low"), F.greatest(*three).alias("high"), F.round(s * 1e6).cast("long").alias("spread_e6"), gates.within(s, 0.15).alias("eligible"))


@query(
    "q_largest_remainder",
    with_views("""WITH w AS (SELECT r_regionkey, n_nationkey, ORDERS + 1 AS weight FROM wide WHERE yr = 2000), a AS (SELECT *, sum(weight) OVER p AS s, 1000 + r_regionkey AS total FROM w WINDOW p AS (PARTITION BY r_regionkey)),
    b AS (SELECT *, (total * weight) // s AS base, (total * weight) % s AS rest FROM a), c AS (SELECT *, total - sum(base) OVER p AS remaining, row_number() OVER (PARTITION BY r_regionkey ORDER BY rest DESC, n_nationkey) AS k FROM b WINDOW p AS (PARTITION BY r_regionkey))
    SELECT r_regionkey, n_nationkey, total::BIGINT AS total, (base + CASE WHEN k <= remaining THEN 1 ELSE 0 END)::BIGINT AS allocated FROM c"""),
)
def largest_remainder(t: Tables):
    w = t.wide().filter("yr = 2000").select("r_regionkey", "n_nationkey", (F.col("ORDERS") + 1).alias("weight"), (F.lit(1000) + F.col("r_regionkey")).cast("long").alias("total"))
    return allocate.largest_remainder(w, ["r_regionkey"], "n_nationkey", "total", "weight").select("r_regionkey", "n_nationkey", "total", "allocated")


@query(
    "q_weight_sum",
    with_views("""WITH w AS (SELECT r_regionkey, n_nationkey, round(ORDERS * 100 / sum(ORDERS) OVER (PARTITION BY r_regionkey, yr)) / 100 AS weight, yr FROM wide), s AS (SELECT r_regionkey, yr, sum(weight) AS total FROM w GROUP BY ALL)
    SELECT r_regionkey, yr, CAST(round(total * 1e6) AS BIGINT) AS total_e6 FROM s WHERE abs(total - 1) > 1e-6"""),
)
def weight_sum(t: Tables):
    from pyspark.sql import Window

    share = F.col("ORDERS") * 100 / F.sum("ORDERS").over(Window.partitionBy("r_regionkey", "yr"))
    w = t.wide().withColumn("weight", F.round(share) / 100)  # weights as they are published, in whole per cents
    return allocate.weight_violations(w, ["r_regionkey", "yr"], "weight", 1e-6).select("r_regionkey", "yr", F.round(F.col("total") * 1e6).cast("long").alias("total_e6"))
