"""Queries behind comparison, browse and profile views, and the remaining rules and spatial operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank, rules, spatial, temporal
from .base import Tables, query, with_views


@query(
    "q_default_series",
    """WITH s AS (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL), l AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS level FROM s)
    SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level, n DESC, event_type) AS k FROM l) WHERE k = 1""",
)
def default_series(t: Tables):
    s = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    level = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return temporal.best(s.withColumns({"level": level, "minus": -F.col("n")}), ["user_id"], [F.col("level"), F.col("minus"), F.col("event_type")], ["event_type", "n"], largest=False)


@query("q_most_observed", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS k FROM (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL)) WHERE k = 1")
def most_observed(t: Tables):
    s = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return temporal.best(s, ["user_id"], [F.col("n"), F.col("event_type")], ["event_type", "n"])


@query(
    "q_worst_status",
    """WITH c AS (SELECT n_regionkey, CASE WHEN max(c_acctbal < -900) THEN 'poor' WHEN max(c_acctbal < 0) THEN 'fair' ELSE 'good' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey)
    SELECT n_regionkey, CASE max(CASE status WHEN 'good' THEN 0 WHEN 'fair' THEN 1 ELSE 2 END) WHEN 0 THEN 'good' WHEN 1 THEN 'fair' ELSE 'poor' END AS status, count(*)::BIGINT AS children FROM c GROUP BY 1""",
)
def worst_status(t: Tables):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.min("c_acctbal").alias("low"))
    status = F.when(F.col("low") < -900, "poor").when(F.col("low") < 0, "fair").otherwise("good")
    return spatial.worst_of(c.withColumn("status", status), "n_regionkey", "status", ["good", "fair", "poor"])


@query(
    "q_compat_overlay",
    """WITH s AS (SELECT DISTINCT p_brand, p_type, p_size FROM part) SELECT a.p_brand AS brand, b.p_brand AS overlay, count(*)::BIGINT AS contracts FROM s a JOIN s b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand <> b.p_brand GROUP BY ALL""",
)
def compat_overlay(t: Tables):
    s = t.part.select("p_brand", "p_type", "p_size").distinct()
    j = s.withColumnRenamed("p_brand", "brand").join(s.withColumnRenamed("p_brand", "overlay"), ["p_type", "p_size"]).filter("brand <> overlay")
    return j.groupBy("brand", "overlay").agg(F.count("*").alias("contracts"))


@query(
    "q_explode_keys",
    """WITH e AS (SELECT p_partkey AS id, unnest([p_size % 13, 20 + p_partkey % 7, 100 + p_partkey // 3]) AS key, p_type AS state FROM part), n AS (SELECT key, count(*) AS n FROM e GROUP BY key)
    SELECT key, id, state, n > 1 AS duplicate FROM e JOIN n USING (key)""",
)
def explode_keys(t: Tables):
    k = F.col("p_partkey")
    e = t.part.select(k.alias("id"), F.explode(F.array(F.col("p_size").cast("long") % 13, 20 + k % 7, 100 + F.floor(k / 3))).alias("key"), F.col("p_type").alias("state"))
    return e.join(e.groupBy("key").agg((F.count("*") > 1).alias("duplicate")), "key")


@query(
    "q_yield_report",
    """WITH y AS (SELECT c_mktsegment AS family, count(DISTINCT o_custkey) FILTER (WHERE year(o_orderdate) <= 1996)::BIGINT AS before, count(DISTINCT o_custkey)::BIGINT AS after FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT family, before, after, after - before AS gained, (after - before) * 100 / nullif(before, 0) AS gained_pct FROM y""",
)
def yield_report(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    y = j.groupBy(F.col("c_mktsegment").alias("family")).agg(F.count_distinct(F.when(F.year("o_orderdate") <= 1996, F.col("o_custkey"))).alias("before"), F.count_distinct("o_custkey").alias("after"))
    gained = F.col("after") - F.col("before")
    return y.select("family", "before", "after", gained.alias("gained"), F.try_divide(gained * 100, F.col("before")).alias("gained_pct"))


@query(
    "q_readiness",
    """WITH n AS (SELECT n_nationkey, count(c_custkey)::BIGINT AS customers, count(*) FILTER (WHERE c_acctbal < -800)::BIGINT AS deep FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT n_nationkey, list_filter([CASE WHEN customers = 0 THEN 'no source' END, CASE WHEN deep > customers THEN 'inconsistent' END], lambda x: x IS NOT NULL) AS errors,
    list_filter([CASE WHEN customers < 60 THEN 'small sample' END, CASE WHEN deep > 0 THEN 'open cases' END], lambda x: x IS NOT NULL) AS blockers, customers >= 60 AND deep = 0 AS ready FROM n""",
)
def readiness(t: Tables):
    n = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"), F.count_if(F.col("c_acctbal") < -800).alias("deep"))
    found = lambda *cases: F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in cases]))
    errors = found((F.col("customers") == 0, "no source"), (F.col("deep") > F.col("customers"), "inconsistent"))
    blockers = found((F.col("customers") < 60, "small sample"), (F.col("deep") > 0, "open cases"))
    return n.select("n_nationkey", errors.alias("errors"), blockers.alias("blockers"), ((F.size(errors) == 0) & (F.size(blockers) == 0)).alias("ready"))


@query(
    "q_turnout",
    """WITH v AS (SELECT o_custkey % 100 AS place, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS valid, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS rejected, (count(*) * 2)::BIGINT AS registered FROM orders GROUP BY 1)
    SELECT place, valid, rejected, registered, (valid + rejected) * 100 / registered AS turnout FROM v WHERE valid + rejected <= registered""",
)
def turnout(t: Tables):
    v = t.orders.groupBy((F.col("o_custkey") % 100).alias("place")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("valid"), F.count_if(F.col("o_orderstatus") == "P").alias("rejected"), (F.count("*") * 2).alias("registered"))
    cast = F.col("valid") + F.col("rejected")
    return v.filter(cast <= F.col("registered")).select("place", "valid", "rejected", "registered", F.try_divide(cast * 100, F.col("registered")).alias("turnout"))


@query(
    "q_cross_check",
    with_views("""WITH o AS (SELECT o_orderkey, cents, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM per_order JOIN orders USING (o_orderkey)) SELECT o_orderkey, cents, total, cents * 100 / total AS rate FROM o WHERE abs(cents - total) * 100 > 5 * total AND cents < total"""),
)
def cross_check(t: Tables):
    o = t.per_order().join(t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("total")), "o_orderkey")
    return o.filter((F.abs(F.col("cents") - F.col("total")) * 100 > F.col("total") * 5) & (F.col("cents") < F.col("total"))).select("o_orderkey", "cents", "total", F.try_divide(F.col("cents") * 100, F.col("total")).alias("rate"))


@query(
    "q_area_delta",
    "SELECT c_custkey, (5 + c_custkey % 7) * (5 + c_custkey % 11) AS official, (6 + c_custkey % 7) * (5 + c_custkey % 11) AS measured, ((6 + c_custkey % 7) * (5 + c_custkey % 11) - (5 + c_custkey % 7) * (5 + c_custkey % 11)) * 100 / ((5 + c_custkey % 7) * (5 + c_custkey % 11)) AS delta_pct FROM customer",
)
def area_delta(t: Tables):
    from ..functions import geo

    k = F.col("c_custkey")
    w, h = (6 + k % 7).cast("double"), (5 + k % 11).cast("double")
    ring = F.array(*[F.array(x, y) for x, y in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h))])
    official, measured = (5 + k % 7) * (5 + k % 11), geo.ring_area(ring).cast("long")
    return t.customer.select("c_custkey", official.alias("official"), measured.alias("measured"), F.try_divide((measured - official) * 100, official).alias("delta_pct"))


@query(
    "q_pair_deltas",
    with_views("""WITH p AS (SELECT metric, max(value) FILTER (WHERE n_nationkey = 1) AS a, max(value) FILTER (WHERE n_nationkey = 2) AS b FROM latest_obs GROUP BY 1)
    SELECT metric, a, b, b - a AS delta, (b - a) * 100 / nullif(a, 0) AS pct, row_number() OVER (ORDER BY abs((b - a) * 100 / nullif(a, 0)) DESC, metric)::BIGINT AS place FROM p"""),
)
def pair_deltas(t: Tables):
    at = lambda n: F.max(F.when(F.col("n_nationkey") == n, F.col("value")))
    p = t.latest_obs().filter("n_nationkey IN (1, 2)").groupBy("metric").agg(at(1).alias("a"), at(2).alias("b")).withColumn("pct", F.try_divide((F.col("b") - F.col("a")) * 100, F.col("a")))
    return p.withColumn("category", F.lit("all")).select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"), "pct", F.row_number().over(Window.partitionBy("category").orderBy(F.abs("pct").desc(), "metric")).cast("long").alias("place"))


@query(
    "q_compare_places",
    with_views("""WITH o AS (SELECT * FROM obs WHERE n_nationkey IN (3, 4, 5) AND NOT (n_nationkey = 4 AND metric = 'REV' AND yr > 1998) AND NOT (n_nationkey = 5 AND metric = 'QTY')), c AS (SELECT metric, yr FROM o GROUP BY ALL HAVING count(DISTINCT n_nationkey) = 3), s AS (SELECT metric, max(yr) AS shared FROM c GROUP BY 1),
    j AS (SELECT o.*, shared, row_number() OVER (PARTITION BY n_nationkey, o.metric ORDER BY yr DESC) AS k FROM o LEFT JOIN s USING (metric) WHERE shared IS NULL OR yr = shared) SELECT metric, n_nationkey, yr, value, shared IS NOT NULL AS matched FROM j WHERE k = 1"""),
)
def compare_places(t: Tables):
    o = t.obs().filter("n_nationkey IN (3, 4, 5) AND NOT (n_nationkey = 4 AND metric = 'REV' AND yr > 1998) AND NOT (n_nationkey = 5 AND metric = 'QTY')")
    shared = o.groupBy("metric", "yr").agg(F.count_distinct("n_nationkey").alias("c")).filter("c = 3").groupBy("metric").agg(F.max("yr").alias("shared"))
    j = o.join(F.broadcast(shared), "metric", "left").filter("shared IS NULL OR yr = shared")
    return temporal.best(j.withColumn("matched", F.col("shared").isNotNull()), ["metric", "n_nationkey"], [F.col("yr")], ["yr", "value", "matched"])


@query(
    "q_evidence_summary",
    """SELECT lang, count(*)::BIGINT AS documents, count(*) FILTER (WHERE quality = 1)::BIGINT AS verified, count(*) FILTER (WHERE quality = 0)::BIGINT AS rejected, count(*) FILTER (WHERE quality IS NULL)::BIGINT AS unchecked FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars >= 200 GROUP BY 1""",
)
def evidence_summary(t: Tables):
    j = t.documents.filter("n_chars >= 200").select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 1).alias("verified"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("quality").isNull()).alias("unchecked"))


@query(
    "q_place_card",
    with_views("""WITH g AS (SELECT n_nationkey, metric, lifecycle FROM nation, (VALUES ('REV', 'active'), ('QTY', 'active'), ('TAX', 'active'), ('AREA', 'planned'), ('DISC', 'retired')) v(metric, lifecycle)), l AS (SELECT * FROM latest_obs)
    SELECT n_nationkey, metric, CASE WHEN lifecycle = 'planned' THEN 'planned' WHEN lifecycle = 'retired' THEN 'hidden' WHEN value IS NULL THEN 'missing' ELSE 'value' END AS card, CASE WHEN lifecycle = 'active' THEN value END AS value FROM g LEFT JOIN l USING (n_nationkey, metric)"""),
)
def place_card(t: Tables):
    slots = t.values([("REV", "active"), ("QTY", "active"), ("TAX", "active"), ("AREA", "planned"), ("DISC", "retired")], "metric string, lifecycle string")
    l = t.latest_obs().select("n_nationkey", "metric", "value")  # noqa: E741
    g = t.nation.select("n_nationkey").crossJoin(F.broadcast(slots)).join(l, ["n_nationkey", "metric"], "left")
    card = F.when(F.col("lifecycle") == "planned", "planned").when(F.col("lifecycle") == "retired", "hidden").when(F.col("value").isNull(), "missing").otherwise("value")
    return g.select("n_nationkey", "metric", card.alias("card"), F.when(F.col("lifecycle") == "active", F.col("value")).alias("value"))


@query(
    "q_pulse_cards",
    with_views("""WITH o AS (SELECT *, max(yr) OVER (PARTITION BY n_nationkey, metric) AS last FROM obs WHERE (n_nationkey, metric) IN ((1, 'REV'), (2, 'QTY'), (3, 'ORDERS'))) SELECT n_nationkey, metric, list(value ORDER BY yr) AS history, max(yr) AS last_year, arg_max(value, yr) AS latest FROM o WHERE yr >= last - 4 GROUP BY ALL"""),
)
def pulse_cards(t: Tables):
    o = t.obs().filter("(n_nationkey = 1 AND metric = 'REV') OR (n_nationkey = 2 AND metric = 'QTY') OR (n_nationkey = 3 AND metric = 'ORDERS')")
    o = temporal.lookback(o, ["n_nationkey", "metric"], "yr", 4, 2)
    g = o.groupBy("n_nationkey", "metric").agg(F.array_sort(F.collect_list(F.struct("yr", "value"))).alias("h"), F.max("yr").alias("last_year"), F.max_by("value", "yr").alias("latest"))
    return g.select("n_nationkey", "metric", F.transform("h", lambda x: x.value).alias("history"), "last_year", "latest")


@query("q_sparkline", "SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6 GROUP BY 1")
def sparkline(t: Tables):
    k = rank.top_k(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 6)
    return k.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x.event_id).alias("ids"))


@query("q_coverage_ratio", "SELECT n_nationkey, count(DISTINCT c_mktsegment)::BIGINT AS covered, count(DISTINCT c_mktsegment) * 100 / 5 AS pct FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def coverage_ratio(t: Tables):
    j = t.nation.join(t.customer.filter("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_nationkey").agg(F.count_distinct("c_mktsegment").alias("covered")).withColumn("pct", F.col("covered") * 100 / 5)


@query("q_sum_vector", "SELECT sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, sum(CAST(round(l_quantity) AS BIGINT))::BIGINT AS qty, count(*)::BIGINT AS lines, count(DISTINCT l_partkey)::BIGINT AS parts, min(l_linenumber)::BIGINT AS lo, max(l_linenumber)::BIGINT AS hi FROM lineitem")
def sum_vector(t: Tables):
    return t.lineitem.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.round("l_quantity").cast("long")).alias("qty"), F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"), F.min("l_linenumber").cast("long").alias("lo"), F.max("l_linenumber").cast("long").alias("hi"))


@query("q_supersession_queue", "SELECT a.user_id, a.event_type, a.event_id AS superseded, b.event_id AS by FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events) a JOIN events b ON a.nxt = b.event_id WHERE a.value > b.value * 2")
def supersession_queue(t: Tables):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = t.events.withColumns({"by": F.lead("event_id").over(w), "next_value": F.lead("value").over(w)})
    return e.filter(F.col("value") > F.col("next_value") * 2).select("user_id", "event_type", F.col("event_id").alias("superseded"), "by")


#: Triangles on a grid: corners (x, y), (x + 30, y), (x, y + 30) of each supplier.
@query(
    "q_point_in_polygon",
    """WITH p AS (SELECT c_custkey, (c_custkey * 37) % 200 + 0.5 AS x, (c_custkey * 91) % 200 + 0.25 AS y FROM customer), z AS (SELECT s_suppkey, (s_suppkey * 53) % 180 AS x0, (s_suppkey * 29) % 180 AS y0 FROM supplier)
    SELECT c_custkey, s_suppkey FROM p JOIN z ON x > x0 AND y > y0 AND (x - x0) + (y - y0) < 30""",
)
def point_in_polygon(t: Tables):
    return spatial.points_in(pixels(t).drop("value"), triangles(t), 20).select("c_custkey", "s_suppkey")


def pixels(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(k, ((k * 37) % 200 + F.lit(0.5)).cast("double").alias("x"), ((k * 91) % 200 + F.lit(0.25)).cast("double").alias("y"), (k % 10).alias("value"))


def triangles(t: Tables):
    k = F.col("s_suppkey")
    x, y = ((k * 53) % 180).cast("double"), ((k * 29) % 180).cast("double")
    return t.supplier.select(k, F.array(F.array(x, y), F.array(x + 30, y), F.array(x, y + 30)).alias("ring"))


@query(
    "q_zonal_sum",
    """WITH p AS (SELECT c_custkey % 10 AS value, (c_custkey * 37) % 200 + 0.5 AS x, (c_custkey * 91) % 200 + 0.25 AS y FROM customer), z AS (SELECT s_suppkey, (s_suppkey * 53) % 180 AS x0, (s_suppkey * 29) % 180 AS y0 FROM supplier)
    SELECT s_suppkey, coalesce(sum(value), 0)::BIGINT AS total, count(value)::BIGINT AS pixels FROM z LEFT JOIN p ON x > x0 AND y > y0 AND (x - x0) + (y - y0) < 30 GROUP BY 1""",
)
def zonal_sum(t: Tables):
    return spatial.zonal_sum(pixels(t).drop("c_custkey"), triangles(t), "s_suppkey", "value", 20)


@query(
    "q_lanes",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS "start", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS k FROM orders),
    r(o_custkey, k, lane, ends) AS (SELECT o_custkey, k, 0::BIGINT, ["start" + 200] FROM o WHERE k = 1
      UNION ALL SELECT o_custkey, k, lane, ends[1:lane] || ["start" + 200] || ends[lane + 2:] FROM
        (SELECT o.o_custkey, o.k, o."start", r.ends, coalesce(list_position([e < o."start" FOR e IN r.ends], true) - 1, len(r.ends))::BIGINT AS lane FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.k = r.k + 1))
    SELECT o_custkey, o_orderkey, "start", "start" + 200 AS "end", lane FROM o JOIN r USING (o_custkey, k)""",
)
def lanes(t: Tables):
    d = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return spatial.lanes(t.orders.select("o_custkey", "o_orderkey", d.alias("start"), (d + 200).alias("end")), ["o_custkey"], "start", "end", ["o_orderkey"])


@query("q_sibling_unique", "SELECT p_brand || '/' || replace(lower(p_name), ' ', '-') AS key, count(*) || ' rows' AS detail FROM part GROUP BY p_brand, replace(lower(p_name), ' ', '-') HAVING count(*) > 1")
def sibling_unique(t: Tables):
    return rules.unique(t.part.withColumn("slug", F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))), ["p_brand", "slug"])


@query("q_whitespace", r"SELECT p_partkey::VARCHAR AS key, 'white space' AS detail FROM (SELECT p_partkey, CASE WHEN p_size = 50 THEN ' ' || p_name WHEN p_size = 49 THEN replace(p_name, ' ', '  ') WHEN p_size = 48 THEN p_name || ' ' ELSE p_name END AS label FROM part) WHERE regexp_matches(label, '^\s|\s$|[ \t]{2,}')")
def whitespace(t: Tables):
    size, name = F.col("p_size"), F.col("p_name")
    label = F.when(size == 50, F.concat(F.lit(" "), name)).when(size == 49, F.regexp_replace(name, " ", "  ")).when(size == 48, F.concat(name, F.lit(" "))).otherwise(name)
    return rules.holds(t.part.withColumn("label", label), ["p_partkey"], ~F.col("label").rlike(r"^\s|\s$|[ \t]{2,}"), F.lit("white space"))


@query(
    "q_lifecycle",
    """WITH i AS (SELECT p_brand, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'planned' ELSE 'active' END AS lifecycle, count(l_partkey)::BIGINT AS series FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY 1)
    SELECT p_brand AS key, lifecycle || ' with ' || series || ' series' AS detail FROM i WHERE (lifecycle = 'planned' AND series > 0) OR (lifecycle = 'active' AND series = 0)""",
)
def lifecycle(t: Tables):
    lines = t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    i = t.part.join(lines, "p_partkey", "left").groupBy("p_brand").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("series"))
    i = i.withColumn("lifecycle", F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "planned").otherwise("active"))
    ok = F.when(F.col("lifecycle") == "planned", F.col("series") == 0).otherwise(F.col("series") > 0)
    return rules.holds(i, ["p_brand"], ok, F.concat("lifecycle", F.lit(" with "), F.col("series").cast("string"), F.lit(" series")))


@query("q_interval_bounds", "SELECT l_orderkey || '/' || l_linenumber AS key, 'outside its bounds' AS detail FROM lineitem WHERE NOT (l_discount BETWEEN 0.01 AND 0.1 AND l_tax BETWEEN 0 AND 1)")
def interval_bounds(t: Tables):
    return rules.holds(t.lineitem, ["l_orderkey", "l_linenumber"], F.col("l_discount").between(0.01, 0.1) & F.col("l_tax").between(0, 1), F.lit("outside its bounds"))


@query("q_bundle_scope", "SELECT c_custkey::VARCHAR AS key, 'nation ' || c_nationkey || ' in bundle ' || bundle AS detail FROM (SELECT *, CASE WHEN c_acctbal < -900 THEN c_nationkey + 1 ELSE c_nationkey END AS bundle FROM customer) WHERE c_nationkey <> bundle")
def bundle_scope(t: Tables):
    # Customers far in debt were filed with the next nation.
    b = t.customer.withColumn("bundle", F.col("c_nationkey") + F.when(F.col("c_acctbal") < -900, 1).otherwise(0))
    return rules.holds(b, ["c_custkey"], F.col("c_nationkey") == F.col("bundle"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"), F.lit(" in bundle "), F.col("bundle").cast("string")))


@query("q_shared_views", with_views("SELECT n_nationkey, yr, REV::BIGINT AS rev, REV * 100 / sum(REV) OVER (PARTITION BY r_regionkey, yr) AS share, ORDERS - lag(ORDERS) OVER (PARTITION BY n_nationkey ORDER BY yr) AS more FROM wide"))
def shared_views(t: Tables):
    """Nations' years from the session's shared view, which is written once for a snapshot of the tables and read three times here."""
    from ..sources.registry import Registry

    wide = Registry.of(t.spark, t.sf_dir).view("wide", lambda _: t.wide())
    region = wide.groupBy("r_regionkey", "yr").agg(F.sum("REV").alias("all"))
    before = wide.select("n_nationkey", (F.col("yr") + 1).alias("yr"), F.col("ORDERS").alias("before"))
    j = wide.join(region, ["r_regionkey", "yr"]).join(before, ["n_nationkey", "yr"], "left")
    return j.select("n_nationkey", "yr", F.col("REV").alias("rev"), (F.col("REV") * 100 / F.col("all")).alias("share"), (F.col("ORDERS") - F.col("before")).alias("more"))
