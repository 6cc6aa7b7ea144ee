"""Queries over ledgers, portfolios, decisions, freshness and integrity rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import completeness, rank, rules, stats, temporal
from .base import AS_OF, Tables, query, with_views

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LEDGER = """slots AS (SELECT n_nationkey, segment, yr FROM nation, (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS segment), (SELECT unnest(range(1995, 2004))::BIGINT AS yr)),
cells AS (SELECT c_nationkey AS n_nationkey, c_mktsegment AS segment, year(o_orderdate)::BIGINT AS yr, count(*)::BIGINT AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (c_nationkey = 5 AND year(o_orderdate) >= 2000) GROUP BY ALL),
ledger AS (SELECT n_nationkey, segment, yr, value, CASE WHEN value IS NOT NULL THEN 'value' WHEN n_nationkey = 5 AND yr = 2000 THEN 'suppressed' WHEN yr > 2002 THEN 'not applicable' WHEN yr > 2001 THEN 'pending' ELSE 'unavailable' END AS status,
  CASE WHEN value IS NOT NULL THEN NULL WHEN n_nationkey = 5 AND yr = 2000 THEN 'under review' WHEN yr > 2002 THEN 'after the programme' WHEN yr > 2001 THEN 'not yet due' ELSE 'no source publishes it' END AS reason FROM slots LEFT JOIN cells USING (n_nationkey, segment, yr))"""


def ledger(t: Tables):
    slots = t.values([(s, y) for s in SEGMENTS for y in range(1995, 2004)], "segment string, yr long")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").cast("long").alias("yr"))
    cells = rows.filter("NOT (n_nationkey = 5 AND yr >= 2000)").groupBy("n_nationkey", "segment", "yr").agg(F.count("*").alias("value"))
    explicit = t.values([(5, s, 2000, "suppressed", "under review") for s in SEGMENTS], "n_nationkey int, segment string, yr long, state string, reason string")
    structural = [(F.col("yr") > 2002, "not applicable", "after the programme"), (F.col("yr") > 2001, "pending", "not yet due")]
    return completeness.ledger(t.nation.select("n_nationkey"), slots, cells, F.broadcast(explicit), ["n_nationkey", "segment", "yr"], structural)


@query("q_ledger", f"WITH {LEDGER} SELECT * FROM ledger")
def full_ledger(t: Tables):
    return ledger(t)


@query("q_dictionary", f"WITH {LEDGER}, d AS (SELECT reason, count(*)::BIGINT AS cells FROM ledger WHERE reason IS NOT NULL GROUP BY 1) SELECT 'R' || lpad((row_number() OVER (ORDER BY reason))::VARCHAR, 3, '0') AS id, reason, cells FROM d")
def dictionary(t: Tables):
    return completeness.dictionary(ledger(t), "reason", "R")


@query(
    "q_cascade_audit",
    f"WITH {LEDGER} SELECT segment, yr, count(*)::BIGINT AS cells, count(*) FILTER (WHERE status = 'value')::BIGINT AS with_value, count(*) FILTER (WHERE status = 'unavailable')::BIGINT AS unavailable, count(*) = count(*) FILTER (WHERE status = 'value') AS \"full\" FROM ledger GROUP BY ALL",
)
def cascade_audit(t: Tables):
    return completeness.coverage(ledger(t), ["segment", "yr"])


@query(
    "q_conflicts",
    """SELECT l_orderkey, l_linenumber, count(DISTINCT l_linestatus)::BIGINT AS n_values, count(DISTINCT l_suppkey)::BIGINT AS n_lineages, count(*)::BIGINT AS candidates FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linestatus) >= 2 AND count(DISTINCT l_suppkey) >= 2""",
)
def conflicts(t: Tables):
    return completeness.conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], "l_linestatus", "l_suppkey")


@query(
    "q_tiering",
    """SELECT source, count(*)::BIGINT AS n, CASE WHEN source IN ('src0', 'src1') THEN 'S0' WHEN regexp_matches(source, '^src[2-5]$') THEN 'S1' WHEN count(*) > 40 THEN 'S2' WHEN source IS NULL THEN 'S6' ELSE 'S3' END AS tier,
    CASE WHEN source IN ('src0', 'src1') THEN 'high' WHEN regexp_matches(source, '^src[2-5]$') THEN 'high' WHEN count(*) > 40 THEN 'medium' ELSE 'low' END AS confidence FROM documents GROUP BY source""",
)
def tiering(t: Tables):
    d = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    tier = F.when(F.col("source").isin("src0", "src1"), "S0").when(F.col("source").rlike("^src[2-5]$"), "S1").when(F.col("n") > 40, "S2").when(F.col("source").isNull(), "S6").otherwise("S3")
    return d.withColumn("tier", tier).withColumn("confidence", F.when(F.col("tier").isin("S0", "S1"), "high").when(F.col("tier") == "S2", "medium").otherwise("low"))


@query(
    "q_consensus",
    """WITH c AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (PARTITION BY user_id, day)::BIGINT AS votes, rank() OVER (PARTITION BY user_id, day ORDER BY n DESC) AS rk FROM c WINDOW w AS (PARTITION BY user_id, day ORDER BY n DESC, event_type)),
    l AS (SELECT user_id, day, count(*) FILTER (WHERE rk = 1) AS leaders FROM r GROUP BY ALL) SELECT user_id, day, event_type AS winner, n, votes, leaders = 1 AS clear FROM r JOIN l USING (user_id, day) WHERE k = 1""",
)
def consensus(t: Tables):
    e = t.events.select("user_id", F.unix_date(F.col("ts").cast("date")).cast("long").alias("day"), "event_type")
    return stats.majority(e, ["user_id", "day"], "event_type")


PORTFOLIO = """b AS (SELECT p_brand, p_type, count(*)::BIGINT AS cells, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 3 WHEN p_type = 'LARGE' THEN 2 ELSE 1 END AS tier FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
pf AS (SELECT *, row_number() OVER (ORDER BY tier DESC, cells DESC, p_brand, p_type)::BIGINT AS place FROM b)"""


def portfolio(t: Tables):
    b = t.lineitem.join(t.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(F.count("*").alias("cells"))
    b = b.withColumn("tier", F.when(F.col("p_type").isin("ECONOMY", "PROMO"), 3).when(F.col("p_type") == "LARGE", 2).otherwise(1)).withColumn("board", F.lit("all"))
    return b.withColumn("place", F.row_number().over(Window.partitionBy("board").orderBy(F.desc("tier"), F.desc("cells"), "p_brand", "p_type")).cast("long"))


@query("q_portfolio", f"WITH {PORTFOLIO} SELECT * FROM pf")
def portfolio_ranking(t: Tables):
    return portfolio(t).select("p_brand", "p_type", "cells", "tier", "place")


@query(
    "q_tranche",
    f"""WITH {PORTFOLIO}, f AS (SELECT right(p_brand, 1) AS family, min(place) AS best FROM pf GROUP BY 1 ORDER BY best LIMIT 3)
    SELECT p_brand, p_type, cells, place FROM pf WHERE right(p_brand, 1) IN (SELECT family FROM f) ORDER BY place LIMIT 10""",
)
def tranche(t: Tables):
    p = portfolio(t).withColumn("family", F.right("p_brand", F.lit(1)))
    return completeness.tranche(p, ["board"], "family", "place", 10, 3).select("p_brand", "p_type", "cells", "place")


POLICY = [("AUTOMOBILE", "census", "count|allocate"), ("BUILDING", "survey", "model"), ("FURNITURE", "survey", "wait"), ("HOUSEHOLD", "none", "wait")]


@query(
    "q_decision_table",
    f"""WITH p AS (SELECT * FROM (VALUES {', '.join(map(str, POLICY))}) v(segment, source, allowed)), c AS (SELECT c_mktsegment AS segment, c_nationkey AS n_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY ALL)
    SELECT c.segment, n_nationkey, n, CASE WHEN source IS NULL THEN 'undecided' WHEN source = 'census' AND n >= 10 AND list_contains(string_split(allowed, '|'), 'count') THEN 'count' WHEN source = 'census' AND list_contains(string_split(allowed, '|'), 'allocate') THEN 'allocate'
    WHEN source = 'survey' AND n >= 8 AND list_contains(string_split(allowed, '|'), 'model') THEN 'model' ELSE 'wait' END AS method FROM c LEFT JOIN p USING (segment)""",
)
def decision_table(t: Tables):
    p = t.values(POLICY, "segment string, source string, allowed string").withColumn("allowed", F.split("allowed", r"\|"))
    c = t.customer.groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(F.broadcast(p), "segment", "left")
    may = lambda m: F.array_contains("allowed", m)
    method = F.when(F.col("source").isNull(), "undecided").when((F.col("source") == "census") & (F.col("n") >= 10) & may("count"), "count").when((F.col("source") == "census") & may("allocate"), "allocate")
    return c.select("segment", "n_nationkey", "n", method.when((F.col("source") == "survey") & (F.col("n") >= 8) & may("model"), "model").otherwise("wait").alias("method"))


@query(
    "q_eligibility",
    """WITH s AS (SELECT p_brand, p_partkey, regexp_matches(p_name, '(ring|bolt)$') OR p_type = 'PROMO' OR p_size <= 45 AS ok FROM part) SELECT p_brand, count(*)::BIGINT AS series, count(*) FILTER (WHERE ok)::BIGINT AS eligible_series, bool_and(ok) AS eligible FROM s GROUP BY 1""",
)
def eligibility(t: Tables):
    ok = F.col("p_name").rlike("(ring|bolt)$") | (F.col("p_type") == "PROMO") | (F.col("p_size") <= 45)
    return t.part.groupBy("p_brand").agg(F.count("*").alias("series"), F.count_if(ok).alias("eligible_series"), F.bool_and(ok).alias("eligible"))


INTERVALS = [("AUTOMOBILE", 30), ("BUILDING", 90), ("FURNITURE", 200), ("HOUSEHOLD", 365)]


@query(
    "q_freshness",
    f"""WITH i AS (SELECT * FROM (VALUES {', '.join(map(str, INTERVALS))}) v(segment, days)), l AS (SELECT c_nationkey AS n_nationkey, c_mktsegment AS segment, max(o_orderdate)::DATE AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT n_nationkey, l.segment, date_diff('day', last, DATE '{AS_OF}')::BIGINT AS age, CASE WHEN days IS NULL THEN 'no schedule' WHEN date_diff('day', last, DATE '{AS_OF}') > days THEN 'due' ELSE 'current' END AS state FROM l LEFT JOIN i USING (segment)""",
)
def freshness(t: Tables):
    i = t.values(INTERVALS, "segment string, days int")
    l = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last"))  # noqa: E741
    age = F.date_diff(F.lit(AS_OF).cast("date"), "last").cast("long")
    return l.join(F.broadcast(i), "segment", "left").select("n_nationkey", "segment", age.alias("age"), F.when(F.col("days").isNull(), "no schedule").when(age > F.col("days"), "due").otherwise("current").alias("state"))


@query(
    "q_staleness",
    f"""WITH l AS (SELECT o_custkey AS c_custkey, max(year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS m FROM orders GROUP BY 1) SELECT c_custkey, (2001 * 12 + 12 - m)::BIGINT AS months, 2001 * 12 + 12 - m <= 6 AS current FROM l""",
)
def staleness(t: Tables):
    months = F.lit(2001 * 12 + 12) - F.max(text.month_index(F.col("o_orderdate")))
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(months.cast("long").alias("months"), (months <= 6).alias("current"))


@query(
    "q_effective_state",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') > 400 THEN 'review_due' WHEN o_orderstatus = 'O' THEN 'live' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'planned' END AS state FROM orders""",
)
def effective_state(t: Tables):
    old = F.date_diff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")) > 400
    return t.orders.select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & old, "review_due").when(F.col("o_orderstatus") == "O", "live").when(F.col("o_orderstatus") == "F", "closed").otherwise("planned").alias("state"))


@query(
    "q_reaudit",
    f"WITH {LEDGER} SELECT n_nationkey, reason, count(*)::BIGINT AS cells, list_sort(list(DISTINCT segment)) AS segments, min(yr) AS first_year FROM ledger WHERE status IN ('unavailable', 'suppressed') GROUP BY ALL",
)
def reaudit(t: Tables):
    return ledger(t).filter(F.col("status").isin("unavailable", "suppressed")).groupBy("n_nationkey", "reason").agg(F.count("*").alias("cells"), F.array_sort(F.collect_set("segment")).alias("segments"), F.min("yr").alias("first_year"))


@query(
    "q_dashboard",
    f"""WITH {LEDGER}, g AS (SELECT 'cells' AS gate, count(*)::BIGINT AS value, 1125 AS target, count(*) = 1125 AS passed FROM ledger UNION ALL SELECT 'unresolved', count(*) FILTER (WHERE status = 'unavailable')::BIGINT, 0, count(*) FILTER (WHERE status = 'unavailable') = 0 FROM ledger
    UNION ALL SELECT 'with value', count(*) FILTER (WHERE status = 'value')::BIGINT, NULL, NULL FROM ledger) SELECT gate, value, target::BIGINT AS target, passed, (SELECT bool_and(passed) FROM g) AS all_passed FROM g""",
)
def dashboard(t: Tables):
    s = ledger(t).agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "unavailable").alias("unresolved"), F.count_if(F.col("status") == "value").alias("with_value"))
    none, long = F.lit(None).cast("boolean"), F.lit(None).cast("long")
    rows = F.array(
        F.struct(F.lit("cells").alias("gate"), F.col("cells").alias("value"), F.lit(1125).cast("long").alias("target"), (F.col("cells") == 1125).alias("passed")),
        F.struct(F.lit("unresolved").alias("gate"), F.col("unresolved").alias("value"), F.lit(0).cast("long").alias("target"), (F.col("unresolved") == 0).alias("passed")),
        F.struct(F.lit("with value").alias("gate"), F.col("with_value").alias("value"), long.alias("target"), none.alias("passed")),
    )
    passed = F.forall(rows, lambda r: F.coalesce(r.passed, F.lit(True)))  # a gate without a target doesn't count
    return s.select(F.explode(rows).alias("r"), passed.alias("all_passed")).select("r.*", "all_passed")


@query(
    "q_buckets",
    """SELECT CASE WHEN c_acctbal IS NULL THEN NULL WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS bucket, count(*)::BIGINT AS n FROM customer GROUP BY 1""",
)
def buckets(t: Tables):
    return t.customer.groupBy(stats.buckets(F.col("c_acctbal"), [0, 1000, 5000], ["debt", "low", "middle", "high"]).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "q_ratio_check",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(p_retailprice * 100) AS BIGINT) AS list FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, cents / nullif(qty * list, 0) AS ratio FROM r WHERE cents > 3 * qty * list""",
)
def ratio_check(t: Tables):
    cents, qty, price = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round("l_quantity").cast("long"), F.round(F.col("p_retailprice") * 100).cast("long")
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", cents.alias("c"), qty.alias("q"), price.alias("p"))
    return j.filter("c > 3 * q * p").select("l_orderkey", "l_linenumber", "l_partkey", F.try_divide("c", F.col("q") * F.col("p")).alias("ratio"))


@query(
    "q_quality_rules",
    """SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'no price' WHEN o_totalprice > 450000 THEN 'price out of range' WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'pending for too long' END AS reason FROM orders
    WHERE o_totalprice <= 0 OR o_totalprice > 450000 OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01')""",
)
def quality_rules(t: Tables):
    reason = rank.gate([(F.col("o_totalprice") <= 0, "no price"), (F.col("o_totalprice") > 450000, "price out of range"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < "1996-01-01"), "pending for too long")])
    return t.orders.select("o_orderkey", reason.alias("reason")).filter("reason IS NOT NULL")


@query("q_duplicates", "SELECT l_orderkey || '/' || l_linenumber AS key, count(*) || ' rows' AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicates(t: Tables):
    return rules.unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "q_denorm_check",
    """SELECT c_custkey::VARCHAR AS key, c.n || ' <> ' || n_regionkey AS detail FROM (SELECT c_custkey, c_nationkey, (c_nationkey + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END) % 5 AS n FROM customer) c JOIN nation ON c_nationkey = n_nationkey WHERE c.n <> n_regionkey""",
)
def denorm_check(t: Tables):
    # A copy of the region on customers, wrong for every fiftieth.
    c = t.customer.withColumn("region_copy", (F.col("c_nationkey") + F.when(F.col("c_custkey") % 50 == 0, 1).otherwise(0)) % 5)
    return rules.same_as_parent(c, ["c_custkey"], "c_nationkey", "region_copy", t.nation, "n_nationkey", "n_regionkey")


@query("q_conditional_required", "SELECT doc_id::VARCHAR AS key, 'note is required' AS detail FROM (SELECT doc_id, lang, nullif(source, 'src7') AS note FROM documents) WHERE lang <> 'en' AND note IS NULL")
def conditional_required(t: Tables):
    d = t.documents.select("doc_id", "lang", F.nullif("source", F.lit("src7")).alias("note"))
    return rules.required_if(d, ["doc_id"], F.col("lang") != "en", "note")


@query("q_rederive", "SELECT doc_id, n_chars AS stored, length(text)::BIGINT AS derived FROM (SELECT doc_id, text, n_chars + CASE WHEN doc_id % 200 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents) WHERE n_chars <> length(text)")
def rederive(t: Tables):
    d = t.documents.select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 200 == 0, 1).otherwise(0)).alias("stored"), F.length("text").cast("long").alias("derived"))
    return d.filter(~F.col("stored").eqNullSafe(F.col("derived")))


@query("q_temporal_sanity", "SELECT l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS key, date_diff('day', o_orderdate, l_shipdate)::VARCHAR AS detail FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def temporal_sanity(t: Tables):
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rules.holds(j, ["l_orderkey", "l_linenumber", "l_suppkey"], F.col("l_shipdate") >= F.col("o_orderdate"), F.date_diff("l_shipdate", "o_orderdate"))


@query("q_forbidden_methods", "SELECT event_id::VARCHAR AS key, method AS detail FROM (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'Parent_Rate' WHEN event_id % 103 = 0 THEN 'equal_share' ELSE event_type END AS method FROM events) WHERE lower(method) IN ('inherited', 'copied', 'downscaled', 'equal_share', 'parent_rate')")
def forbidden_methods(t: Tables):
    e = t.events.select("event_id", F.when(F.col("event_id") % 101 == 0, "Parent_Rate").when(F.col("event_id") % 103 == 0, "equal_share").otherwise(F.col("event_type")).alias("method"))
    return rules.forbidden(e, ["event_id"], "method", ["inherited", "copied", "downscaled", "equal_share", "parent_rate"])


@query(
    "q_rule_report",
    """WITH v AS (SELECT 'IR-02' AS rule, 'error' AS severity, o_orderkey::VARCHAR AS key, 'o_custkey ' || o_custkey || ' unknown' AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -950)
    UNION ALL SELECT 'IR-04', 'warning', o_orderkey::VARCHAR, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')),
    k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY key, detail) AS k, count(*) OVER (PARTITION BY rule) AS n FROM v) SELECT rule, severity, key, detail, greatest(n - 60, 0)::BIGINT AS suppressed FROM k WHERE k <= 60""",
)
def rule_report(t: Tables):
    known = t.customer.filter("c_acctbal > -950")
    found = rules.check([
        rules.Rule("IR-02", "error", lambda: rules.foreign_key(t.orders, ["o_orderkey"], "o_custkey", known, "c_custkey")),
        rules.Rule("IR-04", "warning", lambda: rules.member(t.orders, ["o_orderkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])),
    ])
    return rules.capped(found, 60)
