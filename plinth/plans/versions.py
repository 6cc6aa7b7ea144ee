"""Queries over versions, aggregates, gates and cell repair."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text
from ..operators import rank, stats, temporal
from .base import Tables, query, with_views


def superseding(t: Tables):
    """Events as versions: a user's next event of the same type supersedes the one before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", "event_type", "ts", "value").withColumn("supersedes", F.lag("event_id").over(w))


SUPER = "v AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes FROM events)"


@query("q_active_obs", f"WITH {SUPER} SELECT event_id, user_id, event_type FROM v WHERE event_id NOT IN (SELECT supersedes FROM v WHERE supersedes IS NOT NULL)")
def active_obs(t: Tables):
    return temporal.active(superseding(t), "event_id", "supersedes").select("event_id", "user_id", "event_type")


@query("q_revisions", f"WITH {SUPER} SELECT event_id, user_id, event_type FROM v WHERE event_id IN (SELECT supersedes FROM v WHERE supersedes IS NOT NULL)")
def revisions(t: Tables):
    return temporal.revisions(superseding(t), "event_id", "supersedes").select("event_id", "user_id", "event_type")


@query("q_latest_pair", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_pair(t: Tables):
    return temporal.best(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id", "value"])


@query("q_pinned_latest", "SELECT user_id, event_type, arg_max(event_id, (event_id % 7 = 0, ts, event_id)) AS event_id, bool_or(event_id % 7 = 0) AS pinned FROM events GROUP BY ALL")
def pinned_latest(t: Tables):
    e = t.events.select("user_id", "event_type", "event_id", "ts", (F.col("event_id") % 7 == 0).alias("pinned"))
    return temporal.pinned_or_latest(e, ["user_id", "event_type"], ["ts", "event_id"], F.col("pinned")).select("user_id", "event_type", "event_id", "pinned")


@query(
    "q_choose_series",
    """WITH s AS (SELECT user_id, event_type, max(epoch_us(ts)) AS newest, count(*)::BIGINT AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, newest, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, n DESC, event_type) AS k FROM s) WHERE k = 1""",
)
def choose_series(t: Tables):
    return temporal.choose_series(t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], "event_type", "us")


@query(
    "q_canonical_period",
    """SELECT conv_id, role, turn FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY (turn % 3 = 0), turn DESC) AS k FROM conversations) WHERE k = 1""",
)
def canonical_period(t: Tables):
    return temporal.canonical(t.conversations.select("conv_id", "role", "turn"), ["conv_id", "role"], F.col("turn") % 3 == 0, ["turn"])


@query(
    "q_primary_alternate",
    with_views("""WITH p AS (SELECT n_nationkey, max(yr) AS py FROM wide GROUP BY 1), a AS (SELECT n_nationkey, max(yr) AS ay FROM wide WHERE n_nationkey % 3 <> 0 AND (n_nationkey % 2 = 1 OR yr < 2001) GROUP BY 1)
    SELECT n_nationkey, py AS primary_year, ay AS alternate_year, CASE WHEN ay IS NULL THEN 'primary' WHEN ay > py THEN 'alternate' WHEN ay = py AND n_nationkey % 4 = 1 THEN 'alternate' ELSE 'primary' END AS chosen FROM p LEFT JOIN a USING (n_nationkey)"""),
)
def primary_alternate(t: Tables):
    # The alternate wins if it is newer, or as new where the primary isn't harmonised (nations 1, 5, 9, ...).
    wide = t.wide()
    p = wide.groupBy("n_nationkey").agg(F.max("yr").alias("primary_year"))
    a = wide.filter("n_nationkey % 3 <> 0 AND (n_nationkey % 2 = 1 OR yr < 2001)").groupBy("n_nationkey").agg(F.max("yr").alias("alternate_year"))
    newer = (F.col("alternate_year") > F.col("primary_year")) | ((F.col("alternate_year") == F.col("primary_year")) & (F.col("n_nationkey") % 4 == 1))
    return p.join(a, "n_nationkey", "left").withColumn("chosen", F.when(newer, "alternate").otherwise("primary"))


@query("q_dedup_last", "SELECT conv_id, role, max(turn) AS turn, arg_max(length(text), turn)::BIGINT AS n_chars FROM conversations GROUP BY ALL")
def dedup_last(t: Tables):
    return temporal.best(t.conversations, ["conv_id", "role"], [F.col("turn")]).select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"))


@query(
    "q_rollup",
    """SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id, count(*)::BIGINT AS n, max(epoch_us(ts)) AS last_updated FROM events GROUP BY ALL""",
)
def rollup(t: Tables):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"), F.count("*").alias("n"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_updated"))


@query("q_status_counts", "SELECT o_orderstatus, year(o_orderdate)::BIGINT AS yr, count(*)::BIGINT AS n, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS n_high, count(DISTINCT o_custkey)::BIGINT AS n_customers FROM orders GROUP BY ALL")
def status_counts(t: Tables):
    return t.orders.groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("yr")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_high"), F.count_distinct("o_custkey").alias("n_customers"))


@query("q_set_per_group", "SELECT c_nationkey AS n_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY ALL")
def set_per_group(t: Tables):
    return t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))


@query(
    "q_coverage_matrix",
    """SELECT c_mktsegment, n_regionkey, count(*)::BIGINT AS cells, count(*) FILTER (WHERE c_acctbal >= 0)::BIGINT AS n_numeric, count(*) FILTER (WHERE c_acctbal < 0)::BIGINT AS n_closed,
    list_sort(list(DISTINCT CASE WHEN c_acctbal < -500 THEN 'deep' WHEN c_acctbal < 0 THEN 'shallow' END) FILTER (WHERE c_acctbal < 0)) AS reasons FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def coverage_matrix(t: Tables):
    reason = F.when(F.col("c_acctbal") < -500, "deep").when(F.col("c_acctbal") < 0, "shallow")
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    out = j.groupBy("c_mktsegment", "n_regionkey").agg(F.count("*").alias("cells"), F.count_if(F.col("c_acctbal") >= 0).alias("n_numeric"), F.count_if(F.col("c_acctbal") < 0).alias("n_closed"), F.array_sort(F.collect_set(reason)).alias("reasons"))
    return out.withColumn("reasons", F.when(F.col("n_closed") > 0, F.col("reasons")))


@query("q_child_to_parent", with_views("SELECT r_regionkey, yr, sum(REV)::BIGINT AS rev, sum(ORDERS)::BIGINT AS orders, count(*)::BIGINT AS children FROM wide GROUP BY ALL"))
def child_to_parent(t: Tables):
    return t.wide().groupBy("r_regionkey", "yr").agg(F.sum("REV").alias("rev"), F.sum("ORDERS").alias("orders"), F.count("*").alias("children"))


@query("q_rollup_sets", with_views("SELECT r_regionkey, n_nationkey, yr, sum(REV)::BIGINT AS rev, grouping(r_regionkey, n_nationkey, yr)::BIGINT AS level FROM wide GROUP BY ROLLUP (r_regionkey, n_nationkey, yr)"))
def rollup_sets(t: Tables):
    return t.wide().rollup("r_regionkey", "n_nationkey", "yr").agg(F.sum("REV").alias("rev"), F.grouping_id().cast("long").alias("level"))


@query(
    "q_reconcile",
    with_views("""WITH g AS (SELECT yr, sum(rev)::BIGINT AS whole FROM sales GROUP BY yr), n AS (SELECT yr, sum(REV)::BIGINT AS nations FROM wide GROUP BY yr)
    SELECT yr, whole, nations, (whole - nations)::BIGINT AS diff FROM g JOIN n USING (yr)"""),
)
def reconcile(t: Tables):
    whole = t.per_order().join(t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("yr")), "o_orderkey").groupBy("yr").agg(F.sum("rev").alias("whole"))
    nations = t.wide().groupBy("yr").agg(F.sum("REV").alias("nations"))
    return whole.join(nations, "yr").withColumn("diff", F.col("whole") - F.col("nations"))


@query(
    "q_gate_split",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'held: under review' ELSE 'held: incomplete' END AS outcome, count(*)::BIGINT AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY ALL""",
)
def gate_split(t: Tables):
    outcome = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "held: under review").otherwise("held: incomplete")
    return t.orders.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query(
    "q_obs_view",
    """SELECT o_orderkey, year(o_orderdate)::BIGINT AS yr, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), c_mktsegment, 'none') AS method, c_mktsegment AS source, n_name AS agency, r_name AS owner,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(round(c_acctbal * 100) AS BIGINT) END AS lower_cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def obs_view(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.places()), F.col("c_nationkey") == F.col("n_nationkey"))
    provenance = F.struct(F.col("c_mktsegment").alias("source"), F.col("n_name").alias("agency"), F.col("r_name").alias("owner"))
    lower = F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") * 100).cast("long"))
    uncertainty = F.when(lower.isNotNull(), F.struct(lower.alias("lower_cents")))
    v = j.select("o_orderkey", F.year("o_orderdate").cast("long").alias("yr"), F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), "c_mktsegment", F.lit("none")).alias("method"), provenance.alias("p"), uncertainty.alias("u"))
    return v.select("o_orderkey", "yr", "method", "p.*", "u.lower_cents")


FIXES = [("NATION_3", "n_regionkey", 3, 4), ("NATION_7", "n_regionkey", 1, 0), ("NATION_9", "n_regionkey", 4, 2)]


@query(
    "q_corrections",
    f"""WITH f AS (SELECT * FROM (VALUES {', '.join(map(str, FIXES))}) v(name, field, was, now))
    SELECT n_nationkey, n_name, CASE WHEN now IS NOT NULL AND was = n_regionkey THEN now ELSE n_regionkey END::INT AS n_regionkey, coalesce(was = n_regionkey, false) AS corrected FROM nation LEFT JOIN f ON n_name = name""",
)
def corrections(t: Tables):
    fixes = t.values(FIXES, "name string, field string, was int, now int")
    j = t.nation.join(F.broadcast(fixes.filter("field = 'n_regionkey'")), F.col("n_name") == F.col("name"), "left")
    hit = F.coalesce(F.col("was") == F.col("n_regionkey"), F.lit(False))
    return j.select("n_nationkey", "n_name", F.when(hit, F.col("now")).otherwise(F.col("n_regionkey")).alias("n_regionkey"), hit.alias("corrected"))


#: Cells as they are found: numbers of customers, spaced, signed and marked, and what stands for nothing.
IDS = """CASE c_custkey % 9 WHEN 0 THEN '#N/A' WHEN 1 THEN concat(' 0', {0}, ' ') WHEN 2 THEN '#REF!' WHEN 3 THEN '' WHEN 4 THEN concat({0}, 'a') WHEN 5 THEN concat('-', {0}) WHEN 6 THEN concat('1,', {0}) ELSE {0} END"""


@query(
    "q_try_parse",
    f"""SELECT c_custkey, raw, CASE WHEN regexp_full_match(trim(raw), '[0-9]{{1,9}}') THEN trim(raw)::BIGINT END AS id,
    CASE WHEN trim(raw) = '' THEN 'empty' WHEN trim(raw) IN ('#N/A', '#REF!', '#VALUE!', '#DIV/0!', '#NAME?', '#NULL!', '#NUM!') THEN 'sentinel' WHEN NOT regexp_full_match(trim(raw), '[0-9]{{1,9}}') THEN 'not a number' END AS note
    FROM (SELECT c_custkey, {IDS.format('CAST(c_custkey AS VARCHAR)')} AS raw FROM customer)""",
)
def try_parse(t: Tables):
    value, note = text.parse_id(F.col("raw"))
    return t.customer.select("c_custkey", F.expr(IDS.format("CAST(c_custkey AS STRING)")).alias("raw")).select("c_custkey", "raw", value.alias("id"), note.alias("note"))


NUMBERS = """CASE c_custkey % 7 WHEN 0 THEN concat('(', {0}, ')') WHEN 1 THEN concat({0}, '%') WHEN 2 THEN '-' WHEN 3 THEN '#N/A' WHEN 4 THEN concat('1,', lpad({0}, 3, '0')) WHEN 5 THEN '' ELSE concat({0}, '.5') END"""
UNITS = "CASE c_nationkey % 5 WHEN 0 THEN 'million' WHEN 1 THEN 'KSh billion' WHEN 2 THEN 'thousand' WHEN 3 THEN 'percent' ELSE 'm' END"


@query(
    "q_clean_num",
    f"""WITH n AS (SELECT c_custkey, {NUMBERS.format('CAST(c_custkey % 1000 AS VARCHAR)')} AS raw, {UNITS} AS unit FROM customer),
    c AS (SELECT *, CASE WHEN trim(raw) IN ('', '-') THEN NULL WHEN trim(raw) LIKE '(%)' THEN -try_cast(regexp_replace(raw, '[,%\\s()]', '', 'g') AS DOUBLE) ELSE try_cast(regexp_replace(raw, '[,%\\s()]', '', 'g') AS DOUBLE) END AS value FROM n)
    SELECT c_custkey, raw, unit, value, value * CASE WHEN regexp_matches(lower(unit), '\\b(bn|billion)\\b') THEN 1e9 WHEN regexp_matches(lower(unit), '\\b(mn|million|m)\\b') THEN 1e6 WHEN regexp_matches(lower(unit), '\\b(thousand|k)\\b') THEN 1e3 ELSE 1.0 END AS scaled FROM c""",
)
def clean_num(t: Tables):
    rows = t.customer.select("c_custkey", F.expr(NUMBERS.format("CAST(c_custkey % 1000 AS STRING)")).alias("raw"), F.expr(UNITS).alias("unit"))
    v = rows.withColumn("value", text.clean_number(F.col("raw")))
    return v.withColumn("scaled", text.scaled_by_words(F.col("value"), F.col("unit")))


@query("q_facet_filter", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') AND p_type = 'ECONOMY' AND p_size <= 25")
def facet_filter(t: Tables):
    # Equality and range facets reach the scan; the text test runs on what is left.
    return t.part.filter((F.col("p_type") == "ECONOMY") & (F.col("p_size") <= 25)).filter(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("ring")).select("p_partkey", "p_name", "p_brand")


@query(
    "q_rank_gate",
    with_views("""WITH g AS (SELECT metric, yr, count(*)::BIGINT AS n, min(value) AS lo, max(value) AS hi FROM obs WHERE NOT (metric = 'ORDERS' AND value < 90) GROUP BY ALL),
    r AS (SELECT *, CASE WHEN n < 25 THEN 'incomplete coverage' WHEN lo = hi THEN 'no variation' WHEN yr = 2001 THEN 'partial year' END AS reason FROM g)
    SELECT metric, yr, n, reason, reason IS NULL AS eligible FROM r"""),
)
def rank_gate(t: Tables):
    g = t.obs().filter("NOT (metric = 'ORDERS' AND value < 90)").groupBy("metric", "yr").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    reason = rank.gate([(F.col("n") < 25, "incomplete coverage"), (F.col("lo") == F.col("hi"), "no variation"), (F.col("yr") == 2001, "partial year")])
    return g.withColumn("reason", reason).select("metric", "yr", "n", "reason", F.col("reason").isNull().alias("eligible"))


def spent(t: Tables, year: int):
    """Orders a customer placed in a year."""
    return t.orders.filter((F.col("o_orderdate") >= f"{year}-01-01") & (F.col("o_orderdate") < f"{year + 1}-01-01")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("status"))


SPENT = ", ".join(f"s{y} AS (SELECT o_custkey AS c_custkey, count(*)::BIGINT AS n, max(o_orderstatus) AS status FROM orders WHERE year(o_orderdate) = {y} GROUP BY 1)" for y in (1995, 1996))


@query(
    "q_snapshot_diff",
    f"""WITH {SPENT} SELECT c_custkey, a.n AS old, b.n AS new, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS state FROM s1995 a FULL JOIN s1996 b USING (c_custkey)""",
)
def snapshot_diff(t: Tables):
    return temporal.snapshot_diff(spent(t, 1995), spent(t, 1996), "c_custkey", "n")


@query("q_upsert", f"WITH {SPENT} SELECT c_custkey, coalesce(b.n, a.n) AS n, coalesce(nullif(b.status, 'P'), a.status) AS status FROM s1995 a FULL JOIN s1996 b USING (c_custkey)")
def upsert(t: Tables):
    new = spent(t, 1996).withColumn("status", F.nullif("status", F.lit("P")))
    return temporal.upsert(spent(t, 1995), new, "c_custkey")


@query("q_insert_absent", f"WITH {SPENT} SELECT * FROM s1995 UNION ALL SELECT * FROM s1996 WHERE c_custkey NOT IN (SELECT c_custkey FROM s1995)")
def insert_absent(t: Tables):
    return temporal.insert_absent(spent(t, 1995), spent(t, 1996), ["c_custkey"])


@query("q_replace_prefix", "SELECT c_name, c_nationkey FROM customer WHERE c_name NOT LIKE 'Customer#0000001%' UNION ALL SELECT 'Customer#0000001/' || s_suppkey, s_nationkey FROM supplier")
def replace_prefix(t: Tables):
    new = t.supplier.select(F.concat(F.lit("Customer#0000001/"), F.col("s_suppkey").cast("string")).alias("c_name"), F.col("s_nationkey").alias("c_nationkey"))
    return temporal.replace_prefix(t.customer.select("c_name", "c_nationkey"), new, "c_name", "Customer#0000001")


@query(
    "q_clone_insert",
    """WITH k AS (SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1)
    SELECT user_id, event_id, event_type, value FROM events UNION ALL SELECT user_id, -1 - user_id, event_type, value FROM k""",
)
def clone_insert(t: Tables):
    old = t.events.select("user_id", "event_id", "event_type", "value")
    new = old.select("user_id").distinct().withColumn("event_id", -1 - F.col("user_id"))
    return temporal.clone_insert(old, new, "user_id", ["event_id"], ["event_type", "value"])


@query(
    "q_asof",
    """SELECT p.event_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts) AS viewed FROM events p WHERE p.event_type = 'purchase'""",
)
def asof(t: Tables):
    e = t.events.select("user_id", "event_type", "event_id", "ts")
    views = e.filter("event_type = 'view'").withColumn("view_id", F.col("event_id"))
    return temporal.asof(e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), views, ["user_id"], "ts", "view_id").select("event_id", F.col("asof").alias("viewed"))
