"""Queries over scalar functions, search, exports and supplementary operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import completeness, export, gates, rank, stats
from ..sources import readers
from .base import Tables, query, with_views

NAMES = ["Taita  Taveta", "Murang'a", "Trans-Nzoia & West", "  North/South  ", "Homa Bay (town)", "O'Brien’s"]


def values_sql(rows, columns: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r if isinstance(r, tuple) else (r,))) + ')' for r in rows)}) v({columns})"


NORMAL = "trim(regexp_replace(regexp_replace(replace(lower({}), '&', ' and '), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("q_normalize", f"SELECT raw, {NORMAL.format('raw')} AS normalised, replace({NORMAL.format('raw')}, ' ', '-') AS slug, regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g') AS file_key FROM (SELECT * FROM {values_sql(NAMES, 'raw')} UNION ALL SELECT DISTINCT '  ' || p_name || ' & ' || p_brand || chr(39) || 's (' || p_type || ')' FROM part)")
def normalize(t: Tables):
    raw = F.col("raw")
    parts = t.part.select(F.concat(F.lit("  "), "p_name", F.lit(" & "), "p_brand", F.lit("'s ("), "p_type", F.lit(")")).alias("raw")).distinct()
    return t.values([(x,) for x in NAMES], "raw string").unionByName(parts).select("raw", text.normalise_name(raw).alias("normalised"), text.slug(raw).alias("slug"), text.file_key(raw).alias("file_key"))


@query(
    "q_codes",
    """SELECT n_nationkey, 'R' || lpad(n_regionkey::VARCHAR, 2, '0') || '-N' || lpad(n_nationkey::VARCHAR, 3, '0') AS code, upper(left(n_name, 1)) || lower(substring(n_name, 2)) AS title,
    n_nationkey || CASE WHEN n_nationkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n_nationkey % 10 = 1 THEN 'st' WHEN n_nationkey % 10 = 2 THEN 'nd' WHEN n_nationkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM nation""",
)
def codes(t: Tables):
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return t.nation.select("n_nationkey", F.concat(F.lit("R"), pad("n_regionkey", 2), F.lit("-N"), pad("n_nationkey", 3)).alias("code"), F.initcap("n_name").alias("title"), text.ordinal(F.col("n_nationkey")).alias("ordinal"))


CODES = ["KE-C030-W0789", "KE-C047", "bad", "KE-C001-W0001-X", "KE-C12-W3"]


@query(
    "q_parse_codes",
    f"""SELECT code, nullif(regexp_extract(code, '^KE-C([0-9]{{3}})', 1), '') AS county, nullif(regexp_extract(code, '^KE-C[0-9]{{3}}-W([0-9]{{4}})$', 1), '') AS ward, regexp_full_match(code, 'KE-C[0-9]{{3}}(-W[0-9]{{4}})?') AS well_formed
    FROM (SELECT * FROM {values_sql(CODES, 'code')} UNION ALL SELECT 'KE-C' || lpad(c_nationkey::VARCHAR, CASE WHEN c_acctbal < 0 THEN 2 ELSE 3 END, '0') || '-W' || lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INTEGER, '0') FROM customer)""",
)
def parse_codes(t: Tables):
    part = lambda p: F.nullif(F.regexp_extract("code", p, 1), F.lit(""))
    own = F.expr("'KE-C' || lpad(CAST(c_nationkey AS STRING), CASE WHEN c_acctbal < 0 THEN 2 ELSE 3 END, '0') || '-W' || lpad(CAST(c_custkey AS STRING), greatest(4, length(CAST(c_custkey AS STRING))), '0')")
    return t.values([(x,) for x in CODES], "code string").unionByName(t.customer.select(own.alias("code"))).select("code", part(r"^KE-C([0-9]{3})").alias("county"), part(r"^KE-C[0-9]{3}-W([0-9]{4})$").alias("ward"), F.col("code").rlike(r"^KE-C[0-9]{3}(-W[0-9]{4})?$").alias("well_formed"))


#: Fixed value: the namespace of published identifiers.
NAMESPACE = "c9a6f7b2-3e1d-4a8f-9c2b-5d7e1f4a8b3c"


@query(
    "q_uuid5",
    f"""WITH h AS (SELECT n_nationkey, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode('nation:' || n_name)) AS h FROM nation)
    SELECT n_nationkey, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', ('0x' || h[17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""",
)
def uuid5(t: Tables):
    return t.nation.select("n_nationkey", text.uuid5(F.concat(F.lit("nation:"), "n_name"), NAMESPACE).alias("id"))


@query(
    "q_fiscal_year",
    """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, (year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END) || '/' || lpad(((year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END + 1) % 100)::VARCHAR, 2, '0') AS fiscal_year,
    last_day(d) AS month_end, date_diff('day', DATE '1970-01-01', d)::BIGINT AS epoch_day, (year(d) * 12 + month(d))::BIGINT AS month_index FROM d""",
)
def fiscal_year(t: Tables):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", text.fiscal_year(d).alias("fiscal_year"), F.last_day(d).alias("month_end"), F.unix_date(d).cast("long").alias("epoch_day"), text.month_index(d).alias("month_index"))


@query(
    "q_arrays",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w, [p_brand, p_type, p_brand] AS b FROM part) SELECT p_partkey, array_to_string(w, '|') AS joined, list_contains(w, 'ring') AS has_ring, list_sort(list_distinct(b)) AS tags, w[1:1] AS head,
    len(list_filter(w, lambda x: length(x) > 4))::BIGINT AS long_words FROM w""",
)
def arrays(t: Tables):
    w = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_join(w, "|").alias("joined"), F.array_contains(w, "ring").alias("has_ring"), F.array_sort(F.array_distinct(F.array("p_brand", "p_type", "p_brand"))).alias("tags"), F.slice(w, 1, 1).alias("head"), F.size(F.filter(w, lambda x: F.length(x) > 4)).cast("long").alias("long_words"))


@query(
    "q_maps",
    """SELECT n_nationkey, max(n) FILTER (WHERE s = 'BUILDING') AS building, coalesce(max(n) FILTER (WHERE s = 'AIRCRAFT'), 0)::BIGINT AS aircraft, list_sort(list(s)) AS keys, sum(n)::BIGINT AS total FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment AS s, count(*)::BIGINT AS n FROM customer GROUP BY ALL) GROUP BY 1""",
)
def maps(t: Tables):
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n"))
    m = c.groupBy("n_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("m"))
    return m.select("n_nationkey", F.try_element_at("m", F.lit("BUILDING")).alias("building"), F.coalesce(F.try_element_at("m", F.lit("AIRCRAFT")), F.lit(0)).cast("long").alias("aircraft"), F.array_sort(F.map_keys("m")).alias("keys"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("q_json_props", "SELECT event_id, (props->>'k')::BIGINT AS k, props->>'missing' AS missing FROM events WHERE (props->>'k')::BIGINT >= 50")
def json_props(t: Tables):
    p = F.from_json("props", "k long, missing string")
    return t.events.select("event_id", p.alias("p")).select("event_id", "p.k", "p.missing").filter("k >= 50")


@query(
    "q_url_canon",
    """WITH u AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '' ELSE '' END AS url, split_part(url, '#', 1) AS bare FROM pages), q AS (SELECT page_id, split_part(bare, '?', 1) AS path, split_part(bare, '?', 2) AS query FROM u)
    SELECT page_id, CASE WHEN query = '' THEN path ELSE path || '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS canonical FROM q""",
)
def url_canon(t: Tables):
    return t.pages.select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


ASKED = [("nation 5",), ("NATION-12",), ("nation",), ("region 3",)]


@query(
    "q_label_match",
    f"""WITH p AS (SELECT asked, n_nationkey, {NORMAL.format('asked')} AS a, {NORMAL.format('n_name')} AS b FROM {values_sql(ASKED, 'asked')}, nation), s AS (SELECT asked, n_nationkey, CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) ELSE 0 END::BIGINT AS score FROM p)
    SELECT asked, n_nationkey, score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, n_nationkey) AS k FROM s WHERE score > 0) WHERE k = 1""",
)
def label_match(t: Tables):
    # The asked-for names and the nations are both small fixed tables.
    p = t.values(ASKED, "asked string").crossJoin(F.broadcast(t.nation)).select("asked", "n_nationkey", text.label_score(F.col("asked"), F.col("n_name")).alias("score")).filter("score > 0")
    return rank.top_k(p, ["asked"], [F.desc("score"), F.col("n_nationkey")], 1).drop("place")


@query(
    "q_search",
    """WITH e AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS label, p_name || ' ' || p_brand || ' ' || p_type AS body FROM part UNION ALL SELECT 'nation', n_nationkey, n_name, n_name FROM nation UNION ALL SELECT 'segment', NULL, c_mktsegment, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer)),
    s AS (SELECT kind, id::BIGINT AS id, label, CASE WHEN lower(label) = 'ring' THEN 120 WHEN starts_with(lower(label), 'ring') THEN 95 WHEN regexp_matches(lower(label), '(^|[^a-z0-9])ring') THEN 72 WHEN regexp_matches(lower(body), '(^|[^a-z0-9])ring') THEN 50 WHEN contains(lower(body), 'ring') THEN 24 ELSE 0 END::BIGINT AS score FROM e)
    SELECT kind, id, label, score FROM s WHERE score > 0 ORDER BY score DESC, kind, label, id LIMIT 30""",
)
def search(t: Tables):
    e = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("body"))
    e = e.unionByName(t.nation.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"), F.col("n_name").alias("body")))
    e = e.unionByName(t.customer.select("c_mktsegment").distinct().select(F.lit("segment").alias("kind"), F.lit(None).cast("long").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_mktsegment").alias("body")))
    s = e.select("kind", "id", "label", text.search_score(F.col("body"), F.col("label"), "ring").alias("score")).filter("score > 0")
    return s.orderBy(F.desc("score"), "kind", "label", "id").limit(30)  # a top-k report


@query(
    "q_delta_label",
    with_views("""WITH p AS (SELECT n_nationkey, metric, max(value) FILTER (WHERE yr = 1999) AS a, max(value) FILTER (WHERE yr = 2000) AS b FROM obs WHERE metric IN ('ORDERS', 'QTY') GROUP BY ALL)
    SELECT n_nationkey, metric, CASE WHEN metric = 'QTY' THEN (b - a) || ' points' WHEN a = 0 THEN (b - a)::VARCHAR ELSE (CASE WHEN b >= a THEN '+' ELSE '-' END) || (abs(b - a) * 100 // a) || '%' END AS label FROM p"""),
)
def delta_label(t: Tables):
    at = lambda y: F.max(F.when(F.col("yr") == y, F.col("value")))
    p = t.obs().filter(F.col("metric").isin("ORDERS", "QTY")).groupBy("n_nationkey", "metric").agg(at(1999).alias("a"), at(2000).alias("b"))
    d = F.col("b") - F.col("a")
    percent = F.concat(F.when(d >= 0, "+").otherwise("-"), F.floor(F.try_divide(F.abs(d) * 100, F.col("a"))).cast("string"), F.lit("%"))
    return p.select("n_nationkey", "metric", F.when(F.col("metric") == "QTY", F.concat(d.cast("string"), F.lit(" points"))).when(F.col("a") == 0, d.cast("string")).otherwise(percent).alias("label"))


@query(
    "q_coherence_gate",
    with_views("""WITH m AS (SELECT lower(n_name) AS name, value AS model FROM obs JOIN nation USING (n_nationkey) WHERE metric = 'ORDERS' AND yr = 1999), o AS (SELECT CASE WHEN n_nationkey = 3 THEN 'third nation' ELSE lower(n_name) END AS name, value AS official FROM obs JOIN nation USING (n_nationkey) WHERE metric = 'ORDERS' AND yr = 2000),
    al AS (SELECT o.*, CASE WHEN name = 'third nation' THEN 'nation_3' ELSE name END AS key FROM o), j AS (SELECT al.*, model FROM al LEFT JOIN m ON al.key = m.name)
    SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE model IS NULL)::BIGINT AS unmatched, sum(abs(model - official))::BIGINT AS abs_error, sum(model - official)::BIGINT AS bias, count(*) FILTER (WHERE official * 10 BETWEEN model * 8 AND model * 12)::BIGINT AS inside,
    count(*) FILTER (WHERE model IS NULL) = 0 AND sum(abs(model - official)) * 100 <= 10 * sum(official) AND count(*) FILTER (WHERE official * 10 BETWEEN model * 8 AND model * 12) * 100 >= 90 * count(*) AS passed FROM j"""),
)
def coherence_gate(t: Tables):
    obs = t.obs().filter("metric = 'ORDERS'").join(F.broadcast(t.nation.select("n_nationkey", F.lower("n_name").alias("name"))), "n_nationkey")
    model = obs.filter("yr = 1999").select(F.col("name").alias("key"), F.col("value").alias("model"))
    official = obs.filter("yr = 2000").select(F.when(F.col("n_nationkey") == 3, "third nation").otherwise(F.col("name")).alias("name"), F.col("value").alias("official"))
    alias = t.values([("third nation", "nation_3")], "name string, alias string")
    j = official.join(F.broadcast(alias), "name", "left").withColumn("key", F.coalesce("alias", "name")).join(model, "key", "left")
    e = F.col("model") - F.col("official")
    s = j.agg(F.count("*").alias("n"), F.count_if(F.col("model").isNull()).alias("unmatched"), F.sum(F.abs(e)).alias("abs_error"), F.sum(e).alias("bias"), F.count_if((F.col("official") * 10).between(F.col("model") * 8, F.col("model") * 12)).alias("inside"), F.sum("official").alias("total"))
    ok = gates.within(F.col("unmatched"), 0) & gates.within(F.try_divide(F.col("abs_error") * 100, F.col("total")), 10) & gates.at_least(F.col("inside") * 100 / F.col("n"), 90)
    return s.select("n", "unmatched", "abs_error", "bias", "inside", ok.alias("passed"))


@query(
    "q_terminal_coverage",
    """WITH q AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), s AS (SELECT o_custkey AS c_custkey, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_states, CASE WHEN q.c_custkey IS NULL THEN 'extraneous' WHEN n IS NULL THEN 'open' WHEN n > 1 THEN 'conflicting' ELSE 'closed' END AS finding FROM q FULL JOIN s USING (c_custkey)""",
)
def terminal_coverage(t: Tables):
    # Customers with money are queued; an urgent order is a state.
    states = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return completeness.terminal_coverage(t.customer.filter("c_acctbal > 0"), states, "c_custkey", "o_orderstatus")


@query("q_month_lag", "SELECT c_nationkey AS n_nationkey, (2001 * 12 + 12 - max(year(o_orderdate) * 12 + month(o_orderdate)))::BIGINT AS months, 2001 * 12 + 12 - max(year(o_orderdate) * 12 + month(o_orderdate)) <= 6 AS fresh FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def month_lag(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    months = F.lit(2001 * 12 + 12) - F.max(text.month_index(F.col("o_orderdate")))
    return j.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(months.cast("long").alias("months"), (months <= 6).alias("fresh"))


@query(
    "q_clamped_scale",
    with_views("""WITH x AS (SELECT metric, n_nationkey, value FROM latest_obs UNION ALL SELECT 'FLAT', n_nationkey, 7 FROM nation), m AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM x WINDOW p AS (PARTITION BY metric))
    SELECT metric, n_nationkey, CASE WHEN hi = lo THEN 50 ELSE greatest(5, least(100, (value - lo) * 100 / (hi - lo))) END::DOUBLE AS scale FROM m"""),
)
def clamped_scale(t: Tables):
    x = t.latest_obs().select("metric", "n_nationkey", "value").unionByName(t.nation.select(F.lit("FLAT").alias("metric"), "n_nationkey", F.lit(7).cast("long").alias("value")))
    w = Window.partitionBy("metric")
    lo, hi, v = F.min("value").over(w), F.max("value").over(w), F.col("value")
    return x.select("metric", "n_nationkey", F.when(hi == lo, 50.0).otherwise(F.greatest(F.lit(5.0), F.least(F.lit(100.0), F.try_divide((v - lo) * 100, hi - lo)))).alias("scale"))


@query(
    "q_top_bottom",
    """WITH b AS (SELECT p_type, p_brand, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS hi, row_number() OVER (PARTITION BY p_type ORDER BY n, p_brand DESC) AS lo FROM b)
    SELECT p_type, p_brand, n, CASE WHEN hi <= 3 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE hi <= 3 OR lo <= 3""",
)
def top_bottom(t: Tables):
    b = t.lineitem.join(t.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).filter("p_type <> 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_type")
    r = b.withColumns({"hi": F.row_number().over(w.orderBy(F.desc("n"), "p_brand")), "lo": F.row_number().over(w.orderBy("n", F.desc("p_brand")))})
    return r.filter("hi <= 3 OR lo <= 3").select("p_type", "p_brand", "n", F.when(F.col("hi") <= 3, "top").otherwise("bottom").alias("side"))


@query(
    "q_wide_join",
    with_views("""WITH c AS (SELECT c_nationkey AS n_nationkey, count(*)::BIGINT AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS n_nationkey, count(*)::BIGINT AS suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1), g AS (SELECT n_nationkey, max(REV) FILTER (WHERE yr = 1999) AS a, max(REV) FILTER (WHERE yr = 2000) AS b FROM wide GROUP BY 1)
    SELECT n_nationkey, n_name, customers, suppliers, (b - a) * 100 / nullif(a, 0) AS growth_pct FROM nation LEFT JOIN c USING (n_nationkey) LEFT JOIN s USING (n_nationkey) LEFT JOIN g USING (n_nationkey)"""),
)
def wide_join(t: Tables):
    at = lambda y: F.max(F.when(F.col("yr") == y, F.col("REV")))
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.filter("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    g = t.wide().groupBy("n_nationkey").agg(F.try_divide((at(2000) - at(1999)) * 100, at(1999)).alias("growth_pct"))
    return t.nation.select("n_nationkey", "n_name").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").join(g, "n_nationkey", "left")


SUBSETS = [("coast", [1, 2, 3], [4]), ("hills", [5, 6], []), ("lakes", [], [7])]


@query(
    "q_subset_member",
    """WITH s AS (SELECT * FROM (VALUES ('coast', [1, 2, 3], [4]), ('hills', [5, 6], []::INT[]), ('lakes', []::INT[], [7])) v(subset, members, partial))
    SELECT subset, n_nationkey, CASE WHEN list_contains(members, n_nationkey) THEN 'full' ELSE 'partial: left out' END AS membership FROM s, nation WHERE list_contains(members, n_nationkey) OR list_contains(partial, n_nationkey)""",
)
def subset_member(t: Tables):
    s = t.values(SUBSETS, "subset string, members array<int>, partial array<int>")
    e = s.select("subset", F.explode("members").alias("n_nationkey"), F.lit("full").alias("membership")).unionByName(s.select("subset", F.explode("partial").alias("n_nationkey"), F.lit("partial: left out").alias("membership")))
    return t.nation.select("n_nationkey").join(F.broadcast(e), "n_nationkey")


@query("q_bundle_index", with_views("SELECT n_nationkey, count(DISTINCT metric)::BIGINT AS series_count, count(*)::BIGINT AS observation_count FROM obs GROUP BY 1"))
def bundle_index(t: Tables):
    return export.bundle_index(t.obs(), "n_nationkey", "metric")


@query(
    "q_bundles",
    with_views("""WITH s AS (SELECT n_nationkey, metric, list({'yr': yr, 'value': value} ORDER BY yr) AS observations FROM obs GROUP BY ALL)
    SELECT n_nationkey, to_json(list({'metric': metric, 'observations': observations} ORDER BY metric))::VARCHAR AS series FROM s GROUP BY 1"""),
)
def bundles(t: Tables):
    return export.bundles(t.obs(), "n_nationkey", "metric", ["yr", "value"]).withColumn("series", F.to_json("series"))


@query(
    "q_row_hash",
    """WITH h AS (SELECT sha256(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_mktsegment': c_mktsegment})::VARCHAR) AS h FROM customer)
    SELECT count(*)::BIGINT AS n, sum(('0x' || h[1:15])::BIGINT::HUGEINT)::VARCHAR AS sum, max(h) AS greatest FROM h""",
)
def row_hash(t: Tables):
    return export.fingerprint(t.customer, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query(
    "q_html_cells",
    r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>') AS cs FROM pages), e AS (SELECT page_id, generate_subscripts(cs, 1) - 1 AS position, unnest(cs) AS cell FROM c)
    SELECT page_id, 'li' AS tag, position::BIGINT AS position, trim(regexp_replace(regexp_replace(cell, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM e""",
)
def html_cells(t: Tables):
    return readers.html_cells(t.pages, "page_id", "html", ("li",))


@query("q_filename_counts", "SELECT regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS file_key, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def filename_counts(t: Tables):
    return t.pages.groupBy(text.file_key(F.regexp_extract("url", r"^https?://([^?#]+)", 1)).alias("file_key")).agg(F.count("*").alias("pages"))
