"""Queries over policies, published files, entity resolution in passes, and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, vectorised
from ..operators import export, joins, ordering, policy, rules, spatial
from .base import Tables, query
from .linking import BOXES, SOURCE_SQL, TARGET_SQL, boxes, two_sources
from .roundtrips import folder

OVERRIDES = [("Brand#1", "house"), ("Brand#7", "house"), ("Brand#12", "licensed")]
PATTERNS = [("ring|gear", "mechanics"), ("bolt", "fasteners"), ("widget|gizmo", "gadgets"), ("promo", "offers")]
DIRECTIONS = [("STANDARD", True), ("MEDIUM", True), ("SMALL", False)]
LIFECYCLE = "CASE WHEN p_size <= 3 THEN 'Planned' WHEN p_size <= 8 THEN 'sourced' WHEN p_size <= 40 THEN 'active' WHEN p_size <= 45 THEN 'retired' END"
LOW = "lower(p_name || ' ' || p_type)"


@query(
    "q_policy",
    f"""WITH o AS (SELECT * FROM (VALUES {', '.join(map(str, OVERRIDES))}) v(p_brand, given)), d AS (SELECT * FROM (VALUES ('STANDARD', true), ('MEDIUM', true), ('SMALL', false)) v(p_type, higher_is_better))
    SELECT p_partkey, coalesce(given, CASE {' '.join(f"WHEN regexp_matches({LOW}, '{p}') THEN '{c}'" for p, c in PATTERNS)} ELSE 'other' END) AS domain, higher_is_better, higher_is_better IS NOT NULL AS eligible,
    CASE WHEN p_size <= 3 OR p_retailprice < 901 THEN 'planned' WHEN p_size <= 8 THEN 'candidate' WHEN p_size <= 40 OR p_retailprice >= 901 THEN 'published' END AS state
    FROM part LEFT JOIN o USING (p_brand) LEFT JOIN d USING (p_type)""",
)
def indicator_policy(t: Tables):
    p = policy.classified(t.part, "p_brand", F.concat_ws(" ", "p_name", "p_type"), t.values(OVERRIDES, "code string, class string"), PATTERNS, "other", "domain")
    p = policy.ruled(p, "p_type", t.values(DIRECTIONS, "p_type string, higher_is_better boolean"))
    state = policy.publication_state(F.col("p_retailprice") >= 901, F.expr(LIFECYCLE))
    return p.select("p_partkey", "domain", "higher_is_better", F.col("higher_is_better").isNotNull().alias("eligible"), state.alias("state"))


@query("q_lifecycle_filter", f"SELECT p_partkey, p_brand FROM part WHERE lower({LIFECYCLE}) = 'active'")
def lifecycle_filter(t: Tables):
    return t.part.filter(F.lower(F.expr(LIFECYCLE)) == "active").select("p_partkey", "p_brand")


BADGE = "CASE l_returnflag WHEN 'A' THEN (CASE WHEN l_discount > 0.05 THEN 'e' ELSE 'A' END) WHEN 'R' THEN 'B' END"
METHOD = "CASE WHEN l_quantity > 45 THEN 'Modelled_surface' WHEN l_tax = 0 THEN 'interpolated' WHEN l_linestatus = 'O' THEN 'direct' END"


@query(
    "q_evidence_status",
    f"""WITH m AS (SELECT upper(coalesce({BADGE}, '')) AS b, lower(coalesce({METHOD}, 'direct')) AS m FROM lineitem)
    SELECT CASE WHEN b = 'E' THEN 'external_verified' WHEN b = 'D' OR contains(m, 'model') THEN 'published_modelled' WHEN b IN ('B', 'C') OR m <> 'direct' THEN 'published_derived' ELSE 'published_direct' END AS status, count(*)::BIGINT AS cells FROM m GROUP BY 1""",
)
def evidence(t: Tables):
    return t.lineitem.select(policy.evidence_status(F.expr(BADGE), F.expr(METHOD)).alias("status")).groupBy("status").agg(F.count("*").alias("cells"))


@query(
    "q_decision_records",
    """WITH d AS (SELECT DISTINCT l_partkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 5 END AS tier, l_suppkey, round(l_extendedprice / l_quantity)::BIGINT AS price FROM lineitem),
    p AS (SELECT l_partkey, count(DISTINCT price)::BIGINT AS n_values, count(DISTINCT l_suppkey)::BIGINT AS lineages, count(*)::BIGINT AS candidates, min(tier) AS selected_tier, max(tier) AS worst_tier FROM d GROUP BY 1 HAVING count(DISTINCT price) >= 2 AND count(DISTINCT l_suppkey) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY tier, l_suppkey, price) AS k FROM d),
    l AS (SELECT l_partkey, string_agg(tier || ':' || l_suppkey || ':' || price, '; ' ORDER BY k) AS listed, min(l_suppkey) FILTER (WHERE k = 1) AS selected_lineage, min(price) FILTER (WHERE k = 1) AS selected_value FROM r WHERE k <= 4 GROUP BY 1)
    SELECT l_partkey, candidates, lineages, n_values, selected_tier, selected_lineage, selected_value, worst_tier, listed, greatest(candidates - 4, 0)::BIGINT AS suppressed, CASE WHEN selected_tier = worst_tier THEN 'medium' ELSE 'high' END AS confidence FROM p JOIN l USING (l_partkey)""",
)
def decisions(t: Tables):
    tier = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(5)
    c = t.lineitem.select("l_partkey", tier.alias("tier"), "l_suppkey", F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("price"))
    return policy.decision_records(c, ["l_partkey"], "price", "l_suppkey", "tier", 4)


@query(
    "q_fallback",
    """WITH a AS (SELECT 0 AS nth, 'production' AS source, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'X' UNION ALL SELECT 1, 'bundled', o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 2, 'sample', o_custkey, o_orderkey FROM orders)
    SELECT source, o_custkey, o_orderkey FROM a WHERE nth = (SELECT min(nth) FROM a)""",
)
def fallback(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return policy.first_available([("production", rows.filter("o_orderstatus = 'X'")), ("bundled", rows.filter("o_orderpriority = '1-URGENT'")), ("sample", rows)]).select("source", "o_custkey", "o_orderkey")


CODE = "'KE-C' || lpad(cast((c_nationkey + CASE WHEN c_acctbal < -900 THEN 1 ELSE 0 END) AS {0}), 3, '0') || CASE WHEN c_acctbal > 9900 THEN '-w' ELSE '-W' END || lpad(cast(c_custkey AS {0}), cast(greatest(4, length(cast(c_custkey AS {0}))) AS INT), '0')"


@query(
    "q_code_agreement",
    f"""WITH c AS (SELECT c_custkey, c_nationkey, {CODE.format('VARCHAR')} AS code FROM customer), p AS (SELECT *, regexp_full_match(code, 'KE-C[0-9]{{3}}-W[0-9]{{4,}}') AS ok, try_cast(nullif(regexp_extract(code, '^KE-C([0-9]{{3}})', 1), '') AS INTEGER) AS n FROM c)
    SELECT c_custkey::VARCHAR AS key, code || CASE WHEN NOT ok THEN ' is malformed' ELSE ' is not of ' || c_nationkey END AS detail FROM p WHERE NOT ok OR n <> c_nationkey""",
)
def code_agreement(t: Tables):
    c = t.customer.withColumn("code", F.expr(CODE.format("STRING")))
    return rules.code_agrees(c, ["c_custkey"], "code", r"^KE-C[0-9]{3}-W[0-9]{4,}$", r"^KE-C([0-9]{3})", "c_nationkey")


@query("q_label_degenerate", "SELECT p_type AS key, count(*) || ' rows, one label' AS detail FROM part GROUP BY p_type HAVING count(DISTINCT CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'same' ELSE p_brand END) < 2")
def label_degenerate(t: Tables):
    return rules.degenerate(t.part.withColumn("label", F.when(F.col("p_type").isin("PROMO", "SMALL"), "same").otherwise(F.col("p_brand"))), ["p_type"], "label")


@query("q_published_files", "SELECT 'ok' AS finding, count(DISTINCT s_nationkey)::BIGINT AS files FROM supplier UNION ALL SELECT 'not in the manifest', 1")
def published(t: Tables):
    """Bundles of suppliers that were published with their manifest, and one that came later, as the files are now."""
    path = folder(t)
    bundles = t.supplier.select("s_nationkey", "s_suppkey", "s_name")
    export.write_with_manifest(bundles, path, "s_nationkey")
    export.write_ndjson(t.region.coalesce(1), f"{path}/bundles/s_nationkey=99")
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{path}/bundles")
    stated = t.spark.read.schema("s_nationkey string, file string, bytes long, sha256 string").option("header", True).csv(f"{path}/manifest")
    own = F.concat_ws("/", F.regexp_extract("path", "/s_nationkey=([^/]+)/", 1), "file").alias("file")  # a task names its files alike in all folders
    found = export.manifest(files).select(own, "bytes", "sha256")
    return export.verified(found, stated.withColumn("file", F.concat_ws("/", "s_nationkey", "file"))).groupBy("finding").agg(F.count("*").alias("files"))


#: Names as a second source spells them; two of region 3 and all of region 4 are not to be told by name.
SPELT = "CASE WHEN n_regionkey = 0 THEN n_name WHEN n_regionkey = 1 THEN replace(n_name, 'NATION', 'NATOIN') WHEN n_regionkey = 2 THEN replace(n_name, '_', '') WHEN n_regionkey = 3 AND n_nationkey > 10 THEN n_name ELSE 'ward ' || repeat('x', cast(n_nationkey AS {0})) END"


@query(
    "q_er_passes",
    f"""WITH s AS (SELECT 100 + n_nationkey AS id, n_regionkey AS parent, {SPELT.format('INTEGER')} AS name FROM nation), t AS (SELECT n_nationkey AS t_id, n_regionkey AS parent, n_name AS name FROM nation),
    e AS (SELECT id, t_id, 'exact' AS method FROM s JOIN t USING (parent, name)),
    s1 AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM e)), t1 AS (SELECT * FROM t WHERE t_id NOT IN (SELECT t_id FROM e)),
    p AS (SELECT id, t_id, levenshtein(s1.name, t1.name) / greatest(length(s1.name), length(t1.name)) AS cost FROM s1 JOIN t1 USING (parent)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, t_id) AS k, lead(cost) OVER (PARTITION BY id ORDER BY cost, t_id) AS nxt FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY cost, id) AS j FROM r WHERE k = 1 AND cost <= 0.5 AND (nxt IS NULL OR nxt - cost >= 0.04)),
    f AS (SELECT id, t_id, 'fuzzy in parent' AS method FROM b WHERE j = 1),
    m AS (SELECT * FROM e UNION ALL SELECT * FROM f),
    s2 AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY id) AS k, count(*) OVER (PARTITION BY parent) AS c FROM s WHERE id NOT IN (SELECT id FROM m)),
    t2 AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY t_id) AS k, count(*) OVER (PARTITION BY parent) AS c FROM t WHERE t_id NOT IN (SELECT t_id FROM m)),
    g AS (SELECT id, t_id, CASE WHEN c = 1 THEN 'unique residual' ELSE 'complete group' END AS method FROM s2 JOIN t2 USING (parent, k, c))
    SELECT * FROM m UNION ALL SELECT * FROM g UNION ALL SELECT id, NULL, 'unmatched' FROM s2 WHERE id NOT IN (SELECT id FROM g)""",
)
def er_passes(t: Tables):
    source = t.nation.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"), F.expr(SPELT.format("INT")).alias("name"))
    target = t.nation.select(F.col("n_nationkey").alias("t_id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    passes = [joins.equal_pass("exact", ["parent", "name"]), joins.fuzzy_pass("fuzzy in parent", "parent", "name", 0.5, 0.04), joins.group_pass("complete group", "unique residual", ["parent"])]
    return joins.resolve_by(source, target, "id", passes)


@query("q_area_km2", f"WITH {BOXES} SELECT s_suppkey, round((x1 - x0) / 10.0 * ((y1 - y0) / 10.0) * 111.32 * 110.574 * cos(radians(y0 / 10.0)), 3) AS km2 FROM b")
def area_km2(t: Tables):
    b = boxes(t.supplier, "s_suppkey", "b_")
    at = lambda c: F.col(f"b_{c}") / 10.0
    ring = F.array(*[F.array(at(f"x{i}"), at(f"y{j}")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return b.select("s_suppkey", F.round(geo.km2(F.array(ring), at("y0")), 3).alias("km2"))


@query("q_fold_accents", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents WHERE text IS NOT NULL")
def fold(t: Tables):
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.md5(vectorised.folded(F.col("text"))).alias("folded"))


@query("q_url_hosts", "SELECT url_host, count(*)::BIGINT AS pages FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS url_host FROM pages) GROUP BY 1")
def url_hosts(t: Tables):
    return t.pages.groupBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("url_host")).agg(F.count("*").alias("pages"))


@query(
    "q_catalogue_metrics",
    """SELECT o_orderpriority, count(*)::BIGINT AS orders, count(DISTINCT o_custkey)::BIGINT AS customers, min(year(o_orderdate))::BIGINT AS first_year, max(year(o_orderdate))::BIGINT AS last_year, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS grades FROM orders GROUP BY 1""",
)
def catalogue_metrics(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.min(F.year("o_orderdate")).cast("long").alias("first_year"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("grades"),
    )


@query(
    "q_multi_key_sort",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size, lower(p_name), p_partkey)::BIGINT AS place FROM part""",
)
def multi_key_sort(t: Tables):
    from pyspark.sql import Window

    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy("p_size", F.lower("p_name"), "p_partkey")).cast("long").alias("place"))


@query(
    "q_natural_order",
    """SELECT p_partkey, row_number() OVER (ORDER BY lower(p_type), CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER), p_size DESC NULLS LAST, lower(p_name), p_partkey)::BIGINT AS place FROM part""",
)
def natural_order(t: Tables):
    """All parts numbered in one order: type by locale, brands by their number, size falling, name by locale, key."""
    order = [ordering.by_locale(F.col("p_type")), ordering.natural(F.col("p_brand")), F.desc_nulls_last("p_size"), ordering.by_locale(F.col("p_name")), F.col("p_partkey")]
    return ordering.numbered(t.part, order).select("p_partkey", "place")


@query(
    "q_flatten",
    """WITH n AS (SELECT o_orderkey, list({'n': l_linenumber, 'q': round(l_quantity)::BIGINT} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    e AS (SELECT o_orderkey, unnest(lines) AS l, generate_subscripts(lines, 1) AS pos FROM n) SELECT o_orderkey, pos::BIGINT AS pos, l.n AS n, l.q AS q FROM e""",
)
def flatten(t: Tables):
    j = t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    nested = j.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(order)).alias("lines"))
    e = nested.select("o_orderkey", F.posexplode("lines").alias("pos", "l"))
    return e.select("o_orderkey", (F.col("pos") + 1).cast("long").alias("pos"), F.col("l.l_linenumber").alias("n"), F.round("l.l_quantity").cast("long").alias("q"))


@query("q_file_keys", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS file_key FROM pages")
def file_keys(t: Tables):
    return t.pages.select("page_id", text.file_key(F.regexp_replace("url", "^https?://", "")).alias("file_key"))


@query(
    "q_rank_orders",
    """WITH o AS (SELECT o_orderkey, o_orderpriority, round(o_totalprice / 100)::BIGINT AS price FROM orders)
    SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY price DESC)::BIGINT AS rank, cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY price) * 100 AS percentile FROM o""",
)
def rank_orders(t: Tables):
    """All orders by price within their priority: few groups, each a fifth of the table."""
    from ..operators import rank

    o = t.orders.select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / 100).cast("long").alias("price"))
    return rank.ranked_by_counts(o, ["o_orderpriority"], "price").select("o_orderkey", "rank", "percentile")


@query(
    "q_full_coverage_rank",
    """WITH o AS (SELECT c_mktsegment, c_nationkey AS n_nationkey, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 0 OR c_mktsegment <> 'BUILDING' GROUP BY ALL), k AS (SELECT c_mktsegment, count(*) AS c FROM o GROUP BY 1)
    SELECT c_mktsegment, n_nationkey, n, CASE WHEN c = (SELECT count(*) FROM nation) THEN rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC) END::BIGINT AS rank FROM o JOIN k USING (c_mktsegment)""",
)
def full_coverage_rank(t: Tables):
    """Ranks only in the segments that all nations have."""
    from ..operators import rank

    o = t.customer.filter("c_acctbal > 0 OR c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return rank.ranked_if_full(o, ["c_mktsegment"], "n", t.nation.agg(F.count("*").alias("all"))).select("c_mktsegment", "n_nationkey", "n", "rank")


@query(
    "q_spatial_allocation",
    """WITH p AS (SELECT c_custkey % 10 AS value, (c_custkey * 37) % 200 + 0.5 AS x, (c_custkey * 91) % 200 + 0.25 AS y FROM customer), z AS (SELECT s_nationkey, s_suppkey, (s_suppkey * 53) % 180 AS x0, (s_suppkey * 29) % 180 AS y0 FROM supplier),
    w AS (SELECT s_nationkey, s_suppkey, coalesce(sum(value), 0)::BIGINT AS weight FROM z LEFT JOIN p ON x > x0 AND y > y0 AND (x - x0) + (y - y0) < 30 GROUP BY ALL),
    t AS (SELECT c_nationkey AS s_nationkey, 10 * count(*)::BIGINT AS people FROM customer GROUP BY 1), a AS (SELECT *, sum(weight) OVER (PARTITION BY s_nationkey) AS s FROM w JOIN t USING (s_nationkey)),
    b AS (SELECT *, CASE WHEN s > 0 THEN (people * weight) // s END AS base, CASE WHEN s > 0 THEN (people * weight) % s END AS rest FROM a),
    c AS (SELECT *, people - sum(base) OVER (PARTITION BY s_nationkey) AS remaining, row_number() OVER (PARTITION BY s_nationkey ORDER BY rest DESC NULLS LAST, s_suppkey) AS k FROM b)
    SELECT s_nationkey, s_suppkey, weight, people, (base + CASE WHEN k <= remaining THEN 1 ELSE 0 END)::BIGINT AS allocated FROM c""",
)
def spatial_allocation(t: Tables):
    from .surfaces import pixels, triangles

    zones = triangles(t).join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    totals = t.customer.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg((F.count("*") * 10).alias("people"))
    return spatial.allocated_sum(pixels(t).drop("c_custkey"), zones, "s_nationkey", "s_suppkey", "value", totals, "people", 20)


@query("q_explode_words", "WITH e AS (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, p_partkey, p_type, count(*) OVER (PARTITION BY word, p_type) > 1 AS shared FROM e")
def explode_words(t: Tables):
    """The second way to flag keys that several lists hold: counts joined back, so a frequent word is no task of its own."""
    e = t.part.select("p_partkey", "p_type", F.explode(F.split("p_name", " ")).alias("word"))
    counts = e.groupBy("word", "p_type").agg((F.count("*") > 1).alias("shared"))
    return e.join(counts, ["word", "p_type"]).select("word", "p_partkey", "p_type", "shared")


MESSY = "CASE WHEN c_acctbal < -900 THEN '#N/A' WHEN c_acctbal < 0 THEN '(' || {0} || ')' WHEN c_acctbal < 100 THEN '-' WHEN c_acctbal > 9900 THEN {0} || ' %' ELSE ' ' || {0} END"
UNIT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'KSh million' WHEN 'FURNITURE' THEN 'thousand' WHEN 'MACHINERY' THEN 'bn' ELSE 'KES' END"


@query(
    "q_clean_balances",
    f"""WITH r AS (SELECT c_custkey, {MESSY.format("format('{:,}', round(abs(c_acctbal))::BIGINT)")} AS raw, {UNIT} AS unit FROM customer),
    c AS (SELECT *, CASE WHEN trim(raw) IN ('', '-') THEN NULL WHEN trim(raw) LIKE '(%)' THEN -try_cast(regexp_replace(raw, '[,%\\s()]', '', 'g') AS DOUBLE) ELSE try_cast(regexp_replace(raw, '[,%\\s()]', '', 'g') AS DOUBLE) END AS value FROM r)
    SELECT c_custkey, raw, value, value * CASE WHEN unit = 'KSh million' THEN 1e6 WHEN unit = 'thousand' THEN 1e3 WHEN unit = 'bn' THEN 1e9 ELSE 1.0 END AS scaled FROM c""",
)
def clean_balances(t: Tables):
    shown = "format_number(CAST(round(abs(c_acctbal)) AS BIGINT), 0)"
    r = t.customer.select("c_custkey", F.expr(MESSY.format(shown)).alias("raw"), F.expr(UNIT).alias("unit")).withColumn("value", text.clean_number(F.col("raw")))
    return r.select("c_custkey", "raw", "value", text.scaled_by_words(F.col("value"), F.col("unit")).alias("scaled"))


RAW_ID = "CASE WHEN c_acctbal < -900 THEN '#REF!' WHEN c_acctbal < -800 THEN '' WHEN c_acctbal > 9900 THEN c_name ELSE ' ' || substring(c_name, 10) END"


@query(
    "q_parse_ids",
    f"""WITH r AS (SELECT c_custkey, {RAW_ID} AS raw FROM customer)
    SELECT c_custkey, CASE WHEN regexp_full_match(trim(raw), '[0-9]{{1,9}}') THEN trim(raw)::BIGINT END AS id, CASE WHEN trim(raw) = '' THEN 'empty' WHEN trim(raw) = '#REF!' THEN 'sentinel' WHEN NOT regexp_full_match(trim(raw), '[0-9]{{1,9}}') THEN 'not a number' END AS note FROM r""",
)
def parse_ids(t: Tables):
    value, note = text.parse_id(F.col("raw"))
    return t.customer.select("c_custkey", F.expr(RAW_ID).alias("raw")).select("c_custkey", value.alias("id"), note.alias("note"))


@query(
    "q_lineage_bounded",
    """WITH o AS (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS release FROM orders JOIN customer ON o_custkey = c_custkey),
    l AS (SELECT c_nationkey, release, l_partkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY release, l_partkey) AS nth FROM (SELECT DISTINCT c_nationkey, release, l_partkey FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE release <= 8))
    SELECT c_nationkey, release::BIGINT AS release, l_partkey FROM l WHERE nth <= 12""",
)
def lineage_bounded(t: Tables):
    """A dataset's graph for display: its 8 newest releases, and the first 12 indicators of these."""
    from ..operators import rank

    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", "o_orderdate")
    newest = rank.top_k(o, ["c_nationkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 8).withColumnRenamed("place", "release")
    links = newest.join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("c_nationkey", "release", "l_partkey").distinct()
    return rank.top_k(links, ["c_nationkey"], [F.col("release"), F.col("l_partkey")], 12).drop("place")


@query(
    "q_active_series",
    f"""SELECT p_brand, p_type, count(*)::BIGINT AS parts FROM part WHERE lower({LIFECYCLE}) = 'active' AND p_retailprice >= 901 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY ALL""",
)
def active_series(t: Tables):
    active = t.part.filter((F.lower(F.expr(LIFECYCLE)) == "active") & (F.col("p_retailprice") >= 901))
    published = active.join(t.lineitem.filter("l_returnflag = 'N'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return published.groupBy("p_brand", "p_type").agg(F.count("*").alias("parts"))


@query(
    "q_er_spatial",
    f"""WITH s AS (SELECT * FROM ({SOURCE_SQL}) WHERE block <> 24), t AS ({TARGET_SQL}),
    p AS (SELECT id, t_id, levenshtein(name, t_name) / greatest(length(name), length(t_name)) AS cost FROM s JOIN t USING (block)),
    r AS (SELECT *, row_number() OVER w AS k, lead(cost) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id ORDER BY cost, t_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY cost, id) AS j FROM r WHERE k = 1 AND cost <= 0.2 AND (nxt IS NULL OR nxt - cost >= 0.04)),
    m AS (SELECT id, t_id, 'in the area' AS method FROM b WHERE j = 1)
    SELECT * FROM m UNION ALL SELECT id, NULL, 'unmatched' FROM ({SOURCE_SQL}) WHERE id NOT IN (SELECT id FROM m)""",
)
def er_spatial(t: Tables):
    """Customers whose rows know no parent but a point; those of the last nation lie outside all areas."""
    source, target = two_sources(t)
    block = F.col("block")
    points = source.select("id", "name", (block * 10 + 5 + F.when(block == 24, 1000).otherwise(0)).cast("double").alias("x"), F.lit(5.0).alias("y"))
    at = lambda dx, y: F.array((F.col("n_nationkey") * 10 + dx).cast("double"), F.lit(float(y)))
    areas = t.nation.select(F.col("n_nationkey").alias("block"), F.array(at(0, 0), at(10, 0), at(10, 10), at(0, 10)).alias("ring"))
    return joins.resolve_by(points, target.withColumnRenamed("t_name", "name"), "id", [joins.spatial_pass("in the area", areas, "block", "name", 0.2, 0.04, 10)])


@query("q_exactly_one", "SELECT o_orderkey::VARCHAR AS key, 'exactly one of value, note' AS detail FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END AS note FROM orders) WHERE (value IS NULL) = (note IS NULL)")
def exactly_one(t: Tables):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("note"))
    return rules.exactly_one(o, ["o_orderkey"], "value", "note")
