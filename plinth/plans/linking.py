"""Queries over sets, joins, hierarchies and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, joins, similar
from .base import Tables, query, with_views


@query("q_distinct", "SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment AS segment FROM customer")
def distinct(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).distinct()


@query("q_union_all", "SELECT c_nationkey AS n_nationkey, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.lit("supplier").alias("kind")))


def buyers(t: Tables, year: int):
    return t.orders.filter((F.col("o_orderdate") >= f"{year}-01-01") & (F.col("o_orderdate") < f"{year + 1}-01-01")).select(F.col("o_custkey").alias("c_custkey"))


@query("q_intersect", "SELECT o_custkey AS c_custkey FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996")
def intersect(t: Tables):
    return buyers(t, 1995).intersect(buyers(t, 1996))


@query("q_except", "SELECT o_custkey AS c_custkey FROM orders WHERE year(o_orderdate) = 1995 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996")
def minus(t: Tables):
    return buyers(t, 1995).subtract(buyers(t, 1996))


@query(
    "q_multiset_equal",
    """SELECT c_nationkey AS n_nationkey, coalesce(list_sort(list(c_mktsegment) FILTER (WHERE y = 1995)), []) = coalesce(list_sort(list(c_mktsegment) FILTER (WHERE y = 1996)), []) AS equal,
    count(*) FILTER (WHERE y = 1995)::BIGINT AS n_1995, count(*) FILTER (WHERE y = 1996)::BIGINT AS n_1996
    FROM (SELECT c_nationkey, c_mktsegment, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey) WHERE y IN (1995, 1996) GROUP BY c_nationkey""",
)
def multiset_equal(t: Tables):
    # Equal multisets have equal counts of each element, so counts are compared and no list is built.
    y = F.year("o_orderdate")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter(y.isin(1995, 1996))
    per = rows.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count_if(y == 1995).alias("a"), F.count_if(y == 1996).alias("b"))
    return per.groupBy("n_nationkey").agg(F.bool_and(F.col("a") == F.col("b")).alias("equal"), F.sum("a").alias("n_1995"), F.sum("b").alias("n_1996"))


@query("q_partition_check", "SELECT n_nationkey, count(r_regionkey)::BIGINT AS n_parents, count(r_regionkey) = 1 AS ok FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey")
def partition_check(t: Tables):
    j = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy("n_nationkey").agg(F.count("r_regionkey").alias("n_parents"), (F.count("r_regionkey") == 1).alias("ok"))


@query(
    "q_star_enrich",
    """SELECT r_name, p_brand, o_orderpriority, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, count(*)::BIGINT AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def star_enrich(t: Tables):
    # Lines are summed by order, part and supplier region before the fact-to-fact join.
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    j = lines.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.places()), F.col("s_nationkey") == F.col("n_nationkey"))
    j = j.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "r_name", "p_brand").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    j = j.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("r_name", "p_brand", "o_orderpriority").agg(F.sum("c").alias("cents"), F.sum("n").alias("lines"))


@query(
    "q_label_chain",
    "SELECT s_suppkey, s_name || ' > ' || coalesce(n_name, 'unknown nation') || ' > ' || coalesce(r_name, 'unknown region') AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def label_chain(t: Tables):
    j = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("s_suppkey", F.concat_ws(" > ", "s_name", F.coalesce("n_name", F.lit("unknown nation")), F.coalesce("r_name", F.lit("unknown region"))).alias("label"))


@query("q_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -950)")
def orphans(t: Tables):
    # Customers far in debt are struck off, so that there are orphans.
    return joins.orphans(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_acctbal > -950"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("q_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi(t: Tables):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("q_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti(t: Tables):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query(
    "q_full_outer_diff",
    """WITH a AS (SELECT DISTINCT c_nationkey * 10 + length(c_mktsegment) AS k FROM customer WHERE c_acctbal < 0), b AS (SELECT DISTINCT s_nationkey * 10 + 8 AS k FROM supplier)
    SELECT coalesce(a.k, b.k)::BIGINT AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
)
def full_outer_diff(t: Tables):
    a = t.customer.filter("c_acctbal < 0").select((F.col("c_nationkey") * 10 + F.length("c_mktsegment")).cast("long").alias("k"))
    return joins.set_difference(a, t.supplier.select((F.col("s_nationkey") * 10 + 8).cast("long").alias("k")), "k")


def place_tree(t: Tables):
    """The geography as an adjacency list: world, regions, nations, customers."""
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = t.region.select(code("R", "r_regionkey").alias("node"), F.lit("WORLD").alias("parent"))
    nations = t.nation.select(code("N", "n_nationkey").alias("node"), code("R", "n_regionkey").alias("parent"))
    return regions.unionByName(nations).unionByName(t.customer.select(code("C", "c_custkey").alias("node"), code("N", "c_nationkey").alias("parent")))


TREE = """tree AS (SELECT 'R' || r_regionkey AS node, 'WORLD' AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"""


@query("q_ancestors", f"WITH RECURSIVE {TREE}, up(node, ancestor, distance) AS (SELECT node, parent, 1::BIGINT FROM tree UNION ALL SELECT up.node, tree.parent, distance + 1 FROM up JOIN tree ON up.ancestor = tree.node) SELECT * FROM up")
def ancestors(t: Tables):
    return hierarchy.ancestors(place_tree(t), "node", "parent", 3)


@query(
    "q_nested",
    f"""WITH {TREE}, c AS (SELECT 'R' || (c_custkey % 5) AS a, 'N' || CASE WHEN c_custkey % 11 = 0 THEN 99 ELSE c_nationkey END AS b, 'C' || c_custkey AS c FROM customer)
    SELECT a, b, c, coalesce(p.parent = a AND q.parent = b, false) AS nested FROM c LEFT JOIN tree p ON p.node = b LEFT JOIN tree q ON q.node = c""",
)
def nested(t: Tables):
    k = F.col("c_custkey")
    of = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    asked = t.customer.select(of("R", k % 5).alias("a"), of("N", F.when(k % 11 == 0, 99).otherwise(F.col("c_nationkey"))).alias("b"), of("C", k).alias("c"))
    tree = place_tree(t)
    j = asked.join(tree.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b", "left").join(tree.select(F.col("node").alias("c"), F.col("parent").alias("pc")), "c", "left")
    return j.select("a", "b", "c", F.coalesce((F.col("pb") == F.col("a")) & (F.col("pc") == F.col("b")), F.lit(False)).alias("nested"))


EDGES = """e AS (SELECT 'R' || r_regionkey AS src, 'N' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""


@query(
    "q_lineage_walk",
    f"""WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    seen(node, steps) AS (SELECT 'S1', 0 UNION SELECT dst, steps + 1 FROM seen JOIN b ON node = src WHERE steps < 6) SELECT node, min(steps)::BIGINT AS steps FROM seen GROUP BY node""",
)
def lineage_walk(t: Tables):
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t.nation.select(code("R", "n_regionkey").alias("src"), code("N", "n_nationkey").alias("dst")).unionByName(t.supplier.select(code("N", "s_nationkey").alias("src"), code("S", "s_suppkey").alias("dst")))
    return hierarchy.spread(edges, "S1", 6)


@query(
    "q_matched_period",
    with_views("""WITH m AS (SELECT n_nationkey, year(o_orderdate) * 12 + month(o_orderdate) AS period, sum(rev)::BIGINT AS value FROM sales WHERE n_nationkey IN (1, 2, 3) GROUP BY ALL),
    s AS (SELECT max(period) AS shared FROM (SELECT period FROM m GROUP BY period HAVING count(DISTINCT n_nationkey) = 3)),
    k AS (SELECT m.*, shared IS NOT NULL AS matched, row_number() OVER (PARTITION BY n_nationkey ORDER BY period DESC) AS nth FROM m, s WHERE shared IS NULL OR period = shared)
    SELECT n_nationkey, period::BIGINT AS period, value, matched FROM k WHERE nth = 1"""),
)
def matched_period(t: Tables):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    m = t.sales().filter(F.col("n_nationkey").isin(1, 2, 3)).groupBy("n_nationkey", month.alias("period")).agg(F.sum("rev").alias("value"))
    return joins.matched_period(m, "n_nationkey", "period", 3).select("n_nationkey", "period", "value", "matched")


CONTRACTS = """c AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS l_month, count(DISTINCT c_nationkey)::BIGINT AS coverage, max(year(o_orderdate))::BIGINT AS newest
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (1, 2, 3) GROUP BY ALL)"""


@query(
    "q_best_contract",
    f"""WITH {CONTRACTS} SELECT l_returnflag, l_month, coverage, newest, CASE WHEN coverage < 3 THEN 'covers ' || coverage || ' of 3' END AS reason,
    row_number() OVER (ORDER BY coverage DESC, newest DESC, l_returnflag, l_month) = 1 AS best FROM c""",
)
def best_contract(t: Tables):
    # A contract is a flag in a month of shipping; three places are compared, and few months at the ends have all.
    who = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter(F.col("c_nationkey").isin(1, 2, 3)).select("o_orderkey", "c_nationkey", F.year("o_orderdate").cast("long").alias("yr"))
    rows = t.lineitem.select("l_orderkey", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("l_month")).join(who, F.col("l_orderkey") == F.col("o_orderkey"))
    return joins.best_contract(rows, ["l_returnflag", "l_month"], "c_nationkey", "yr", 3)


@query(
    "q_range_lookup",
    """SELECT p_size, label, count(*)::BIGINT AS n FROM part LEFT JOIN (VALUES (1, 10, 'small'), (11, 25, 'medium'), (26, 44, 'large')) v(lo, hi, label) ON p_size BETWEEN lo AND hi GROUP BY ALL""",
)
def range_lookup(t: Tables):
    ranges = t.values([(1, 10, "small"), (11, 25, "medium"), (26, 44, "large")], "lo int, hi int, label string")
    return joins.range_lookup(t.part.groupBy("p_size").agg(F.count("*").alias("n")), "p_size", ranges).select("p_size", "label", "n")


#: Names of customers, and as a second source spells them: as they are, with a character lost, wrong or doubled, with two changes, or another name.
NAME = "concat(substr(md5({0}), 1, 10), ' ', lower(c_mktsegment))"
SPELT = """CASE {0} % 6 WHEN 0 THEN {1} WHEN 1 THEN concat(substr({1}, 1, 3), substr({1}, 5)) WHEN 2 THEN concat(substr({1}, 1, 5), 'x', substr({1}, 7)) WHEN 3 THEN concat(substr({1}, 1, 7), substr({1}, 7))
WHEN 4 THEN concat(substr({1}, 2, 4), 'zz', substr({1}, 8)) ELSE concat('no ', substr(md5(concat('-', {2})), 1, 14)) END"""


def spelt(kind: str) -> tuple[str, str]:
    key = f"CAST(c_custkey AS {kind})"
    return NAME.format(key), SPELT.format("c_custkey", NAME.format(key), key)


SOURCE_SQL, TARGET_SQL = (f"SELECT 1000000000 + c_custkey AS id, c_nationkey AS block, {spelt('VARCHAR')[1]} AS name FROM customer", f"SELECT c_custkey AS t_id, c_nationkey AS block, {spelt('VARCHAR')[0]} AS t_name FROM customer")


def two_sources(t: Tables):
    """The customers as a second source names them (id, block, name), and as we do (t_id, block, t_name)."""
    own, other = spelt("STRING")
    source = t.customer.select((F.col("c_custkey") + 1000000000).alias("id"), F.col("c_nationkey").alias("block"), F.expr(other).alias("name"))
    return source, t.customer.select(F.col("c_custkey").alias("t_id"), F.col("c_nationkey").alias("block"), F.expr(own).alias("t_name"))


@query(
    "q_fuzzy_match",
    f"""WITH s AS ({SOURCE_SQL}), t AS ({TARGET_SQL}),
    p AS (SELECT id, block, name, t_id, t_name, levenshtein(name, t_name) / greatest(length(name), length(t_name)) AS cost FROM s JOIN t USING (block)),
    r AS (SELECT *, row_number() OVER w AS k, lead(cost) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id ORDER BY cost, t_id))
    SELECT id, block, name, CASE WHEN cost <= 0.2 AND (nxt IS NULL OR nxt - cost >= 0.04) THEN t_id END AS t_id, CASE WHEN cost <= 0.2 AND (nxt IS NULL OR nxt - cost >= 0.04) THEN t_name END AS t_name FROM r WHERE k = 1""",
)
def fuzzy_match(t: Tables):
    source, target = two_sources(t)
    return joins.fuzzy_match(source, target, "block", "name", "t_name", "t_id", 0.2, 0.04).select("id", "block", "name", "t_id", "t_name")


@query("q_similar_names", f"WITH s AS ({SOURCE_SQL}), t AS ({TARGET_SQL}) SELECT block, name, t_name, levenshtein(name, t_name) / greatest(length(name), length(t_name)) AS cost FROM s JOIN t USING (block) WHERE levenshtein(name, t_name) / greatest(length(name), length(t_name)) <= 0.45 GROUP BY ALL")
def similar_names(t: Tables):
    """All pairs of a block at most 0.45 apart, also where that is loose enough for many to share grams."""
    source, target = two_sources(t)
    return similar.pairs(source, target, "block", "name", "t_name", 0.45)


@query(
    "q_er_cascade",
    f"""WITH s AS (SELECT id, block, name, 'C' || CASE WHEN id % 3 = 0 THEN id ELSE id - 1000000000 END AS code FROM ({SOURCE_SQL})), t AS (SELECT t_id, block, t_name AS name, 'C' || t_id AS code FROM ({TARGET_SQL})),
    a AS (SELECT s.id, t.t_id, 'name' AS method FROM s JOIN t USING (name)),
    b AS (SELECT s.id, t.t_id, 'code' AS method FROM s JOIN t USING (code) WHERE s.id NOT IN (SELECT id FROM a) AND t.t_id NOT IN (SELECT t_id FROM a)),
    m AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    sr AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS k FROM s WHERE id NOT IN (SELECT id FROM m)),
    tr AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY t_id) AS k FROM t WHERE t_id NOT IN (SELECT t_id FROM m))
    SELECT id, t_id, method FROM m UNION ALL SELECT sr.id, tr.t_id, CASE WHEN tr.t_id IS NULL THEN 'unmatched' ELSE 'residual' END FROM sr LEFT JOIN tr USING (block, k)""",
)
def er_cascade(t: Tables):
    source, target = two_sources(t)
    source = source.withColumn("code", F.concat(F.lit("C"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") - 1000000000).cast("string")))
    target = target.select("t_id", "block", F.col("t_name").alias("name"), F.concat(F.lit("C"), F.col("t_id").cast("string")).alias("code"))
    return joins.resolve(source, target, "id", [("name", ["name"]), ("code", ["code"])], (["block"], "id", "t_id"))


@query(
    "q_er_names",
    f"""WITH s AS ({SOURCE_SQL}), t AS ({TARGET_SQL}), e AS (SELECT id, t_id, 'exact' AS method FROM s JOIN t ON s.block = t.block AND s.name = t.t_name),
    s1 AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM e)), t1 AS (SELECT * FROM t WHERE t_id NOT IN (SELECT t_id FROM e)),
    p AS (SELECT id, t_id, levenshtein(name, t_name) / greatest(length(name), length(t_name)) AS cost FROM s1 JOIN t1 USING (block)),
    r AS (SELECT *, row_number() OVER w AS k, lead(cost) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id ORDER BY cost, t_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY cost, id) AS j FROM r WHERE k = 1 AND cost <= 0.2 AND (nxt IS NULL OR nxt - cost >= 0.04)),
    m AS (SELECT * FROM e UNION ALL SELECT id, t_id, 'fuzzy in parent' FROM b WHERE j = 1),
    s2 AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS k, count(*) OVER (PARTITION BY block) AS c FROM s WHERE id NOT IN (SELECT id FROM m)),
    t2 AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY t_id) AS k, count(*) OVER (PARTITION BY block) AS c FROM t WHERE t_id NOT IN (SELECT t_id FROM m)),
    g AS (SELECT id, t_id, CASE WHEN c = 1 THEN 'unique residual' ELSE 'complete group' END AS method FROM s2 JOIN t2 USING (block, k, c))
    SELECT * FROM m UNION ALL SELECT * FROM g UNION ALL SELECT id, NULL, 'unmatched' FROM s2 WHERE id NOT IN (SELECT id FROM g)""",
)
def er_names(t: Tables):
    """All customers against their names in the second source, in passes: exact, alike within the parent, what is left of a group."""
    source, target = two_sources(t)
    passes = [joins.equal_pass("exact", ["block", "name"]), joins.fuzzy_pass("fuzzy in parent", "block", "name", 0.2, 0.04), joins.group_pass("complete group", "unique residual", ["block"])]
    return joins.resolve_by(source, target.withColumnRenamed("t_name", "name"), "id", passes)


def boxes(df, key: str, p: str):
    """Rectangles on a grid of whole numbers, made from a key."""
    k = F.col(key)
    x, y = (k * 37) % 200, (k * 91) % 200
    return df.select(k, x.alias(f"{p}x0"), y.alias(f"{p}y0"), (x + 5 + k % 7).alias(f"{p}x1"), (y + 5 + k % 11).alias(f"{p}y1"))


BOXES = """a AS (SELECT c_custkey, (c_custkey * 37) % 200 AS x0, (c_custkey * 91) % 200 AS y0, (c_custkey * 37) % 200 + 5 + c_custkey % 7 AS x1, (c_custkey * 91) % 200 + 5 + c_custkey % 11 AS y1 FROM customer),
b AS (SELECT s_suppkey, (s_suppkey * 37) % 200 AS x0, (s_suppkey * 91) % 200 AS y0, (s_suppkey * 37) % 200 + 5 + s_suppkey % 7 AS x1, (s_suppkey * 91) % 200 + 5 + s_suppkey % 11 AS y1 FROM supplier),
o AS (SELECT c_custkey, s_suppkey, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS overlap, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb
  FROM a, b WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
g AS (SELECT *, overlap / (sa + sb - overlap) AS iou FROM o WHERE overlap / (sa + sb - overlap) >= 0.25)"""


@query("q_bbox_iou", f"WITH {BOXES} SELECT c_custkey, s_suppkey, overlap::BIGINT AS overlap, iou FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY iou DESC, s_suppkey) AS k FROM g) WHERE k = 1")
def bbox_iou(t: Tables):
    return joins.best_box(boxes(t.customer, "c_custkey", "a_"), boxes(t.supplier, "s_suppkey", "b_"), "c_custkey", "s_suppkey", 20, 0.25)


TRIGGERS = [("P1", ["DISC", "REV"]), ("P2", ["ORDERS"]), ("P3", ["QTY", "ORDERS", "REV"])]


@query(
    "q_trigger_match",
    with_views("""WITH md AS (SELECT metric, median(value) AS m FROM latest_obs GROUP BY metric), gap AS (SELECT n_nationkey, l.metric FROM latest_obs l JOIN md USING (metric) WHERE value < m),
    pr AS (SELECT * FROM (VALUES ('P1', 0, 'DISC'), ('P1', 1, 'REV'), ('P2', 0, 'ORDERS'), ('P3', 0, 'QTY'), ('P3', 1, 'ORDERS'), ('P3', 2, 'REV')) v(programme, pos, metric))
    SELECT programme, n_nationkey, arg_min(metric, pos) AS "trigger", min(pos)::BIGINT AS pos FROM pr JOIN gap USING (metric) GROUP BY ALL"""),
)
def trigger_match(t: Tables):
    latest = t.latest_obs()
    medians = latest.groupBy("metric").agg(F.median("value").alias("m"))
    hits = latest.join(F.broadcast(medians), "metric").filter("value < m").select("n_nationkey", "metric")
    lists = t.values(TRIGGERS, "programme string, codes array<string>")
    return joins.first_trigger(lists, "programme", "codes", hits, "metric").withColumn("pos", F.col("pos").cast("long"))


@query("q_symmetric", "WITH l AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT a, b, CASE WHEN a = b THEN 'self' ELSE 'one-way' END AS problem FROM l WHERE a = b OR NOT EXISTS (SELECT 1 FROM l m WHERE m.a = l.b AND m.b = l.a)")
def symmetric(t: Tables):
    return joins.asymmetric(t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct(), "a", "b")
