"""Queries that write a table in one of the published formats and read it back: readers and sinks against each other and against the table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import export
from ..sources import layers, readers
from .base import Tables, query


def folder(t: Tables) -> str:
    """A new folder where the driver and the executors can write: that of spark.checkpoint.dir, or a temporary one where all runs in one process."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}').rstrip('/')}/plinth-files/{uuid.uuid4().hex}"


@query(
    "q_csv_files",
    """SELECT p_partkey, p_name || ' "' || p_brand || '", ' || p_type AS label, nullif(CASE WHEN p_size < 10 THEN '' ELSE p_type END, '') AS kind, array_to_string(string_split(p_name, ' '), '|') AS tags FROM part""",
)
def csv_files(t: Tables):
    label = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", '), "p_type")
    path = folder(t)
    export.write_csv(t.part.select("p_partkey", label.alias("label"), F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type")).alias("kind"), F.split("p_name", " ").alias("tags")), path)
    return readers.csv(t.spark, path, "p_partkey long, label string, kind string, tags string")


@query("q_ndjson_files", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer")
def ndjson_files(t: Tables):
    path = folder(t)
    export.write_ndjson(t.customer.select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment")), path)
    return readers.ndjson(t.spark, path, "c_custkey long, c_name string, c_nationkey int, segment string")


@query("q_json_array_files", "SELECT c_nationkey, c_custkey, c_name FROM customer")
def json_array_files(t: Tables):
    """JSON arrays of a nation's customers, a thousand numbers each, so that no array grows with a nation."""
    path = folder(t)
    part = ["c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("part")]
    arrays = t.customer.groupBy(*part).agg(F.to_json(F.collect_list(F.struct("c_nationkey", "c_custkey", "c_name"))).alias("value"))
    arrays.repartition("c_nationkey", "part").write.partitionBy("c_nationkey", "part").text(path)
    parts = t.spark.read.text(f"{path}/*/*/*.txt")
    return parts.select(F.explode(F.from_json("value", "array<struct<c_nationkey: int, c_custkey: long, c_name: string>>")).alias("j")).select("j.*")


@query("q_bundle_files", "SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY ALL")
def bundle_files(t: Tables):
    path = folder(t)
    export.write_bundles(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey"), path, "c_nationkey", "c_mktsegment")
    back = t.spark.read.schema("c_custkey long, c_nationkey int, c_mktsegment string").json(path)
    return back.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query(
    "q_manifest_files",
    """WITH b AS (SELECT n_regionkey::VARCHAR AS n_regionkey, n_nationkey::VARCHAR AS n_nationkey, '{"n_name":"' || n_name || '"}' || chr(10) AS body FROM nation) SELECT n_regionkey, n_nationkey, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256 FROM b""",
)
def manifest_files(t: Tables):
    return export.write_with_manifest(t.nation, folder(t), "n_regionkey", "n_nationkey").select("n_regionkey", "n_nationkey", "bytes", "sha256")


@query(
    "q_panel_files",
    """WITH w AS (SELECT c_mktsegment AS code, year(o_orderdate)::BIGINT AS year, count(*)::BIGINT AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL)
    SELECT code, year, value, NULL::VARCHAR AS note FROM w UNION ALL SELECT 'ALL', 1995, count(*)::BIGINT, 'total' FROM orders WHERE year(o_orderdate) = 1995""",
)
def panel_files(t: Tables):
    """A wide panel as CSV, read and unpivoted; then united with a file of another schema."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    path, more = folder(t), folder(t)
    export.write_csv(j.groupBy(F.col("c_mktsegment").alias("code")).agg(*[F.count_if(F.year("o_orderdate") == y).alias(str(y)) for y in (1995, 1996)]), path)
    export.write_ndjson(t.orders.filter(F.year("o_orderdate") == 1995).agg(F.lit("ALL").alias("code"), F.lit(1995).cast("long").alias("year"), F.count("*").alias("value"), F.lit("total").alias("note")), more)
    wide = readers.csv(t.spark, path, "code string, `1995` long, `1996` long")
    return readers.union_all([readers.unpivot_years(wide, ["code"]), readers.ndjson(t.spark, more, "code string, year long, value long, note string")])


@query("q_geojson_files", """SELECT s_name AS name, s_nationkey AS nation, 'Point' AS geometry_type, '[' || s_suppkey % 180 || ',' || s_nationkey || ']' AS coordinates FROM supplier""")
def geojson_files(t: Tables):
    """Feature collections of a nation, a thousand numbers each; each a file of its own, as a file is one document."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey") % 180, F.col("s_nationkey").cast("long")).alias("coordinates")).alias("geometry"))
    layers = t.supplier.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 1000).alias("part")).agg(F.collect_list(feature).alias("features")).select("s_nationkey", "part", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    path = folder(t)
    layers.repartition("s_nationkey", "part").write.partitionBy("s_nationkey", "part").text(path)
    return readers.features(t.spark, f"{path}/*/*/*.txt", "name: string, nation: int")


@query("q_embedded_json", """SELECT page_id, length(url)::BIGINT AS n FROM pages""")
def embedded(t: Tables):
    """A page's data island: JSON in a script element among others."""
    body = F.to_json(F.struct("page_id", F.length("url").alias("n")))
    page = F.concat("html", F.lit('<script type="application/json" id="data">'), body, F.lit("</script>"))
    found = t.pages.select(F.explode(readers.embedded_json(page)).alias("j")).select(F.from_json("j", "page_id long, n long").alias("j"))
    return found.select("j.page_id", "j.n")


@query("q_document_scan", "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey > 5")
def document_scan(t: Tables):
    """One JSON document a nation; those of a folder whose fields hold the condition."""
    path = folder(t)
    docs = t.places().select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", F.struct(F.col("r_name").alias("name")).alias("region"))).alias("value"))
    docs.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    keep = F.col("region.name").isin("ASIA", "EUROPE") & (F.col("n_nationkey") > 5)
    return readers.documents(t.spark, f"{path}/*/*.txt", "n_nationkey int, n_name string, region struct<name: string>", keep).select("n_nationkey", "n_name")


@query("q_pretty_json", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def pretty_json(t: Tables):
    """Indented documents, parted by line feeds, are read as a stream of JSON values."""
    path = folder(t)
    export.write_pretty(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), path)
    text = t.spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\{.*?\n\}"), F.lit(0))).alias("j"))
    return parts.select(F.from_json("j", "s_suppkey long, s_name string, s_nationkey long").alias("j")).select("j.*")


@query("q_dbf_files", "SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 7 <> 3 THEN c_acctbal END AS balance, c_acctbal > 0 AS owed FROM customer WHERE c_custkey % 5 <> 4")
def dbf_files(t: Tables):
    """All customers as dBASE tables, a fifth of them marked as deleted, read by ranges of records."""
    path = folder(t)
    rows = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 != 3, F.col("c_acctbal")).alias("balance"), (F.col("c_acctbal") > 0).alias("owed"), (F.col("c_custkey") % 5 == 4).alias("_deleted"))
    layers.write_dbf(rows.repartition(3), path, widths="name:40")
    return layers.kept(layers.read_dbf(t.spark, path, records=500))


@query("q_dbf_columns", "SELECT c_nationkey AS nation, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def dbf_columns(t: Tables):
    """Two of the fields of a dBASE table; only these are decoded."""
    path = folder(t)
    layers.write_dbf(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), path)
    return layers.read_dbf(t.spark, path, "key long, nation int").groupBy("nation").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("q_layer_files", "SELECT s_suppkey AS key, s_name AS name, (2 * r * r - 4 * h * h)::DOUBLE AS area, 2::INTEGER AS rings FROM (SELECT *, 3 + s_suppkey % 4 AS r, 1 + s_suppkey % 2 AS h FROM supplier)")
def layer_files(t: Tables):
    """All suppliers' polygons as shapefiles with their attributes, put together again by file and record number."""
    from ..functions import geo
    from .geometry import diamonds

    path = folder(t)
    layers.write_layer(diamonds(t).join(t.supplier.select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey").select(F.col("s_suppkey").alias("key"), "name", "polygon"), path, widths="name:30")
    found = layers.kept(layers.read_layer(t.spark, path, records=40))
    return found.select("key", "name", geo.polygon_area(F.col("polygon")).alias("area"), F.size("polygon").alias("rings"))


@query("q_squashed_cells", r"""SELECT p_partkey, trim(regexp_replace(p_name || '   ' || p_type, '\s+', ' ', 'g')) AS label FROM part""")
def squashed_cells(t: Tables):
    """Quoted cells with runs of spaces, read with white space squashed."""
    path = folder(t)
    export.write_csv(t.part.select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("   "), "p_type", F.lit("  ")).alias("label")), path)
    return readers.csv(t.spark, path, "p_partkey long, label string", squash=True)
