"""Line dedup by overlapping three-line windows.

A window is three consecutive non-blank lines of a document, compared without the spaces around them. Windows are hashed
(128 bits) and counted over the whole corpus; in each group of equal windows the first by (doc_id, position) stays, and the
lines that later ones cover are removed, covered positions merged. Counting combines in the map tasks, so a
window that is everywhere sends one row a task; the later occurrences are found by an equi-join between two written
tables, in which the frequent windows (one in 4096 occurrences, so 4096 at most) are broadcast; nothing is gathered but the covered lines of one document.

Defined results: a null or empty text has no lines (n_lines 0) and stays as it is. Blank lines are never part of a window and go
only if they lie between removed lines of one window. Documents with fewer than three non-blank lines lose nothing. Equal
rows (same id, same text) are one document. Null ids come first in order, and further columns are passed through by `dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, joined_by_count, materialise, row_key, table, unboxed

WIDTH = 3


def lines_of(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def windows(docs: DataFrame, width: int) -> DataFrame:
    """k_id, k_text, first and last line number, and the hash of each window."""
    filled = F.filter(F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("l"))), lambda x: x.l != "")
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), filled.alias("ls")).filter(F.size("ls") >= width)
    starts = F.sequence(F.lit(0), F.size("ls") - width)

    def window(at: Column) -> Column:
        parts = [F.get("ls", at + i) for i in range(width)]
        return F.struct(
            parts[0].i.alias("at"), parts[-1].i.alias("last"),
            F.xxhash64(F.lit(1), *[x.l for x in parts]).alias("h1"), F.xxhash64(F.lit(2), *[x.l for x in parts]).alias("h2"),
        )

    return rows.select("k_id", "k_text", F.explode(F.transform(starts, window)).alias("w")).select("k_id", "k_text", "w.*")


def covered_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """k_id, k_text, and the numbers of the lines that go."""
    found = materialise(windows(docs, width))
    place = F.struct("k_id", "k_text", "at")
    repeated = materialise(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count("*").alias("n")).filter("first <> final").select("h1", "h2", "first", "n"))
    later = joined_by_count(found, repeated, ["h1", "h2"], "n", found.count()).filter(place != F.col("first"))
    spans = later.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("at", "last")).alias("spans"))
    return spans.select("k_id", "k_text", F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x.at, x.last)))).alias("gone"))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row of docs: row (its columns), doc_id, kept (the text that stays), n_lines, n_removed, n_filled (lines that stay and aren't blank)."""
    # The lines are a column of their own: an expression inside a lambda would be evaluated for each line.
    joined = boxed(docs).join(covered_lines(docs, width), ["k_id", "k_text"], "left").withColumn("ls", lines_of(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("ls", i)), "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    filled = F.array_compact(F.transform("ls", lambda x, i: F.when(F.trim(x) != "", i)))
    n_filled = F.size(F.array_except(filled, F.coalesce("gone", F.array().cast("array<int>"))))
    return joined.select("row", "doc_id", kept.alias("kept"), F.size("ls").cast("long").alias("n_lines"), removed.alias("n_removed"), n_filled.cast("long").alias("n_filled"))


def clean(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the text that stays, without the documents of which no text stays."""
    out = dedup(docs, width).filter((F.col("n_removed") == 0) | (F.col("n_filled") > 0))
    return out.select(*unboxed(out, docs.columns, F.col("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("kept", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text, 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
f AS (SELECT doc_id, i, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> ''),
w AS (SELECT doc_id, i AS first, lead(i, 2) OVER o AS last, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY win ORDER BY doc_id, first) AS nth FROM w WHERE win IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM r WHERE nth > 1),
k AS (SELECT l.doc_id, count(c.i) AS n, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS kept FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_removed, strlen(coalesce(kept, ''))::BIGINT AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
