"""Benchmark decontamination in DataFrame expressions alone.

The benchmark's windows of normalised words, and their pieces, are hash sets shipped with the plan, up to a checked bound. A window of n
words holds one whole aligned piece of (n + 1) // 2 words of any document that it occurs in. So a document is cut into aligned pieces; only
where one is in the set are all its windows of the lengths that go with that piece size built and looked up, and hits find their
items in a table by hash. All of this happens in the scan, within the row: no shuffle, and nothing that grows with the documents is broadcast.

A benchmark beyond the bound is joined instead: the 64-bit hashes of its windows are broadcast (8 bytes each, up to a second bound;
beyond that, both sides are shuffled by hash), and only windows whose hash is found are shuffled, to be verified word for word. Both ways give the same rows.

Defined results: null or word-free texts have no hits. Each row gives one row, repeated ids included. items_sha256 is that of
the empty string where no item occurs. Items with no words have no window. Items of one id are one item, and so are all without an id:
these count in n_hit, contaminated and, as one, in n_items, but have no id to be listed in items_sha256. Only doc_id, text, item_id are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, materialise, table, unboxed

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Words in lower case (A-Z only) with one space between; empty for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.trim(F.regexp_replace(low, BREAKS, " "))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def windows_of(words: Column, size: Column | int) -> Column:
    """Runs of `size` consecutive words, each joined by spaces, in order."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, length, w: the distinct windows of each item, all of `size` words or the whole of a shorter item."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(normalised(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.size("words"), F.lit(size)))
    return words.select("item_id", "length", F.explode(windows_of(F.col("words"), F.col("length"))).alias("w")).distinct()


def nothing(n_words: Column) -> dict[str, Column]:
    return {"n_words": n_words, "n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256), "contaminated": F.lit(False)}


def hit_of(n_words: Column, n_hit: Column, items: Column) -> Column:
    """items: distinct ids of the items found, null for those without one."""
    return F.struct(
        n_words.alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, most_windows: int = 50_000, most_hashes: int = 4_000_000) -> DataFrame:
    """For each row of docs: row (its columns), doc_id, and hit: a struct of n_words, n_hit, n_items, items_sha256, contaminated.
    most_windows bounds the sets shipped with the plan (windows, once for each item), most_hashes the hashes broadcast for a join."""
    found = materialise(benchmark_windows(items, size))
    count = found.count()
    if not count:
        norm = normalised(F.col("text"))
        return boxed(docs).select("row", "doc_id", F.struct(*[v.alias(k) for k, v in nothing(F.size(words_of(norm)).cast("long")).items()]).alias("hit"))
    if count > most_windows:
        return joined(docs, found, count <= most_hashes)
    return in_scan(docs, found.collect())


def half(n: int) -> int:
    """Words of the aligned pieces that windows of n words are sought by."""
    return (n + 1) // 2


#: Buckets of the table from windows to items.
BUCKETS = 1024


def one_of(values: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(values)


def in_scan(docs: DataFrame, rows: list) -> DataFrame:
    """The main path: every lookup is in a hash set or table within the plan."""
    lengths = {r.w: r.length for r in rows}
    ids: dict[str, list] = {}
    for r in rows:
        ids.setdefault(r.w, []).append(r.item_id)
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for w in sorted(ids):
        buckets[zlib.crc32(w.encode()) % BUCKETS].append({"w": w, "ids": sorted(ids[w], key=lambda x: (x is None, x))})
    items = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<w: string, ids: array<string>>>>")
    by_piece: dict[int, dict[int, list[str]]] = {}
    for w, n in sorted(lengths.items()):
        by_piece.setdefault(half(n), {}).setdefault(n, []).append(w)
    none, spots = F.array().cast("array<string>"), "array<struct<at: int, w: string, n: int>>"

    base = boxed(docs).withColumn("t_norm", normalised(F.col("text")))
    n_words = F.when(F.col("t_norm") == "", 0).otherwise(F.length("t_norm") - F.length(F.replace("t_norm", F.lit(" "), F.lit(""))) + 1).cast("long")
    base = base.withColumn("t_n", n_words)
    for piece, own in by_piece.items():
        pieces = sorted({" ".join(x[i : i + piece]) + " " for ws in own.values() for x in (w.split(" ") for w in ws) for i in range(len(x) - piece + 1)})
        cut = F.regexp_extract_all(F.concat("t_norm", F.lit(" ")), F.lit(f"(?:[^ ]+ ){{{piece}}}"), F.lit(0))
        base = base.withColumn(f"t_suspect_{piece}", F.exists(cut, one_of(pieces)))
    suspect = {p: F.col(f"t_suspect_{p}") for p in by_piece}
    base = base.withColumn("t_words", F.when(sum((s.cast("int") for s in suspect.values()), F.lit(0)) > 0, words_of(F.col("t_norm"))))

    def hits(n: int, windows: list[str]) -> Column:
        at = F.transform(windows_of(F.col("t_words"), n), lambda w, i: F.struct(i.alias("at"), w.alias("w"), F.lit(n).alias("n")))
        return F.filter(at, lambda x: x.w.isin(windows))

    found = [F.when(suspect[p], hits(n, ws)).otherwise(F.array().cast(spots)) for p, own in by_piece.items() for n, ws in own.items()]
    base = base.withColumn("t_hits", F.when(F.col("t_words").isNull(), F.array().cast(spots)).otherwise(F.concat(*found)))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_hits", lambda x: F.sequence(x.at, x.at + x.n - 1)))))
    of = F.transform(F.array_distinct(F.transform("t_hits", lambda x: x.w)), lambda w: F.flatten(F.transform(F.filter(F.get(items, F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(BUCKETS)).cast("int")), lambda x: x.w == w), lambda x: x.ids)))
    base = base.withColumn("t_items", F.when(F.size("t_hits") > 0, F.array_distinct(F.flatten(of))).otherwise(none))
    return base.select("row", "doc_id", hit_of(F.col("t_n"), F.when(F.size("t_hits") > 0, covered).otherwise(0), F.col("t_items")).alias("hit"))


def joined(docs: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """For a benchmark too large for the plan: hashes of document windows meet the benchmark's, which are broadcast if small, and
    what is found is verified word for word."""
    hashed = found.select("length", F.xxhash64("w").alias("h")).distinct()
    lengths = sorted(r.length for r in found.select("length").distinct().collect())
    base = boxed(docs).withColumn("t_norm", normalised(F.col("text")))
    keyed = base.select("k_id", "k_text", words_of(F.col("t_norm")).alias("t_words"))

    def windows(n: int) -> Column:
        return F.transform(windows_of(F.col("t_words"), n), lambda w, i: F.struct(i.alias("at"), F.xxhash64(w).alias("h"), F.lit(n).alias("length")))

    at = keyed.select("k_id", "k_text", "t_words", F.explode(F.concat(*map(windows, lengths))).alias("x")).select("k_id", "k_text", "t_words", "x.*")
    if small:
        met = at.join(F.broadcast(hashed), ["length", "h"], "left_semi")
        met = met.select("k_id", "k_text", "at", "length", F.array_join(F.slice("t_words", F.col("at") + 1, F.col("length")), " ").alias("w"))
    else:  # the words stay behind, and come to the places found by their document
        places = at.drop("t_words").join(hashed, ["length", "h"], "left_semi").groupBy("k_id", "k_text").agg(F.collect_set(F.struct("at", "length")).alias("places"))
        met = keyed.join(places, ["k_id", "k_text"]).select("k_id", "k_text", "t_words", F.explode("places").alias("x"))
        met = met.select("k_id", "k_text", "x.*", F.array_join(F.slice("t_words", F.col("x.at") + 1, F.col("x.length")), " ").alias("w"))
    spots = met.distinct().join(found, ["length", "w"])
    per = spots.groupBy("k_id", "k_text").agg(
        F.collect_set(F.struct("item_id")).alias("t_items"), F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1))))).alias("t_hit")
    )
    out = base.join(materialise(per), ["k_id", "k_text"], "left")
    items = F.coalesce(F.transform("t_items", lambda x: x.item_id), F.array().cast("array<string>"))
    return out.select("row", "doc_id", hit_of(F.size(words_of(F.col("t_norm"))).cast("long"), F.coalesce("t_hit", F.lit(0)), items).alias("hit"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, with the columns they came with."""
    # The flags are written before they are filtered: a filter is pushed below the expressions it reads, with copies of them
    # inside each other, and would cut a document's words anew for each window.
    out = materialise(decontaminate(docs, items, size).select("row", F.col("hit.contaminated").alias("contaminated"))).filter(~F.col("contaminated"))
    return out.select(*unboxed(out, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hit.*")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT n FROM bx),
dx AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ls WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dx JOIN bx USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
