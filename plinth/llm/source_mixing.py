"""Mixing sources to target weights by hash-threshold histograms, in DataFrame expressions alone.

Sources in code point order take shares of a budget by repeating weights; a share stops at a multiple of its source, and what is over
goes to the others by weight. A share below the source takes a subset of its documents, one above takes all of them and a subset once more.
A subset is the documents whose hash is at most a threshold, so no document is sorted: words are summed by source and bucket of the hash,
the running sums show the bucket in which the target is met, and only the documents of that bucket are dealt to finer buckets,
until it holds one hash. Thresholds are nested: a larger target keeps all that a smaller one takes.

The table is read once, to a narrow written one (key, size, hash). A source with a third of all rows is one sum a task; its boundary
bucket is a 4096th of it. Nothing by document comes to the driver; of sources, only sums do.

Defined results: a null text has size 0. A null source is a source of its own, the last. Rows that agree in id and text have one hash and are taken together.
Of the two cuts around the target the nearer is taken, the smaller of equal ones. No words at all: targets 0. Every row gives one row; only
doc_id, text, source are read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joined_by_count, materialise, shards, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Bits of the hash, and bits that one histogram looks at (a source has 4096 buckets at most in each).
HASH_BITS, LEVEL_BITS = 60, 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key, size, h: the key orders sources by code point, null last; the hash is the first 60 bits of a digest of id and text."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("z"))
    return docs.select(F.col("doc_id").cast("long"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"))


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sources with the weight of their place in the order of keys. Places are counted within ranges of keys, and the ranges' sizes added up."""
    dealt = materialise(sources.repartitionByRange(shards(sources), "key").withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for q, n in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    place = F.get(F.array(*map(F.lit, before)), F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights))).drop("part")


def targeted(sources: DataFrame, total: int, percent: int, most: int) -> DataFrame:
    """sources with target: their weighted share of percent of the total, at most `most` times their size, the rest reshared by weight.
    Shares are compared as whole numbers: a share is weight * over / (100 * weights), over being 100 times what is left to share."""
    big = lambda c: c.cast("decimal(38,0)")
    cap, taken, capped_n = F.col("source_size") * most, 0, 0
    weights = int(sources.agg(F.sum("weight")).first()[0] or 0)
    while True:
        over = percent * total - 100 * taken
        part = big(F.col("weight")) * big(F.lit(over))
        above = part > big(cap) * big(F.lit(100 * weights))
        s = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
        if s.n == capped_n:
            share = part.cast("double") / F.lit(100 * weights).cast("double")
            return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share if weights else F.lit(0.0)))
        capped_n, taken, weights = s.n, int(s.taken), int(s.weights or 0)


def thresholds(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, threshold of the hash up to which documents are taken, so that their sizes come nearest to wanted.rest (> 0). Keys whose documents don't reach it are left out."""
    found: list[DataFrame] = []
    edge = wanted.select("key", "rest", F.lit(0).cast("long").alias("before"))
    rows = docs.select("key", "size", "h")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("h", shift).alias("bucket")
        sums = rows.groupBy("key", bucket).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        crossed = sums.join(edge, "key").withColumn("upto", upto).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        level = materialise(crossed.select("key", "rest", "bucket", "lo", "hi", "upto", (F.col("upto") - F.col("words")).alias("before")))
        nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
        found.append(level.filter("lo = hi").select("key", F.when(nearer, F.col("hi")).otherwise(F.col("lo") - 1).alias("threshold")))
        edge = level.filter("lo < hi")
        if edge.isEmpty():
            break
        # A bucket is a 4096th of its source, so rows meet theirs evenly whatever the source's size.
        rows = docs.select("key", "size", "h", bucket).join(edge.select("key", "bucket"), ["key", "bucket"], "left_semi").select("key", "size", "h")
        edge = edge.select("key", "rest", "before")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source): taken is the document's size times how often the mix takes it."""
    narrow = materialise(sized(docs))
    sources = weighted(narrow.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights)
    sums = sources.agg(F.sum("source_size").alias("words"), F.sum("n_docs").alias("n")).first()
    aimed = materialise(targeted(sources, sums.words or 0, percent, most))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = aimed.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    cut = thresholds(narrow, wanted.filter("rest > 0"))
    none_or_all = F.when(F.col("rest") > 0, F.lit((1 << HASH_BITS) - 1)).otherwise(-1)
    per = materialise(wanted.join(cut, "key", "left").withColumn("threshold", F.coalesce("threshold", none_or_all)))
    taken: Column = F.col("size") * (F.col("times") + (F.col("h") <= F.col("threshold")).cast("long"))
    return joined_by_count(narrow, per, ["key"], "n_docs", sums.n or 0).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'z') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT k, S, [5, 2, 1][1 + (row_number() OVER (ORDER BY k) - 1) % 3]::BIGINT AS w, sum(S) OVER ()::HUGEINT AS T FROM (SELECT k, sum(size)::BIGINT AS S FROM d GROUP BY k)),
r AS (SELECT *, row_number() OVER (ORDER BY S::DOUBLE / w, k) AS pos, coalesce(sum(2 * S) OVER (ORDER BY S::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS C,
             sum(w) OVER (ORDER BY S::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS W2 FROM s),
f AS (SELECT min(pos) AS p, arg_min(C, pos) AS C, arg_min(W2, pos) AS W2 FROM r WHERE w * (150 * T - 100 * C) <= 2 * S * 100 * W2),
t AS (SELECT k, S, CASE WHEN pos < p THEN (2 * S)::DOUBLE ELSE (w * (150 * T - 100 * f.C))::DOUBLE / (100 * f.W2)::DOUBLE END AS target FROM r, f),
q AS (SELECT *, CASE WHEN S > 0 THEN floor(target / S)::BIGINT ELSE 0 END AS times FROM t),
c AS (SELECT k, h, x, sum(x) OVER (PARTITION BY k ORDER BY h)::BIGINT AS upto FROM (SELECT k, h, sum(size)::BIGINT AS x FROM d GROUP BY k, h)),
e AS (SELECT k, CASE WHEN upto - rest < rest - (upto - x) THEN h ELSE h - 1 END AS cut FROM c JOIN (SELECT *, target - times * S AS rest FROM q) USING (k) WHERE rest > 0 AND upto >= rest AND upto - x < rest)
SELECT doc_id, size, S::BIGINT AS source_size, target, (size * (times + CASE WHEN h <= coalesce(cut, CASE WHEN target - times * S > 0 THEN 1152921504606846975 ELSE -1 END) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q USING (k) LEFT JOIN e USING (k)
"""
