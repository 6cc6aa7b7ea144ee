"""Quality rules with host verdicts.

Each document is judged by base rules. Rule failures are aggregated by host (the `source` column); every host's failure
rate is shrunk towards the corpus by a beta prior whose strength is fitted by moments over all hosts, and hosts whose
shrunken rate is over a threshold are rejected with all their documents. Aggregation by host combines in the map tasks,
so a host with a third of all rows sends one row a task; verdicts come back by an equi-join that adaptive execution
broadcasts when the verdicts are few and splits when a host is hot.

Defined results: a null text has no words and so fails. Documents with no host are judged by the base rules alone.
Every row gives one row, repeated ids included. Only doc_id, text and source are read. An empty table gives an empty result.
Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, materialise, table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
WINDOW = 5


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    seen, again = set(), set()
    for g in grams:
        (again if g in seen else seen).add(g)
    covered, reach = 0, 0
    for i, g in enumerate(grams):
        if g in again:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    blanks = len(data) - len(data.translate(None, SPACE))
    return len(words), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_rules(docs: DataFrame, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    def factory():
        def run(columns):
            ids, texts, hosts = columns
            found = [measures(t) for t in texts]
            out = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zip(*found)))
            return out | {"doc_id": ids, "host": hosts, "base_failed": [x[0] < min_words or 100 * x[4] > repeat_percent * x[0] for x in found]}

        return run

    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string").alias("host")), schema, factory, 1)


def host_rates(judged: DataFrame, flat_strength: float = 100.0) -> DataFrame:
    """host, n, failed, and rate: the failure rate shrunk by an empirical beta prior."""
    hosts = materialise(judged.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    m = hosts.agg(F.sum("n"), F.sum("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n"))).first()
    total, failed, squares = (m[0] or 0), (m[1] or 0), (m[2] or 0.0)
    mean = failed / total if total else 0.0
    spread = squares / total - mean * mean if total else 0.0
    strength = max(mean * (1 - mean) / spread - 1, 1.0) if spread > 1e-12 else flat_strength
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def quality_rules(docs: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): the measures, base_failed, host_rejected and kept."""
    judged = materialise(base_rules(docs))
    bad = host_rates(judged).filter(F.col("rate") > max_host_rate).select("host", F.lit(True).alias("bad"))
    return judged.join(bad, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("bad", F.lit(False)).alias("host_rejected"), (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n)) AS spread FROM h),
s AS (SELECT mean, CASE WHEN spread > 1e-12 THEN greatest(mean * (1 - mean) / spread - 1, 1.0) ELSE 100.0 END AS strength FROM m),
bad AS (SELECT source FROM h, s WHERE (x + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       bad.source IS NOT NULL AS host_rejected, NOT base_failed AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
"""
