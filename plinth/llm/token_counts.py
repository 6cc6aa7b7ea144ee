"""Token counts by a two-tier, map-side lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once. Tier two is a bounded cache in each
Python worker, filled by encoding the misses of a slice of documents in one call. The documents' pre-tokens are never shuffled;
the table is made of a bounded sample, counted where it is read (each task holds the counts of its share), and only those counts are summed.

Defined results: a null text counts as empty (0 bytes, 0 tokens). Every row gives one row, repeated ids included; only
the id and text columns are read, so further columns of any name do no harm. An empty table gives an empty result.
Texts are read whole. A text with characters outside a plainly classified range, or that may hold a special string, is
encoded whole by the library, so special strings count as the library's defaults make them.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DIGITS, LETTERS, PieceCache, is_plain, map_slices, sliced, table

#: The pre-tokenizer's pattern for plain text, after lower-casing.
PRETOKENS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lengths_by(tok):
    return lambda words: [len(e.ids) for e in tok.encode_batch_fast(words, add_special_tokens=False)]


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 1500, entries: int = 50_000) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about sample_docs texts (those with the least hashes; a task counts a repeated
    one once). The table only saves work: counts don't depend on what is in it. At most `entries` pre-tokens come to the driver."""

    def count(batches):
        import pyarrow as pa

        counted, seen = Counter(), set()
        for batch in batches:
            for hashes, texts in sliced([c.to_pylist() for c in batch.columns], 1):
                for h, t in zip(hashes, texts):
                    if h not in seen and is_plain(t):
                        counted.update(PRETOKENS.findall(t.lower()))
                    seen.add(h)
        top = counted.most_common(entries)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    share = sample_docs / max(docs.count(), 1)
    sample = docs.select(F.xxhash64("text").alias("h"), "text").filter(F.col("text").isNotNull() & (F.col("h") / F.lit(2.0**64) + 0.5 < share))
    best = sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    words = [r.word for r in best.collect()]
    return dict(zip(words, lengths_by(tokenizer(path))(words))) if words else {}


def token_counts(docs: DataFrame, path: str, max_tokens: int = 2048, sample_docs: int = 1500, entries: int = 50_000, cache_entries: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs, entries))

    def factory():
        tok = tokenizer(path)
        cache = PieceCache(lengths_by(tok), known.value, cache_entries)

        def run(columns):
            ids, texts = columns
            split, words = [], []
            for t in texts:
                split.append(PRETOKENS.findall(t.lower()) if t and is_plain(t) else None)
                words += split[-1] or ()
            cache.learn(words)
            n = [sum(map(cache.__getitem__, s)) if s is not None else len(tok.encode(t, add_special_tokens=False).ids) if t else 0 for s, t in zip(split, texts)]
            return {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > max_tokens for x in n]}

        return run

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", factory, 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
