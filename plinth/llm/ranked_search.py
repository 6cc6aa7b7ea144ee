"""Ranked lexical search with a two-level quantised index.

Index: each worker cuts its documents into chunks and leaves, for each term of a chunk, the documents that hold it, how often, and a byte of
impact: the term's share of a score, divided by a step and rounded up. The index covers all terms of all documents and is written, by chunk and term.

Search: the postings of the items' terms are brought together by chunk. In a chunk, an item's bytes times weights give every document an upper
bound (and, one step lower for each byte, a lower one). Every document whose upper bound reaches the k-th lower bound, or the k-th exact score that the
task has already seen for the item, is scored in whole numbers from its counts; no other can be among the k best. Tasks leave k rows an item at
most, of which the k best in all are ranked. Items are taken in blocks of bounded size; no pair of item and document leaves a chunk unless it is a result of its task.

Defined results: null texts and texts without terms are in no list and don't count in N. Equal scores go by ascending doc_id, null ids last.
Each row of the items is an item, repeated ids too (their rows repeat). Items without terms, or none of whose terms occurs, have no rows. Only doc_id,
item_id and text are read. Texts are read whole. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, sliced, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as bytes: breaks become spaces, A-Z lower case; bytes of other characters stay.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: A term's share of a score is below SCALE; a byte of impact counts steps of it.
SCALE = 1_000_000
STEP = -(-SCALE // 255)
CHUNK_CHARS, CHUNK_DOCS = 1 << 22, 16_384
#: Pairs of item and term that one block of items holds about.
BLOCK_PAIRS = 400_000

INDEX = "chunk long, term string, df int, docs binary, tf binary, impact binary, ids array<long>, lens array<long>"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + 25 * n * n_docs // n_terms


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term adds to a score for each unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and terms of all documents."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    r = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    return r.n_docs, r.n_terms or 0


def build(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """INDEX: a row for each chunk and term, and one for each chunk's documents (term ''); in a chunk rows are in order of terms."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def binary(data: np.ndarray, upto: np.ndarray) -> pa.Array:
        """Runs of data that end at upto, as binaries."""
        offsets = np.concatenate(([0], upto)).astype(np.int32) * data.itemsize
        return pa.Array.from_buffers(pa.binary(), len(upto), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    def rows(chunk: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        code: defaultdict = defaultdict()
        code.default_factory = code.__len__
        words = [terms_of(t) if t else [] for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        head = [[chunk], [""], [0], [None], [None], [None], [ids], [n.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(head, schema)], schema=schema)
        if not n.sum():
            return
        at = np.concatenate([np.fromiter(map(code.__getitem__, w), np.int64, len(w)) for w in words])
        key, tf = np.unique(at * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
        doc, upto = key % len(ids), np.cumsum(np.bincount(key // len(ids)))
        impact = -(-share(tf, length_factor(n, n_docs, n_terms)[doc]) // STEP)
        none = lambda kind: pa.nulls(len(code), kind)
        columns = [pa.array(np.full(len(code), chunk)), pa.array([w.decode("utf-8", "replace") for w in code], pa.string()), pa.array(np.diff(upto, prepend=0).astype(np.int32))]
        columns += [binary(doc.astype("<u2"), upto), binary(tf.astype("<u4"), upto), binary(impact.astype("u1"), upto), none(schema.field("ids").type), none(schema.field("lens").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in sliced([c.to_pylist() for c in batch.columns], 1, CHUNK_CHARS):
                for i in range(0, len(ids), CHUNK_DOCS):
                    yield from rows(chunk, ids[i : i + CHUNK_DOCS], texts[i : i + CHUNK_DOCS])
                    chunk += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, term, times."""
    folded = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    rows = items.select("item_id", F.monotonically_increasing_id().alias("item"), F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)).alias("terms"))
    return rows.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def search(index: DataFrame, items: DataFrame, n_docs: int, n_terms: int, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of the index."""
    pairs = materialise(item_terms(items))
    known = index.filter("term <> ''").join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    pairs = materialise(pairs.join(known, "term"))
    blocks = 1 + pairs.count() // BLOCK_PAIRS
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        part = best_of_block(index, pairs.filter(F.col("block") == block), n_docs, n_terms, k)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(pairs.select("item", "item_id").distinct()) if blocks == 1 else pairs.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def best_of_block(index: DataFrame, pairs: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task for each item of a block; the block's terms and weights are broadcast."""
    spark = index.sparkSession
    number: dict[str, int] = {}
    weights, asked = [], defaultdict(list)
    for r in pairs.select("item", "term", "times", "df").collect():
        if r.term not in number:
            number[r.term] = len(number)
            weights.append(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))))
        asked[r.item].append((number[r.term], r.times * weights[number[r.term]]))
    sent = spark.sparkContext.broadcast((number, dict(asked)))

    def best(old: list[tuple], new: list[tuple]) -> list[tuple]:
        return sorted(old + new, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

    def in_chunk(postings: dict, ids: list, n: np.ndarray, asked: dict, top: dict) -> None:
        m = length_factor(n, n_docs, n_terms)
        for item, terms in asked.items():
            held = [(postings[t], w) for t, w in terms if w and t in postings]
            if not held:
                continue
            upper, under = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for (docs, _, impact), w in held:
                upper[docs] += w * impact
                under[docs] += w * (impact > 0)
            own = top.get(item, ())
            floor = own[-1][0] if len(own) == k else 1
            if len(ids) > k:
                floor = max(floor, STEP * int(np.partition(upper - under, -k)[-k]))
            at = np.flatnonzero(STEP * upper >= floor)
            exact = np.zeros(len(at), np.int64)
            for (docs, tf, _), w in held:
                place = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
                hit = docs[place] == at
                exact[hit] += w * share(tf[place[hit]], m[at[hit]])
            top[item] = best(list(own), [(s, ids[i]) for s, i in zip(exact.tolist(), at.tolist()) if s > 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, asked = sent.value
        top: dict[int, list[tuple]] = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for _, own in groupby(rows(), key=lambda r: r[0]):
            _, _, _, _, _, ids, lens = next(own)
            postings = {number[r[1]]: (np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<u4").astype(np.int64), np.frombuffer(r[4], "u1").astype(np.int64)) for r in own}
            in_chunk(postings, ids, np.array(lens, np.int64), asked, top)
        out = [(item, doc, score) for item, rows in top.items() for score, doc in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    terms = pairs.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
    own = index.join(terms, "term", "left_semi").repartition("chunk").sortWithinPartitions("chunk", "term")
    return own.select("chunk", "term", "docs", "tf", "impact", "ids", "lens").mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index all of docs(doc_id, text) and search it for each row of items(item_id, text)."""
    n_docs, n_terms = totals(docs)
    if not n_docs:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return search(materialise(build(docs, n_docs, n_terms)), items, n_docs, n_terms, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 75 + (25 * len(w)::BIGINT * N) // L AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, N),
x AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20
"""
