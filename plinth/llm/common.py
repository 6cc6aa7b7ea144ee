"""Helpers shared by the corpus operators: table access, shared storage, row keys, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most characters of text that one slice of documents holds while Python works on it.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share. Only where none is set and all runs in
    one process is it a local one; a cluster without it is refused, as executors don't see each other's local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/plinth-shared"


#: Folders of the scopes that are open, innermost last.
SCOPES: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in shared storage, by the file system that it lies in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside goes to one folder, which is removed at the end: for work whose result has been written elsewhere by then."""
    SCOPES.append(f"{shared_dir(spark)}/plinth/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove(spark, SCOPES.pop())


def materialise(df: DataFrame, outside: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage for good:
    the files outlive any executor. outside: not in the innermost scope's folder, but in the one around it."""
    spark, around = df.sparkSession, SCOPES[:-1] if outside else SCOPES
    path = f"{around[-1] if around else f'{shared_dir(spark)}/plinth'}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(df: DataFrame | None) -> None:
    """Delete what materialise() wrote, once nothing will read it again."""
    if df is not None:
        remove(df.sparkSession, df.written_to)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Null-free join keys of a document: its id, and a hash of its text that tells apart rows whose ids clash."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("k_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k_text")]


def boxed(docs: DataFrame) -> DataFrame:
    """row: all of docs' columns in one struct, so that their names can't clash with ours; with doc_id, text and the keys."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *row_key(F.col("doc_id"), F.col("text")))


def unboxed(df: DataFrame, columns: list[str], text: Column | None = None) -> list[Column]:
    """The columns that boxed() put away, with another text where one is given."""
    return [text.alias(c) if text is not None and c == "text" else F.col("row").getField(c).alias(c) for c in columns]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the objects that stand for them are collected, which
    by itself may take longer than all steps do. Its listeners hold the query that ended last, which so is a small one."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def trim() -> None:
    """Give back to the system what Python has freed: workers stay after their tasks, and more of them than run at a time."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def trimmed(fn: Callable) -> Callable:
    """fn of one argument, with trim() at its end."""

    def run(pdf):
        try:
            return fn(pdf)
        finally:
            trim()

    return run


#: A key is frequent if one in so many rows has it; so at most so many keys are.
FREQUENT = 4096


def joined_by_count(rows: DataFrame, keyed: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """rows with the row of `keyed` that has their key, where there is one. keyed has one row a key and, in `times`, how many of the
    `total` rows have it. The frequent keys, at most FREQUENT, are broadcast, so their rows are not moved to one task; the others are shuffled."""
    frequent = F.col(times) * FREQUENT >= total
    hot = F.broadcast(keyed.filter(frequent))
    rest = rows.join(F.broadcast(keyed.filter(frequent).select(*on)), on, "left_anti").join(keyed.filter(~frequent), on)
    return rows.join(hot, on).unionByName(rest)


def shards(df: DataFrame) -> int:
    """How many ways keyed work is dealt out: the session's shuffle width, which the cluster's owner sizes to the data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sliced(columns: list[list], text_at: int, limit: int = SLICE_CHARS) -> Iterator[list[list]]:
    """Cut parallel lists into runs of rows whose texts have about `limit` characters together (one row at least)."""
    start, chars = 0, 0
    texts = columns[text_at]
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= limit:
            yield [c[start : i + 1] for c in columns]
            start, chars = i + 1, 0
    if start < len(texts):
        yield [c[start:] for c in columns]


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch by a few rows at a time, so that not all its texts become Python strings at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_slices(df: DataFrame, schema: str, fn_factory: Callable[[], Callable[[list[list]], dict[str, Iterable]]], text_at: int, limit: int = SLICE_CHARS) -> DataFrame:
    """mapInArrow over bounded slices of rows. fn_factory runs once in each task and returns fn(columns) -> columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = fn_factory()
        for batch in batches:
            for part in sliced([c.to_pylist() for c in batch.columns], text_at, limit):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Characters whose class (letter, digit, space, other), case and composition are the same in every Unicode library;
#: a text with any other is handed whole to the tokenizer library.
PLAIN = re.compile("[^\t\n\v\f\r\x20-\x7e\xa0-įı-ɏ‐-‧€]")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"


def is_plain(text: str) -> bool:
    """True if pre-tokenization by our own pattern gives what the library gives (and no special token can occur)."""
    return PLAIN.search(text) is None and "<|" not in text


class PieceCache(dict):
    """Pre-token -> encoding, on top of a fixed base. Beyond `most` entries it forgets those seen in one slice only."""

    def __init__(self, encode_all: Callable[[list[str]], list], base: dict | None = None, most: int = 400_000):
        super().__init__(base or {})
        self.base, self.encode_all, self.most, self.again = base or {}, encode_all, most, set()

    def learn(self, words: Iterable[str]) -> None:
        distinct = set(words)
        missing = [w for w in distinct if w not in self]
        if len(self) + len(missing) > self.most:
            kept = {w: self[w] for w in self.again} if 2 * len(self.again) < self.most else {}
            self.clear()
            self.again = set()
            self.update(self.base)
            self.update(kept)
            missing = [w for w in distinct if w not in self]
        else:
            self.again.update(distinct.difference(missing))
        if missing:
            self.update(zip(missing, self.encode_all(missing)))


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary as bytes. Such vocabularies write a printable byte as its own character and the
    others, in order, as the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token)}
