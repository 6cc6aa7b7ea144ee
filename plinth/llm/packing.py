"""Harmonic packing of documents into training sequences.

Each worker packs its own partition in one pass, with no shuffle. A document's ids are cut into whole sequences; of the
rest, pieces of half, a quarter, an eighth and a sixteenth of the capacity are cut while they fit, and what is left is one
last piece. A piece of length r is of class k = capacity // r, and each bin of class k takes exactly k pieces, so a full
bin never needs to be looked at again: halves go by two, quarters by four, short tails by k. The pieces in bins
that are still open when the partition ends (fewer than the classes' sizes together, whatever the input) are packed once
more, longest first, into the emptiest places.

Defined results: a null or empty text is the one closing id. Every row is packed, repeated rows too. Null ids stay null.
Only the id and text columns are read. An empty table gives no pieces. Sequence ids are unique, with the number of the
partition in the upper bits; a rerun of a lost task gives the same ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DIGITS, LETTERS, PieceCache, byte_ranks, is_plain, sliced, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

#: The byte-level pre-tokenizer's pattern for plain text.
PRETOKENS = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+")


class Encoder:
    """Texts -> little-endian unsigned 32-bit ids, through a bounded cache of pre-tokens. Single pre-tokens that the cache
    lacks go through the merge loop of tiktoken over the file's own vocabulary, which costs a fifth of the tokenizer's
    call; texts that our pattern can't split for certain go to the tokenizer whole."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = set(self.tok.get_added_tokens_decoder())
        ranks = byte_ranks({t: i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if i not in special})
        merge = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache = PieceCache(lambda words: [array("I", merge(w)).tobytes() for w in words], most=cache_entries)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split, words = [], []
        for t in texts:
            split.append(PRETOKENS.findall(t) if t and is_plain(t) else None)
            words += split[-1] or ()
        self.cache.learn(words)
        return [b"".join(map(self.cache.__getitem__, s)) if s is not None else np.array(self.tok.encode(t, add_special_tokens=False).ids if t else [], "<u4").tobytes() for s, t in zip(split, texts)]


def cuts(n: int, capacity: int, whole: bool = False) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document with n ids. whole: what fits one sequence is not cut further."""
    found, at = [(i * capacity, capacity, 1) for i in range(n // capacity)], n - n % capacity
    rest = n - at
    for k in () if whole else (2, 4, 8, 16):
        if rest >= (part := capacity // k) > 0:
            found.append((at, part, k))
            at, rest = at + part, rest - part
    if rest:
        found.append((at, rest, capacity // rest))
    return found


class Bins:
    """Open bins by class; full ones leave as rows."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open, self.rows = capacity, first_id, {}, []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((*p, self.next_id, offset))
            offset += p[2]
        self.next_id += 1

    def add(self, piece: tuple, k: int) -> None:
        if k == 1:
            self.close([piece])
            return
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self.close(self.open.pop(k))

    def finish(self) -> None:
        rest = sorted((p for x in self.open.values() for p in x), key=lambda p: -p[2])
        bins: list[list] = []
        room: list[int] = []
        for p in rest:
            at = next((i for i, r in enumerate(room) if r >= p[2]), None)
            if at is None:
                at = len(bins)
                bins.append([])
                room.append(self.capacity)
            bins[at].append(p)
            room[at] -= p[2]
        for x in bins:
            self.close(x)
        self.open = {}

    def take(self) -> pa.RecordBatch:
        columns, self.rows = list(zip(*self.rows)) or [[]] * len(NAMES), []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, cache_entries: int = 400_000, whole: bool = False) -> DataFrame:
    """One row for each piece of docs(doc_id, text), with the sequence and the offset it lies at. whole: the last piece of a document, or all of one that
    fits a sequence, stays in one piece, at the price of more padding (see the README)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bins, end = Encoder(path, cache_entries), Bins(capacity, TaskContext.get().partitionId() << 40), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for ids, texts in sliced([c.to_pylist() for c in batch.columns], 1):
                for doc_id, data in zip(ids, encode(texts)):
                    data += end
                    n = len(data) // 4
                    for start, length, k in cuts(n, capacity, whole):
                        bins.add((doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n), k)
                if bins.rows:
                    yield bins.take()
        bins.finish()
        yield bins.take()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
