"""Repeated 200-byte strings, by a logarithmic family of sparse suffix arrays.

Documents are taken in chunks of a few MB, and chunks in batches. Of each window of `length` bytes, the k-gram with the least hash is its
anchor, so equal windows have equal anchors wherever they lie, and a run of windows with one anchor is one segment, about
one in 90 bytes. A chunk's run is the sorted array of its anchors' suffixes. The order is that of 64-bit fingerprints of a prefix of fixed depth,
with a second fingerprint of the whole surrounding, as only equality at depth `length` matters and not which of two unequal suffixes is less.

Each shard holds a range of the fingerprints and a family of sorted levels. Each run of a new batch is merge-scanned with all levels there
are; matches are marked on both sides; then levels of like size merge, so that each entry is rewritten a logarithmic number of
times. After each batch the family of segments is a table in the shared folder, and the next batch meets it there. What is in doubt then is settled
in two more steps, on ever fewer strings and in families that live in the shards' tasks:

1. segments: one whose anchor is found once is done; one whose whole string is all there is at its anchor, several times, is
   covered; one whose anchor has several surroundings is opened up;
2. strips of at most 8 windows of opened segments, keyed by the bytes that all windows of the strip share: done, covered or opened likewise;
3. windows of opened strips, and of segments that hold their anchor twice, which settles every window exactly.

Equal strings of a chunk are one entry, so a passage in a third of all documents is one entry a chunk. Texts move as
compressed blobs of chunks; all else that is shuffled is fingerprints, and a byte for each in answer. A match takes two equal 64-bit fingerprints
of different strings (the key and its surrounding, or both halves of 128 bits), so that false ones are not to be expected at any size: among 10^13
strings, 10^26 / 2 pairs against 2^128.

Defined results: a null or empty text has 0 bytes and nothing removed. Strings are judged on the input; matches never cross
documents; overlapping ones in a document count. Equal rows are separate documents (each is found in the other). Only doc_id and text are
read. A document longer than a chunk is cut into pieces that overlap by length - 1 bytes on both sides; a window counts for the piece
it starts in. So memory doesn't grow with a document's length, but for its own bytes where its pieces are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, release, shards, table

#: Bytes of text in a chunk, and documents it has at most; length of the k-grams that anchor a window; windows in a strip; batches that the documents are dealt to.
CHUNK_BYTES, CHUNK_DOCS, GRAM, STRIP, BATCHES = 1_500_000, 50_000, 32, 8, 2
U = np.uint64
#: Odd multipliers of the mixing steps.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: What is known of a key: nothing that counts, one string, one string several times, several strings, an anchor that a segment holds twice.
NONE, ONCE, AGAIN, SEVERAL, TIED = range(5)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of strings of length 2 * step from those of length step."""
    x = h[:-step] * M1
    x += h[step:]
    x ^= x >> U(32)
    x *= M2
    return x


def least(h: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each `width` consecutive values, by running minima of blocks from both sides."""
    n = len(h)
    pad = -n % width
    fill = U(0xFFFFFFFFFFFFFFFF) if of is np.minimum else U(0)
    blocks = np.concatenate([h, np.full(pad, fill, U)]).reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).ravel()
    back = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[: n - width + 1], ahead[width - 1 : n])


class Segments:
    """The segments of a chunk, in order: first and last window, place of the anchor, its fingerprint, that of the whole string
    from the first window to the last, whether the anchor occurs twice in it, and whether its windows count here."""

    def __init__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, skip: np.ndarray, length: int):
        text = np.frombuffer(data, np.uint8)
        n, windows, width = len(text), len(text) - length + 1, length - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.place = empty
        self.key = self.print = empty.astype(U)
        self.tied = self.counts = empty.astype(bool)
        if windows < 1:
            return
        whole_step = 1 << (length.bit_length() - 1)
        h, step, grams = mixed(np.arange(1, 257, dtype=U) * M1)[text], 1, None
        while step < whole_step:
            h = doubled(h, step)
            step *= 2
            grams = h[: n - GRAM + 1] if step == GRAM else grams
        string = lambda at: mixed(h[at] * M1 + h[at + (length - whole_step)])  # noqa: E731  a window, by two overlapping blocks
        low = least(grams, width)[:windows]
        inside = np.zeros(n + 1, np.int32)  # texts are parted by one byte that belongs to none
        inside[starts + sizes + 1] = 1
        inside = np.cumsum(inside)
        whole = inside[length : length + windows] == inside[:windows]
        before = np.zeros(n + 1, np.int8)
        np.add.at(before, starts, 1)
        np.add.at(before, starts + skip, -1)
        counts = np.cumsum(before)[:windows] == 0
        change = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        first = np.unique(np.concatenate([change, np.flatnonzero((whole[1:] != whole[:-1]) | (counts[1:] != counts[:-1])) + 1]))
        last = np.concatenate([first[1:] - 1, [windows - 1]])
        # Places that are the least of some window; those of one value in a row belong to one run of equal minima.
        top = least(np.concatenate([np.zeros(width - 1, U), low, np.zeros(width - 1, U)]), width, np.maximum)
        spots = np.flatnonzero(grams[: len(top)] == top)
        value = grams[spots]
        group = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        run = np.searchsorted(change, first, side="right") - 1
        if len(group) == len(change):
            place, tied = spots[group][run], (np.diff(np.append(group, len(spots))) > 1)[run]
        else:
            place, tied = first, np.ones(len(first), bool)
        keep = whole[first]
        self.first, self.last, self.place, self.tied, self.counts = first[keep], last[keep], place[keep], tied[keep], counts[first[keep]]
        self.key = mixed(low[self.first])
        self.print = mixed(string(self.first) * M1 + mixed(string(self.last) + (self.last - self.first).astype(U) * M3))


def hashes(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """128 bits for each of these strings, as two columns."""
    from xxhash import xxh3_128_digest

    view = memoryview(data)
    return np.frombuffer(b"".join([xxh3_128_digest(view[a:b], seed) for a, b in zip(start.tolist(), end.tolist())]), "<u8").reshape(-1, 2).astype(U)


def entries(key: np.ndarray, prints: np.ndarray, counts: np.ndarray, tied: np.ndarray | None = None) -> tuple[tuple, np.ndarray]:
    """A sorted run (keys, prints, what is known), and the place of each string's key in it."""
    order = np.lexsort((prints, key))
    k, p = key[order], prints[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    place = np.zeros(len(k), np.int64)
    place[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1 if len(k) else 0
    n = np.minimum(np.bincount(place, counts, len(at)), AGAIN).astype(np.uint8)
    if len(at):
        n[p[at] != p[np.append(at[1:], len(k)) - 1]] = SEVERAL
        if tied is not None:
            n[place[tied]] = TIED
    return (k[at], p[at], n), place


class Levels:
    """A logarithmic family of sorted runs: keys, prints, and what is known of each key."""

    def __init__(self, runs: list[tuple] | None = None):
        self.runs = sorted(runs or [], key=lambda r: -len(r[0]))

    @staticmethod
    def scan(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge-scan of two runs: places in a and in b of the keys they share, and what both together know of them."""
        at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
        mine = np.flatnonzero(a[0][at] == b[0]) if len(a[0]) else np.zeros(0, np.int64)
        at = at[mine]
        x, y = a[2][at], b[2][mine]
        known = np.minimum(x + y, AGAIN)
        known = np.where((a[1][at] != b[1][mine]) | (np.maximum(x, y) >= SEVERAL), np.maximum(np.maximum(x, y), SEVERAL), known)
        return at, mine, known.astype(np.uint8)

    @staticmethod
    def merge(a: tuple, b: tuple) -> tuple:
        at, mine, known = Levels.scan(a, b)
        n = a[2].copy()
        n[at] = known
        fresh = np.ones(len(b[0]), bool)
        fresh[mine] = False
        keys = np.concatenate([a[0], b[0][fresh]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1][fresh]])[order], np.concatenate([n, b[2][fresh]])[order]

    def add(self, run: tuple) -> None:
        if not len(run[0]):
            return
        new = run[2].copy()
        for i, level in enumerate(self.runs):
            at, mine, known = self.scan(level, run)
            if (more := known >= AGAIN).any():
                n = level[2].copy()
                n[at[more]] = known[more]
                new[mine[more]] = np.maximum(new[mine[more]], known[more])
                self.runs[i] = (*level[:2], n)
        self.runs.append((*run[:2], new))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(self.merge(a, b))

    def known(self, keys: np.ndarray) -> np.ndarray:
        """The most that any level knows of each key."""
        out = np.zeros(len(keys), np.uint8)
        for k, _, n in self.runs:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            out = np.maximum(out, np.where(k[at] == keys, n[at], NONE))
        return out


CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("part", pa.int32()), ("cut", pa.bool_()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("skip", pa.int64()), ("own", pa.int64()), ("at", pa.int64()), ("whole", pa.int64()),
    ("blob", pa.binary()), ("plan", pa.binary()), ("keys", pa.binary()), ("prints", pa.binary()), ("n", pa.binary()),
])
CHUNKS_DDL = "chunk long, part int, cut boolean, ids array<long>, sizes array<long>, skip long, own long, at long, whole long, blob binary, plan binary, keys binary, prints binary, n binary"


EMPTY = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.uint8)


def packed_run(run: tuple) -> dict[str, bytes]:
    return {"keys": run[0].tobytes(), "prints": run[1].tobytes(), "n": run[2].tobytes()}


def unpacked_run(keys: bytes, prints: bytes, n: bytes) -> tuple:
    return np.frombuffer(keys, U), np.frombuffer(prints, U), np.frombuffer(n, np.uint8)


def planned(*columns: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(c, np.int32) for c in columns]).tobytes() if len(columns[0]) else b""


def read_plan(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data or b"", np.int32).reshape(width, -1).astype(np.int64)


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def chunked(docs: DataFrame, length: int, chunk_bytes: int, parts: int) -> DataFrame:
    """The documents as chunks, each with its segments and its run of them. A piece of a cut document is a chunk of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, number, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)

        def row(ids: list, texts: list[bytes], skip: int = 0, own: int = 0, at: int = 0, whole: int = -1):
            nonlocal number
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
            data = b"\0".join([*texts, b""])
            s = Segments(data, starts, sizes, np.full(len(texts), skip), length)
            found, place = entries(s.key, s.print, s.counts, s.tied)
            chunk, number = (task << 24) + number, number + 1
            return as_batch([{"chunk": chunk, "part": chunk % parts, "cut": whole >= 0, "ids": ids, "sizes": sizes.tolist(), "skip": skip, "own": own, "at": at, "whole": whole, "blob": press.compress(data), "plan": planned(s.first, s.last, s.place, place), **packed_run(found)}], CHUNKS)

        ids, texts, size, cut = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                if len(text) > 2 * chunk_bytes:
                    whole, cut = (task << 32) + cut, cut + 1
                    for at in range(0, len(text), chunk_bytes):
                        start, end = max(0, at - length + 1), min(len(text), at + chunk_bytes + length - 1)
                        yield row([doc_id], [text[start:end]], at - start, min(chunk_bytes, len(text) - at), at, whole)
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= chunk_bytes or len(ids) >= CHUNK_DOCS:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8")).mapInArrow(run, CHUNKS_DDL)


RUNS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("prints", pa.binary()), ("n", pa.binary())])
RUNS_DDL = "shard int, part int, chunk long, keys binary, prints binary, n binary"


def dealt(chunks: DataFrame, width: int) -> DataFrame:
    """The runs of chunks, cut by the ranges of the key that the shards hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // width for i in range(1, width)], U)
        for batch in batches:
            for row in batch.to_pylist():
                keys, prints, n = unpacked_run(row["keys"], row["prints"], row["n"])
                bounds = [0, *np.searchsorted(keys, edges), len(keys)]
                out = [{"shard": s, "part": row["part"], "chunk": row["chunk"], **packed_run((keys[a:b], prints[a:b], n[a:b]))} for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
                for i in range(0, len(out), 256):
                    yield as_batch(out[i : i + 256], RUNS)

    return chunks.select("chunk", "part", "keys", "prints", "n").mapInArrow(run, RUNS_DDL)


def runs_of(pdf: pd.DataFrame) -> Iterator[tuple]:
    for _, keys, prints, n in sorted(zip(pdf["chunk"], pdf["keys"], pdf["prints"], pdf["n"]), key=lambda x: x[0]):
        yield unpacked_run(keys, prints, n)


def added(runs: DataFrame, family: DataFrame | None) -> DataFrame:
    """The family after a batch: one row a level and shard. Its table is what the next batch is scanned against."""

    def add(levels: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        found = Levels(list(runs_of(levels)))
        for r in runs_of(new):
            found.add(r)
        shard = (new if len(new) else levels)["shard"].iloc[0]
        return pd.DataFrame([{"shard": shard, "chunk": i, **packed_run(r)} for i, r in enumerate(found.runs)], columns=["shard", "chunk", "keys", "prints", "n"])

    schema = "shard int, chunk long, keys binary, prints binary, n binary"
    if family is None:
        return runs.groupBy("shard").applyInPandas(lambda pdf: add(pdf.iloc[:0], pdf), schema)
    return family.groupBy("shard").cogroup(runs.groupBy("shard")).applyInPandas(add, schema)


def answers(runs: DataFrame, family: DataFrame | None, last: int) -> DataFrame:
    """The last batch is scanned against the family and joins it in memory; then each run's keys are looked up, and
    what is known of them comes back, a row for each chunk and shard."""

    def settle(levels: pd.DataFrame, all_runs: pd.DataFrame) -> pd.DataFrame:
        found = Levels(list(runs_of(levels)))
        for r in runs_of(all_runs[all_runs["part"] >= last]):
            found.add(r)
        out = [(shard, chunk, found.known(np.frombuffer(k, U)).tobytes()) for shard, chunk, k in zip(all_runs["shard"], all_runs["chunk"], all_runs["keys"])]
        return pd.DataFrame(out, columns=["shard", "chunk", "n"])

    schema = "shard int, chunk long, n binary"
    if family is None:
        return runs.groupBy("shard").applyInPandas(lambda pdf: settle(pdf.iloc[:0], pdf), schema)
    return family.groupBy("shard").cogroup(runs.groupBy("shard")).applyInPandas(settle, schema)


def settled(chunks: DataFrame, width: int, parts: int) -> DataFrame:
    """chunk, told: what the family knows of each chunk's keys after all batches, by shard."""
    runs, family = dealt(chunks, width), None
    for part in range(parts - 1):
        grown = materialise(added(runs.filter(F.col("part") == part), family))
        discard(family)
        family = grown
        release(chunks.sparkSession)
    found = answers(runs, family, parts - 1)
    told = materialise(found.groupBy("chunk").agg(F.collect_list(F.struct("shard", "n")).alias("told")))
    discard(family)
    del runs, found
    release(chunks.sparkSession)
    return told


def known_of(told: list[dict] | None) -> np.ndarray:
    return np.frombuffer(b"".join(x["n"] for x in sorted(told or [], key=lambda x: x["shard"])), np.uint8)


def text_of(row: dict) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=sum(row["sizes"]) + len(row["sizes"]))


def opened(segments: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strips of the segments whose anchors have several surroundings: first and last window, and where the bytes they share begin."""
    first, last, place, key = segments
    pick = np.flatnonzero(known[key] == SEVERAL)
    first, last, place = first[pick], last[pick], place[pick]
    low, count = (place - last) // STRIP, (place - first) // STRIP - (place - last) // STRIP + 1
    of = np.repeat(np.arange(len(pick)), count)
    strip = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    shared = place[of] - STRIP * strip
    return np.maximum(first[of], shared - STRIP + 1), np.minimum(last[of], shared), shared


STEPS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("plan", pa.binary()), ("marks", pa.binary()), ("tied", pa.binary()), ("keys", pa.binary()), ("prints", pa.binary()), ("n", pa.binary())])
STEPS_DDL = "chunk long, part int, plan binary, marks binary, tied binary, keys binary, prints binary, n binary"


def mapped(df: DataFrame, fn: Callable[[dict], list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = fn(batch.slice(i, 1).to_pylist()[0])
                for j in range(0, len(out), 1000):
                    yield as_batch(out[j : j + 1000], schema)

    return df.mapInArrow(run, ddl)


def edges_of(gone: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of covered bytes, as two rows."""
    return np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).T


def covered(row: dict, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a chunk the windows from first to last cover, with what the steps before have marked."""
    edge = np.zeros(sum(row["sizes"]) + len(row["sizes"]) + 1, np.int32)
    start, end = read_plan(row.get("marks"), 2)
    np.add.at(edge, np.concatenate([first, start]), 1)
    np.add.at(edge, np.concatenate([last + length, end]), -1)
    return np.cumsum(edge[:-1]) > 0


def strips(row: dict, length: int) -> list[dict]:
    """The second step of a chunk: what its segments cover, those whose windows are looked up one by one, and the run of the strips of the others."""
    plan, known = read_plan(row["plan"], 4), known_of(row["told"])
    state = known[plan[3]]
    marks = edges_of(covered(row, plan[0][state == AGAIN], plan[1][state == AGAIN], length))
    first, last, shared = opened(plan, known)
    found, place = EMPTY, first
    if len(first):
        data = text_of(row)
        found, place = entries(hashes(data, shared, shared + length - STRIP + 1)[:, 0], hashes(data, first, last + length, 1)[:, 0], first >= row["skip"])
    tied = planned(plan[0][state == TIED], plan[1][state == TIED])
    return [{"chunk": row["chunk"], "part": row["part"], "plan": planned(first, last, place), "marks": planned(*marks), "tied": tied, **packed_run(found)}]


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    count = last - first + 1
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def in_doubt(row: dict, length: int) -> tuple[np.ndarray, tuple, np.ndarray]:
    """The windows of a chunk that are looked up one by one, their run, and the place of each in it."""
    first, last, key = read_plan(row["plan"], 3)
    state = known_of(row["told"])[key] if len(key) else key
    at = np.unique(np.concatenate([spread(*read_plan(row["tied"], 2)), spread(first[state >= SEVERAL], last[state >= SEVERAL])]))
    if not len(at):
        return at, EMPTY, at
    h = hashes(text_of(row), at, at + length)
    return at, *entries(h[:, 0], h[:, 1], at >= row["skip"])


def windows(row: dict, length: int) -> list[dict]:
    """The third step: what the strips cover too, and the run of the windows of those that are open still."""
    first, last, key = read_plan(row["plan"], 3)
    state = known_of(row["told"])[key] if len(key) else key
    marks = edges_of(covered(row, first[state == AGAIN], last[state == AGAIN], length))
    return [{"chunk": row["chunk"], "part": row["part"], "plan": b"", "marks": planned(*marks), "tied": b"", **packed_run(in_doubt(row, length)[1])}]


def cover(row: dict, length: int) -> np.ndarray:
    """Which bytes of a chunk a repeated window covers. The windows in doubt are hashed again: that costs less than to keep their places."""
    at = np.zeros(0, np.int64)
    if row["plan"] is not None:
        at, _, place = in_doubt(row, length)
        at = at[known_of(row["told3"])[place] == AGAIN] if len(at) else at
    return covered(row, at, at, length)


OUT = pa.schema([("whole", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def cut(row: dict, length: int) -> list[dict]:
    data, gone = text_of(row), cover(row, length)
    text, out, start = np.frombuffer(data, np.uint8), [], 0
    for doc_id, size in zip(row["ids"], row["sizes"]):
        a, b = (start + row["skip"], start + row["skip"] + row["own"]) if row["cut"] else (start, start + size)
        mine = gone[a:b]
        if mine.any():
            spans = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2) + row["at"]
            out.append({"whole": row["whole"], "at": row["at"], "doc_id": doc_id, "n_bytes": b - a, "spans": [{"start": s, "end": e} for s, e in spans.tolist()], "kept": text[a:b][~mine].tobytes()})
        else:
            out.append({"whole": row["whole"], "at": row["at"], "doc_id": doc_id, "n_bytes": b - a, "spans": [], "kept": data[a:b]})
        start += size + 1
    return out


def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one cut document."""
    pdf = pdf.sort_values("at")
    spans: list[dict] = []
    for s in (s for x in pdf["spans"] for s in x):
        if spans and spans[-1]["end"] == s["start"]:
            spans[-1]["end"] = s["end"]
        else:
            spans.append({"start": s["start"], "end": s["end"]})
    return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1].astype("Int64").values, "n_bytes": [pdf["n_bytes"].sum()], "spans": [spans], "kept": [b"".join(pdf["kept"])]})


def repeats(docs: DataFrame, length: int = 200, chunk_bytes: int = CHUNK_BYTES, parts: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the maximal removed runs) and kept (the other bytes) for each row of docs."""
    width = shards(docs)
    chunks = materialise(chunked(docs, length, chunk_bytes, parts))
    spark, texts = docs.sparkSession, chunks.select("chunk", "part", "skip", "sizes", "blob")
    told = settled(chunks, width, parts)
    second = materialise(mapped(texts.join(chunks.select("chunk", "plan").join(told, "chunk"), "chunk"), lambda row: strips(row, length), STEPS, STEPS_DDL))
    discard(told)
    release(spark)
    told = settled(second, width, 1)
    step = materialise(second.select("chunk", "plan", "marks", "tied").join(told, "chunk", "left"))  # without the run, which has been answered
    discard(second)
    discard(told)
    third = materialise(mapped(texts.join(step, "chunk"), lambda row: windows(row, length), STEPS, STEPS_DDL))
    release(spark)
    told = settled(third, width, 1)
    marks = materialise(third.select("chunk", "marks").join(told.withColumnRenamed("told", "told3"), "chunk", "left"))
    discard(third)
    discard(told)
    release(spark)
    last = step.drop("marks").join(marks, "chunk")
    whole = chunks.drop("part", "plan", "keys", "prints", "n").join(last, "chunk", "left")
    ddl = f"whole long, at long, {RESULT}"
    out = lambda of_cut: mapped(whole.filter(F.col("cut") == of_cut), lambda row: cut(row, length), OUT, ddl)
    return out(False).select("doc_id", "n_bytes", "spans", "kept").unionByName(out(True).groupBy("whole").applyInPandas(put_together, RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
