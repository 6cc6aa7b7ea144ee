"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model. Trusted documents, all those labelled good, are split in two folds by a hash of their id; each fold trains a model, and every document, trusted
or not, is scored by the model of the other fold, which has not seen it; one model is made and asked after the other. Words are whole (no vocabulary is cut off),
known by 32-bit hashes, frequent ones by short codes, with two start marks and an end mark. Trigrams are counted in shards by their middle word, those of a heavy word
(one with more than 1 / width of all) in several by the first word too. A bigram's and a word's lower-order counts are numbers of distinct words before them; shards
ask each other for those of words and of heavy words' bigrams in keyed sums, so no vocabulary passes the driver. Each order has its three discounts, from its
numbers of n-grams seen 1 to 4 times. The lowest order backs off to the uniform distribution over the model's words and one unknown word.

Scoring. An interpolated model is a back-off model, so the log-probability of a text is a sum of independent terms: a base for each token, and for each of its
words, bigrams and trigrams that the model knows a gain (the log-probability it adds, or the back-off weight it stands for as a history).
So texts meet the model in joins of counts with gains, in the shards that hold the model. The most frequent n-grams' gains, at most `head`, are broadcast. The
others are asked for: a chunk of documents sends each shard its distinct n-grams there, if a bitmap of fixed size doesn't tell that
the model lacks them, each with the documents it occurs in; the shard sends back one vector of sums a chunk. Keys are 48-bit hashes in their shard's range,
and an n-gram that is everywhere comes once a chunk. Only trusted texts are shuffled. A fold's documents ask in `TURNS` turns, so that one turn's questions lie on disk at a time.

Verdicts. Documents are rejected whose log-perplexity is over the fence of their language: the `good` quantile of that language's documents
labelled good. It is drawn towards that of all languages as if `prior_docs` documents more had it, so small languages have no rule of their own. A
document of n words is judged by its distance from the language's median of all documents, times sqrt(n / (n + spread)), as the scatter of a mean is wider for a few words.

No sample: models, medians and fences come from all rows; rows repeated with one id and text train once.
Defined results: documents with no words have null perplexity and are rejected. Null languages form one group. Each row gives one
row, repeated rows too. With no trusted document every document with words is kept; where one fold has none, its documents are scored by their own
fold's model. Whole texts are scored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, discard, map_slices, materialise, pieces, release, row_key, scope, shards, table, trim, trimmed, unboxed

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Gains are whole numbers of this unit, so sums don't depend on their order.
UNIT = 1 << 16
#: Hashes of the start and end marks; words' hashes are from MARKS on.
START, END, MARKS = 0, 1, 2
#: Frequent words have codes below this instead of hashes, so that packed n-grams are short.
CODES = 1 << 16
#: Documents a chunk has at most (16 bits), and characters after which it is closed; bits of a key; bits and blocks of the bitmap.
CHUNK_DOCS, CHUNK_CHARS, KEY_BITS, MAP_BITS, MAP_BLOCKS = 60_000, 6_000_000, 48, 1 << 27, 1 << 12
#: Turns in which the documents of a fold are scored.
TURNS = 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def powers(p: int) -> np.ndarray:
    return np.cumprod(np.append(U(1), np.full(SPAN - 1, p, U)), dtype=U)


#: Words' hashes are sums of bytes times powers, so those of a run of SPAN bytes are differences of running sums. A longer word is hashed by itself.
SPAN = 1 << 15
POWER, INVERSE = powers(int(M1)), powers(pow(int(M1), -1, 1 << 64))
#: White space as str.split() knows it: what a byte is (1: white space, 2: perhaps the first of a longer character), and the longer ones by length.
WIDE = {n: np.array([int.from_bytes(x, "big") for c in range(128, 1 << 16) if chr(c).isspace() and len(x := chr(c).encode()) == n], np.uint32) for n in (2, 3)}
KIND_OF_BYTE = bytes(1 if i < 128 and chr(i).isspace() else 2 * (i in {int(x) >> 8 * (n - 1) for n, some in WIDE.items() for x in some}) for i in range(256))


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes of whole UTF-8 texts are white space."""
    kind = np.frombuffer(data.tobytes().translate(KIND_OF_BYTE), np.uint8)
    out = kind == 1
    at = np.flatnonzero(kind == 2)
    code = data[at].astype(np.uint32)
    for n, some in WIDE.items():
        code = (code << 8) | data[np.minimum(at + n - 1, len(data) - 1)]
        found = at[np.isin(code, some)]
        for i in range(n):
            out[found + i] = True
    return out


class Words:
    """Texts -> 32-bit hashes of their words, or codes of those that have one."""

    def __init__(self, codes: dict[int, int] | None = None):
        # A code has its place by its word's hash; of two with one place, the more frequent word has it.
        h, code = (np.array(list(x), np.uint32)[::-1] for x in ((codes or {}).keys(), (codes or {}).values()))
        self.hashes, self.codes = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.uint32)
        self.hashes[h >> 12], self.codes[h >> 12] = h, code

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or ends[0] == ends[-1]:
            return [np.zeros(0, np.uint32)] * len(texts)
        data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        gap, edge = white(data), np.zeros(len(data) + 1, bool)
        edge[ends] = True
        begin = np.flatnonzero(~gap & (edge[:-1] | np.append(True, gap[:-1])))
        end = np.flatnonzero(~gap & (edge[1:] | np.append(gap[1:], True))) + 1
        h = self.coded(self.hashed(data, begin, end))
        return [h[a:b] for a, b in itertools.pairwise(np.searchsorted(begin, ends).tolist())]

    def hashed(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        out, i = np.empty(len(begin), U), 0
        while i < len(begin):
            first = begin[i]
            j = int(np.searchsorted(end, first + SPAN, "right"))
            if j == i:
                out[i] = xxh3_64_intdigest(data[first : end[i]].tobytes())
                j += 1
            else:
                x = (data[first : end[j - 1]].astype(U) + U(1)) * POWER[: end[j - 1] - first]
                upto, a = np.cumsum(x), begin[i:j] - first
                out[i:j] = (upto[end[i:j] - first - 1] - upto[a] + x[a]) * INVERSE[a]
            i = j
        return (U(CODES) + ((mixed(out) >> U(32)) * U(2**32 - CODES) >> U(32))).astype(np.uint32)

    def coded(self, h: np.ndarray) -> np.ndarray:
        place = h >> 12
        return np.where(self.hashes[place] == h, self.codes[place], h)


def marked(words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.array([START, START], np.uint32), words, np.array([END], np.uint32)])


#: Families of keys: a word and what it leaves as a history; a bigram; a pair as a history; a trigram.
WORD, BIGRAM, HISTORY, TRIGRAM = 1, 2, 3, 4


def key(shard: np.ndarray, width: int, family: int, *words: np.ndarray) -> np.ndarray:
    """48-bit keys of n-grams, in the range of keys of their shard."""
    x = np.full(len(shard), family, U)
    for w in words:
        x = mixed(x * M1 + w.astype(U))
    return (shard.astype(U) << U(KEY_BITS)) // U(width) + (x >> U(64 - KEY_BITS)) % U((1 << KEY_BITS) // width)


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Documents labelled good: all, or where a caller wants at most about `most`, so many by the hash of the id."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if most is None:
        return good
    share = most / max(good.count(), 1)
    return good.filter(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < share) if share < 1 else good


def fold() -> F.Column:
    """0 or 1; not the bits that trusted_ids chooses by."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)), F.lit(0)).cast("int")


def turn() -> F.Column:
    """0 to TURNS - 1; not the bit of fold()."""
    return F.coalesce(F.pmod(F.shiftright(F.crc32(F.col("doc_id").cast("string")), 1), F.lit(TURNS)), F.lit(0)).cast("int")


def packed(x: np.ndarray) -> bytes:
    """Numbers in planes of bytes (the high ones are nearly all alike), compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def key_of_id(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.int64).view(U) * M1) >> U(64 - KEY_BITS)


def with_text(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text")


def likely_rows(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of with_text() whose id the bitmap of chosen ids has: all chosen ones, and few others."""
    for batch in batches:
        yield batch.filter(pa.array(has(bits, key_of_id(batch.column(0).to_numpy(zero_copy_only=False)))))


def likely(docs: DataFrame, bits_b) -> DataFrame:
    """doc_id, text of likely_rows()."""
    return with_text(docs).mapInArrow(lambda batches: likely_rows(batches, bits_b.value), "doc_id long, text string")


def batches_of_words(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[list[np.ndarray]]:
    """Marked words of the texts in the last column, about CHUNK_CHARS characters at a time."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch):
            texts = part.column(part.num_columns - 1)
            for found, chars in zip(words(texts), pc.utf8_length(texts).to_pylist()):
                held.append(marked(found))
                size += chars
                if size > CHUNK_CHARS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


class Layout:
    """Codes of frequent words, and how many shards share a word's trigrams where one would get too many. No result depends on it."""

    def __init__(self, width: int, rows: list):
        total = sum(r.n for r in rows if r.word < 0)
        found = sorted((r for r in rows if r.word >= 0), key=lambda r: (-r.n, r.word))[: CODES - MARKS]
        #: Ways in which the shards' questions to each other are dealt: each of them sends a row to each way.
        self.ways = min(width, math.ceil(4 * math.sqrt(width)))
        self.width, self.codes = width, {r.word: MARKS + i for i, r in enumerate(found)}
        parts = [min(width, math.ceil(r.n * width / total)) for r in found if r.n * width > total]
        self.heavy, self.parts = np.arange(MARKS, MARKS + len(parts), dtype=np.uint32), np.array(parts, U)

    def shard(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The shard of trigrams: by their middle word, those of a heavy one dealt to several by the first word."""
        heavy, out = self.is_heavy(v), self.base(v)
        out[heavy] += (mixed(u[heavy].astype(U) * M1 + U(7)) % self.parts[v[heavy].astype(np.int64) - MARKS]).astype(np.int64)
        return out % self.width

    def base(self, v: np.ndarray) -> np.ndarray:
        return (mixed(v.astype(U) + U(1)) % U(self.width)).astype(np.int64)

    def is_heavy(self, v: np.ndarray) -> np.ndarray:
        return (v >= MARKS) & (v < MARKS + len(self.heavy))


def layout(docs: DataFrame, bits_b, width: int) -> Layout:
    """From the whole texts of likely_rows(): words that have 1 / 50,000 of a run of texts or more, counted over the runs where they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of_words(likely_rows(batches, bits_b.value), Words()):
            word, n = np.unique(np.concatenate(held), return_counts=True)
            some = (n * 50_000 >= n.sum()) & (n > 1) & (word >= CODES)
            yield pa.RecordBatch.from_pydict({"word": np.append(word[some].astype(np.int64), -1), "n": np.append(n[some], n.sum()).astype(np.int64)})
        trim()

    counts = with_text(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Layout(width, counts.orderBy(F.col("word") >= 0, F.desc("n"), "word").limit(CODES).collect())


TRIGRAMS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("u", pa.binary()), ("v", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])
TRIGRAMS_DDL = "shard int, kind int, u binary, v binary, w binary, n binary"
#: Kinds of rows: trigrams; what a shard is told of bigrams of heavy words and of words that it asked for; those of which it tells the others;
#: what chunks ask, and what their documents are.
COUNTS, PAIRS, WORDS, OWN_PAIRS, OWN_WORDS, QUERY, META = range(7)


def counted(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct trigrams by (v, w, u), and their counts."""
    vw = (v.astype(U) << U(32)) | w
    order = np.lexsort((u, vw))
    u, vw = u[order], vw[order]
    at = np.flatnonzero(changes(u, vw))
    total = np.add.reduceat(np.ones(len(u), np.int64) if n is None else n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return u[at], (vw[at] >> U(32)).astype(np.uint32), vw[at].astype(np.uint32), total


def as_blobs(u, v, w, n) -> dict[str, bytes]:
    step = np.diff(v.astype("<u4"), prepend=np.uint32(0))
    return {"kind": COUNTS, "u": packed(u.astype("<u4")), "v": packed(step), "w": packed(np.where(step == 0, np.diff(w, prepend=np.uint32(0)), w).astype("<u4")), "n": packed(n.astype("<u4"))}


def from_blobs(row) -> tuple[np.ndarray, ...]:
    u, step, w, n = (unpacked(row[c], "<u4") for c in ("u", "v", "w", "n"))
    # w is a difference where v stays, and begins anew where v changes.
    run = np.flatnonzero(step != 0) if len(step) else np.zeros(0, np.int64)
    run = run if len(run) and run[0] == 0 else np.append(0, run)
    ends = np.cumsum(w, dtype=np.uint32)
    before = np.append(np.uint32(0), ends)[run]
    return u, np.cumsum(step, dtype=np.uint32), (ends - np.repeat(before, np.diff(np.append(run, len(w))))).astype(np.uint32), n


def trigrams(trusted: DataFrame, plan: Layout) -> DataFrame:
    """One row a shard: its distinct trigrams and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in batches_of_words(batches, Words(plan.codes)):
            parts = [[t[i : len(t) - 2 + i] for t in texts] for i in range(3)]
            u, v, w, n = counted(*(np.concatenate(p) for p in parts))
            shard = plan.shard(u, v)
            order = np.argsort(shard, kind="stable")
            u, v, w, n = u[order], v[order], w[order], n[order]
            for s, (a, b) in enumerate(itertools.pairwise(np.searchsorted(shard[order], np.arange(plan.width + 1)))):
                if a < b:
                    yield pa.RecordBatch.from_pylist([{"shard": s, **as_blobs(u[a:b], v[a:b], w[a:b], n[a:b])}], TRIGRAMS)
            del parts, u, v, w, n, shard, order
            trim()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [from_blobs(r) for _, r in pdf.iterrows()]
        u, v, w, n = counted(*(np.concatenate(c) for c in zip(*parts)))
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0], **as_blobs(u, v, w, n)}])

    return trusted.select("text").mapInArrow(run, TRIGRAMS_DDL).groupBy("shard").applyInPandas(trimmed(add), TRIGRAMS_DDL)


def of_runs(new: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts of the runs that `new` begins, and the columns there."""
    at = np.flatnonzero(new)
    return (at, *(c[at] for c in columns))


def changes(*columns: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.zeros(0, bool)


def bigrams(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of trigrams sorted by (v, w): distinct bigrams, and how many distinct words come before each."""
    at, bv, bw = of_runs(changes(v, w), v, w)
    return bv, bw, np.diff(np.append(at, len(v)))


def histories(new: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n-grams sorted by history: each one's history's total count, and the share that it leaves to the lower order."""
    at = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    total = np.add.reduceat(n, at)
    left = np.add.reduceat(d[np.minimum(n, 3)], at)
    return total[of].astype(float), (left / total)[of]


def discounts(of: np.ndarray) -> np.ndarray:
    """D0 to D3+ of an order, from how many of its n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (float(max(x, 1)) for x in of)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


ASKS = pa.schema([("at", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
ASKS_DDL = "at int, shard int, keys binary, n binary"


def asks(shard: int, keys: np.ndarray, n: np.ndarray, ways: int) -> Iterator[pa.RecordBatch]:
    """What a shard knows of sorted distinct keys, dealt by key."""
    at = (mixed(keys * M1 + U(3)) % U(ways)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    keys, n = keys[order], n[order]
    rows = [{"at": i, "shard": shard, "keys": squeeze(keys[a:b]), "n": packed(n[a:b].astype("<u4"))} for i, (a, b) in enumerate(itertools.pairwise(np.searchsorted(at[order], np.arange(ways + 1)))) if a < b]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ASKS)


def answers(asked: DataFrame, kind: int, own_kind: int, home: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Sums over all shards, keys in u and sums in n: in rows of `kind` for each shard what it asked, in rows of `own_kind` each key once, for its home."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [expand(k) for k in pdf["keys"]]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(at, np.concatenate([unpacked(x, "<u4") for x in pdf["n"]]), len(keys)).astype("<u4")
        ends = np.cumsum([len(k) for k in asked])
        rows = [(s, kind, k, packed(sums[at[e - len(o) : e]])) for s, k, o, e in zip(pdf["shard"], pdf["keys"], asked, ends)]
        homes = home(keys)
        order = np.argsort(homes, kind="stable")
        bounds = np.append(np.flatnonzero(changes(homes[order])), len(keys))
        rows += [(int(homes[order[a]]), own_kind, squeeze(keys[order[a:b]]), packed(sums[order[a:b]])) for a, b in itertools.pairwise(bounds)]
        return pd.DataFrame([(s, k, x, b"", b"", n) for s, k, x, n in rows], columns=TRIGRAMS.names)

    return asked.groupBy("at").applyInPandas(trimmed(run), TRIGRAMS_DDL)


def told(rows: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and sums of all answers of a kind to a shard."""
    rows = rows[rows["kind"] == kind]
    if not len(rows):
        return np.zeros(0, U), np.zeros(0, np.int64)
    keys = np.concatenate([expand(x) for x in rows["u"]])
    order = np.argsort(keys)
    return keys[order], np.concatenate([unpacked(x, "<u4") for x in rows["n"]])[order].astype(np.int64)


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (v.astype(U) << U(32)) | w


def unpair(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> U(32)).astype(np.uint32), keys.astype(np.uint32)


def ask_pairs(model: DataFrame, plan: Layout) -> DataFrame:
    """Bigrams of heavy words, which lie in several shards: how many distinct words before them each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bv, bw, c2 = bigrams(*from_blobs(row)[1:3])
                some = plan.is_heavy(bv)
                yield from asks(row["shard"], pair(bv, bw)[some], c2[some], plan.ways)

    def home(keys: np.ndarray) -> np.ndarray:
        v, w = unpair(keys)
        return plan.shard(w, v)

    return answers(model.mapInArrow(run, ASKS_DDL), PAIRS, OWN_PAIRS, home)


def ask_words(model: DataFrame, pairs: DataFrame, plan: Layout) -> DataFrame:
    """Words: how many distinct words come before them. A heavy word's bigram counts at its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == COUNTS:
                    bv, bw, _ = bigrams(*from_blobs(row)[1:3])
                    words, at = np.unique(bw, return_inverse=True)
                    yield from asks(row["shard"], words.astype(U), np.bincount(at, ~plan.is_heavy(bv), len(words)), plan.ways)
                else:
                    words, n = np.unique(unpair(expand(row["u"]))[1], return_counts=True)
                    yield from asks(row["shard"], words.astype(U), n, plan.ways)

    return answers(model.unionByName(pairs.filter(F.col("kind") == OWN_PAIRS)).mapInArrow(run, ASKS_DDL), WORDS, OWN_WORDS, plan.base)


def statistics(model: DataFrame, plan: Layout) -> dict:
    """Discounts of each order, the number of words and the sum of the distinct words before them, and of
    each heavy word the sum of its bigrams' counts and what it leaves (`width` words at most: a heavy one has more than 1 / width of all)."""

    def of(n: np.ndarray) -> np.ndarray:
        return np.array([(n == i).sum() for i in (1, 2, 3, 4)] + [len(n), n.sum()], np.int64)

    names = [f"n{i}" for i in range(6)]
    schema = pa.schema([("what", pa.int32()), ("v", pa.int64()), *((c, pa.int64()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == COUNTS:
                    _, v, w, n = from_blobs(row)
                    bv, _, c2 = bigrams(v, w)
                    out += [(3, 0, of(n)), (2, 0, of(c2[~plan.is_heavy(bv)]))]
                    continue
                n = unpacked(row["n"], "<u4").astype(np.int64)
                out.append((2 if row["kind"] == OWN_PAIRS else 1, 0, of(n)))
                if row["kind"] == OWN_PAIRS:
                    v = unpair(expand(row["u"]))[0]
                    out += [(0, int(x), of(n[v == x])) for x in np.unique(v)]
            if out:
                yield pa.RecordBatch.from_pylist([{"what": k, "v": v, **dict(zip(names, x.tolist()))} for k, v, x in out], schema)

    each = model.filter(F.col("kind").isin(COUNTS, OWN_PAIRS, OWN_WORDS)).mapInArrow(run, "what int, v long, " + ", ".join(f"{c} long" for c in names))
    own = {(r.what, r.v): [r[c] for c in names] for r in each.groupBy("what", "v").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    d1, d2, d3 = (discounts(own.get((i, 0), [0] * 6)[:4]) for i in (1, 2, 3))
    left = lambda d, n: d[1] * n[0] + d[2] * n[1] + d[3] * (n[4] - n[0] - n[1])
    words = own.get((1, 0), [0] * 6)
    total = max(words[5], 1)
    # The lowest order backs off to the uniform distribution over the words and one unknown word.
    uniform = left(d1, words) / total / (words[4] + 1)
    return {"d1": d1, "d2": d2, "d3": d3, "words": words[4], "total": total, "uniform": uniform, "unknown": math.log(max(uniform, 1e-12)), "heavy": {v: (n[5], left(d2, n)) for (what, v), n in own.items() if what == 0}}


def frequencies(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Counts of words, bigrams, pairs as histories and trigrams, for trigrams sorted by (v, w, u)."""
    n = n.astype(np.int64)
    order = np.argsort(pair(v, u))
    return [np.add.reduceat(x, np.flatnonzero(new)) for x, new in ((n, changes(v)), (n, changes(v, w)), (n[order], changes(v[order], u[order])))] + [n]


def gains(rows: pd.DataFrame, shard: int, m: dict, plan: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, gains in UNITs and counts of all that a shard tells of."""
    width, out = plan.width, []
    here = lambda x: np.full(len(x), shard)
    words, before = told(rows, OWN_WORDS)
    log = lambda n: np.log((n - m["d1"][np.minimum(n, 3)]) / m["total"] + m["uniform"])
    out.append((key(here(words), width, WORD, words), log(before) - m["unknown"], before))
    for v, (total, left) in m["heavy"].items():
        if plan.base(np.array([v]))[0] == shard:
            out.append((key(np.array([shard]), width, WORD, np.array([v])), np.log([left / total]), np.array([total])))
    asked, n1 = told(rows, WORDS)
    log1 = log(n1)

    def second(v, w, c2, total2, left2):
        """p(w | v), and the bigram's gain."""
        low = log1[np.searchsorted(asked, w.astype(U))]
        p2 = (c2 - m["d2"][np.minimum(c2, 3)]) / total2 + left2 * np.exp(low)
        return p2, np.log(p2) - np.log(left2) - low

    def of_heavy(v):
        x = np.array([m["heavy"][i] for i in v.tolist()], float).reshape(-1, 2)
        return x[:, 0], x[:, 1] / x[:, 0]

    keys, c2 = told(rows, OWN_PAIRS)
    if len(keys):
        v, w = unpair(keys)
        out.append((key(here(v), width, BIGRAM, v, w), second(v, w, c2, *of_heavy(v))[1], c2))
    for _, row in rows[rows["kind"] == COUNTS].iterrows():
        u, v, w, n = from_blobs(row)
        of_word, of_bigram = (np.add.reduceat(n.astype(np.int64), np.flatnonzero(new)) for new in (changes(v), changes(v, w)))
        bv, bw, c2 = bigrams(v, w)
        heavy = plan.is_heavy(bv)
        keys, sums = told(rows, PAIRS)
        c2[heavy] = sums[np.searchsorted(keys, pair(bv, bw)[heavy])]
        new_v = changes(bv)
        total2, left2 = histories(new_v, c2, m["d2"])
        total2[heavy], left2[heavy] = of_heavy(bv[heavy])
        p2, x2 = second(bv, bw, c2, total2, left2)
        out.append((key(here(bv[~heavy]), width, BIGRAM, bv[~heavy], bw[~heavy]), x2[~heavy], of_bigram[~heavy]))
        hv = np.flatnonzero(new_v)
        light = ~heavy[hv]
        out.append((key(here(hv[light]), width, WORD, bv[hv[light]]), np.log(left2[hv[light]]), of_word[light]))
        p2 = p2[np.cumsum(changes(v, w)) - 1]  # each trigram's bigram
        order = np.argsort(pair(v, u))
        u, v, w, n, p2 = u[order], v[order], w[order], n[order].astype(np.int64), p2[order]
        new_uv = changes(v, u)
        total3, left3 = histories(new_uv, n, m["d3"])
        p3 = (n - m["d3"][np.minimum(n, 3)]) / total3 + left3 * p2
        huv = np.flatnonzero(new_uv)
        out.append((key(here(huv), width, HISTORY, u[huv], v[huv]), np.log(left3[huv]), np.add.reduceat(n, huv)))
        out.append((key(here(u), width, TRIGRAM, u, v, w), np.log(p3) - np.log(left3) - np.log(p2), n))
    # A word tells of itself and of what it leaves as a history: the two add up under one key.
    keys, gain, times = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(changes(keys))
    return keys[at], np.rint(np.add.reduceat(gain[order], at) * UNIT).astype("<i4"), np.maximum.reduceat(times[order], at)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys, prepend=U(0)).astype("<u8"))


def expand(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=U)


def shard_of(width: int) -> np.ndarray:
    """The first key of each shard but the first."""
    return np.array([(i << KEY_BITS) // width for i in range(1, width)], U)


PARTS = pa.schema([("chunk", pa.int64()), ("size", pa.int32()), *TRIGRAMS])
PARTS_DDL = "chunk long, size int, " + TRIGRAMS_DDL


def blocks(keys: np.ndarray, held: dict[int, np.ndarray]) -> None:
    """Set the keys' bits in the blocks of the bitmap that they touch, MAP_BLOCKS in all by the first bits of a key."""
    at = places(keys)
    block, low = at[0] // (MAP_BITS // MAP_BLOCKS), at % (MAP_BITS // MAP_BLOCKS)
    order = np.argsort(block, kind="stable")
    bounds = np.append(np.flatnonzero(changes(block[order])), len(keys))
    for a, b in itertools.pairwise(bounds):
        spot = low[:, order[a:b]].ravel()
        np.bitwise_or.at(held.setdefault(int(block[order[a]]), np.zeros(MAP_BITS // MAP_BLOCKS // 8, np.uint8)), spot >> 3, (128 >> (spot & 7)).astype(np.uint8))


def whole_map(rows: pa.Table) -> np.ndarray:
    """The bitmap of blocks in rows (part, bits); other rows have a part below 0."""
    out = np.zeros((MAP_BLOCKS, MAP_BITS // MAP_BLOCKS // 8), np.uint8)
    for batch in rows.to_batches():
        for part, bits in zip(batch["part"].to_pylist(), batch["bits"]):
            if part >= 0:
                out[part] |= np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def map_of_ids(ids: DataFrame) -> np.ndarray:
    """The bitmap of all ids in rows."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            blocks(key_of_id(batch.column(0).to_numpy(zero_copy_only=False)), held)
        if held:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int64()), "bits": [x.tobytes() for x in held.values()]})

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in some]).tobytes()) for p, some in pdf.groupby("part")["bits"]]
        return pd.DataFrame(rows, columns=["part", "bits"])

    return whole_map(ids.coalesce(8).mapInArrow(bits, "part long, bits binary").groupBy(F.col("part") % 64).applyInPandas(both, "part long, bits binary").toArrow())


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = places(keys)
    return np.all((bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1, axis=0)


def head_and_map(model: DataFrame, fit, head: int, plan: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and gains of about the `head` most frequent entries, and the bitmap of all keys."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, of = np.unique(np.minimum(np.concatenate(frequencies(*from_blobs(row))), 1 << 20), return_counts=True)
                yield pa.RecordBatch.from_pydict({"n": n.astype(np.int64), "of": of})

    least, total = 1 << 62, 0
    for r in model.filter(F.col("kind") == COUNTS).mapInArrow(times, "n long, of long").groupBy("n").agg(F.sum("of").alias("of")).orderBy(F.desc("n")).collect():
        total += r.of
        if total > head:
            break
        least = r.n

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, gain, n = gains(pdf, int(pdf["shard"].iloc[0]), fit.value, plan)
        some, held = n >= least, {}
        blocks(keys, held)
        return pd.DataFrame([(-1, squeeze(keys[some]), packed(gain[some])), *((p, x.tobytes(), b"") for p, x in held.items())], columns=["part", "bits", "gain"])

    rows = model.groupBy("shard").applyInPandas(trimmed(tell), "part long, bits binary, gain binary").toArrow()
    first = rows.filter(pc.field("part") < 0)
    keys, gain = (np.concatenate(x) for x in zip(*((expand(k), unpacked(g, "<i4")) for k, g in zip(first["bits"].to_pylist(), first["gain"].to_pylist()))))
    order = np.argsort(keys)
    return keys[order], gain[order], whole_map(rows)


def places(keys: np.ndarray) -> np.ndarray:
    """Two places of each key in the bitmap, in the block of its first bits."""
    size = MAP_BITS // MAP_BLOCKS
    x, base = mixed(keys * M1), (keys * U(MAP_BLOCKS) >> U(KEY_BITS)) * U(size)
    return np.stack([base + (x & U(size - 1)), base + ((x >> U(32)) & U(size - 1))]).astype(np.int64)


class Chunk:
    """The n-grams of a run of documents: what the head knows is added up here, the rest is dealt out to shards."""

    def __init__(self, number: int, plan: Layout, head: tuple):
        self.number, self.plan, self.head = number, plan, head
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def add(self, words: np.ndarray, chars: int) -> None:
        self.texts.append(words)
        self.chars += chars

    def full(self) -> bool:
        return len(self.texts) >= CHUNK_DOCS or self.chars >= CHUNK_CHARS

    def scored(self) -> tuple[np.ndarray, Iterator[tuple]]:
        """Sums of the head's gains by document, and the parts for the shards."""
        head_keys, head_gain, bits = self.head
        size = np.array([len(t) for t in self.texts])
        sums, found = np.zeros(len(size)), []
        for keys, docs in self.families(size):
            keys <<= U(16)
            keys |= docs
            keys.sort()
            d = keys.astype(np.uint16)
            keys >>= U(16)
            begin = np.flatnonzero(changes(keys))
            unique, count = keys[begin], np.diff(np.append(begin, len(keys))).astype(np.uint32)
            del keys, docs, begin
            place = np.minimum(np.searchsorted(head_keys, unique), max(len(head_keys) - 1, 0))
            known = head_keys[place] == unique if len(head_keys) else np.zeros(len(unique), bool)
            sums += np.bincount(d, np.repeat(np.where(known, head_gain[place], 0) if len(head_keys) else 0.0 * unique, count), len(size))
            rest = np.flatnonzero(~known)
            del place, known
            rest = rest[has(bits, unique[rest])]
            if len(rest):
                pick = np.zeros(len(unique), bool)
                pick[rest] = True
                found.append((unique[rest], count[rest], d[np.repeat(pick, count)]))
        return sums, self.dealt(found)

    def families(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What a word, a bigram, a history and a trigram of each token tell, as keys and documents; the start mark is a history once a document."""
        tokens = np.concatenate([marked(t) for t in self.texts])
        doc = np.repeat(np.arange(len(size), dtype=np.uint16), size + 3)
        at = np.flatnonzero(np.concatenate([[False, False], doc[2:] == doc[:-2]]))  # places of words and end marks
        u, v, w, doc = tokens[at - 2], tokens[at - 1], tokens[at], doc[at]
        del tokens, at
        plan, width = self.plan, self.plan.width
        one = np.concatenate([w, np.full(len(size), START, np.uint32)])
        yield key(plan.base(one), width, WORD, one), np.concatenate([doc, np.arange(len(size), dtype=np.uint16)])
        yield key(plan.shard(w, v), width, BIGRAM, v, w), doc
        yield key(plan.shard(u, v), width, HISTORY, u, v), doc
        yield key(plan.shard(u, v), width, TRIGRAM, u, v, w), doc

    def dealt(self, found: list[tuple]) -> Iterator[tuple]:
        """Each family's keys are sorted, and those of a shard are a range of them."""
        if not found:
            return
        ends = [np.append(0, np.cumsum(count, dtype=np.int64)) for _, count, _ in found]
        cuts = [[0, *np.searchsorted(keys, shard_of(self.plan.width)), len(keys)] for keys, _, _ in found]
        for s in range(self.plan.width):
            own = [(slice(c[s], c[s + 1]), slice(e[c[s]], e[c[s + 1]])) for c, e in zip(cuts, ends)]
            keys, count, docs = (np.concatenate(x) for x in zip(*((k[i], n[i], d[j]) for (k, n, d), (i, j) in zip(found, own))))
            if len(keys):
                order, end = np.argsort(keys, kind="stable"), np.cumsum(count, dtype=np.int64)
                n = count[order]
                at = np.repeat((end - count)[order] - np.cumsum(n, dtype=np.int64) + n, n) + np.arange(len(docs))
                yield (self.number, len(self.texts), s, QUERY, squeeze(keys[order]), packed(n.astype("<u4")), packed(docs[at].astype("<u2")), b"")


def asked(docs: DataFrame, head, plan: Layout) -> DataFrame:
    """Shard parts of docs(doc_id, lang, k_text, text); and for each chunk, what its documents are and the head's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        from pyspark import TaskContext

        task, number, words = TaskContext.get().partitionId(), 0, Words(plan.codes)
        chunk, who = Chunk(task << 24, plan, head.value), []

        def send():
            if not who:
                return
            sums, rows = chunk.scored()
            sizes = np.array([len(t) for t in chunk.texts], "<u4").tobytes()
            meta = (chunk.number, len(who), chunk.number % plan.width, META, json.dumps(who).encode(), sizes, sums.astype("<i8").tobytes(), b"")
            for some in itertools.batched(itertools.chain(rows, [meta]), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), PARTS)], schema=PARTS)
            del rows, some
            trim()

        for batch in batches:
            for part in pieces(batch):
                *columns, texts = part.columns
                for found, chars, *row in zip(words(texts), pc.utf8_length(texts).to_pylist(), *(c.to_pylist() for c in columns)):
                    chunk.add(found, chars or 0)
                    who.append(row)
                    if chunk.full():
                        yield from send()
                        number += 1
                        chunk, who = Chunk((task << 24) + number, plan, head.value), []
        yield from send()

    return docs.select("doc_id", "lang", "k_text", "text").mapInArrow(run, PARTS_DDL)


SCORED = "doc_id long, k_text long, lang string, model int, n_words long, log_ppl double"


def unjudged() -> Callable[[list[list]], dict]:
    """SCORED where no text is trusted: documents with words are all alike."""

    def run(columns: list[list]) -> dict:
        ids, keys, langs, texts = columns
        sizes = [len(t.split()) if t else 0 for t in texts]
        return {"doc_id": ids, "k_text": keys, "lang": langs, "model": [0] * len(ids), "n_words": sizes, "log_ppl": [0.0 if n else None for n in sizes]}

    return run


def fitted(trusted: DataFrame, plan: Layout) -> tuple[DataFrame, dict] | None:
    """Trigrams and what their shards are told; discounts and sums. None without words."""
    parts = [materialise(trigrams(trusted, plan))]
    release(trusted.sparkSession)
    parts.append(materialise(ask_pairs(parts[0], plan)))
    parts.append(materialise(ask_words(*parts, plan)))
    model = parts[0].unionByName(parts[1]).unionByName(parts[2])
    fit = statistics(model, plan)
    model.parts = parts
    return (model, fit) if fit["words"] else None


def scored_by(docs: DataFrame, model: DataFrame, fit: dict, number: int, head: int, plan: Layout) -> DataFrame:
    """SCORED by one model, whose tables are deleted then."""
    spark = docs.sparkSession
    fit_b = spark.sparkContext.broadcast(fit)
    head_b = spark.sparkContext.broadcast(head_and_map(model, fit_b, head, plan))
    release(spark)
    base = round(fit["unknown"] * UNIT)

    def lookup(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, gain, out = None, None, []
        if (pdf["kind"] == QUERY).any() and (pdf["kind"] < QUERY).any():
            keys, gain, _ = gains(pdf[pdf["kind"] < QUERY], int(pdf["shard"].iloc[0]), fit_b.value, plan)
        for kind, chunk, n, k, c, d in zip(pdf["kind"], pdf["chunk"], pdf["size"], pdf["u"], pdf["v"], pdf["w"]):
            if kind == META:
                out.append((chunk, META, n, k, c, d))
            elif kind == QUERY and keys is not None:
                q = expand(k)
                at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
                found = np.where(keys[at] == q, gain[at], 0).astype(float)
                sums = np.bincount(unpacked(d, "<u2"), np.repeat(found, unpacked(c, "<u4")), int(n))
                out.append((chunk, QUERY, n, packed(np.rint(sums).astype("<i8")), b"", b""))
        return pd.DataFrame(out, columns=["chunk", "kind", "size", "data", "more", "sums"]).astype({"chunk": "int64", "kind": "int32", "size": "int32"})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        meta = pdf[pdf["kind"] == META].iloc[0]
        who = json.loads(meta["data"])
        sizes = np.frombuffer(meta["more"], "<u4").astype(np.int64)
        total = np.frombuffer(meta["sums"], "<i8") + (sizes + 1) * base
        for data in pdf.loc[pdf["kind"] == QUERY, "data"]:
            total = total + unpacked(data, "<i8")
        return pd.DataFrame({
            "doc_id": pd.array([x[0] for x in who], "Int64"), "k_text": [x[2] for x in who], "lang": [x[1] for x in who], "model": [number] * len(who),
            "n_words": sizes, "log_ppl": [-t / UNIT / (s + 1) if s else None for t, s in zip(total.tolist(), sizes.tolist())],
        })

    def ask(some: DataFrame) -> DataFrame:
        both = asked(some, head_b, plan).unionByName(model, allowMissingColumns=True)
        back = both.groupBy("shard").applyInPandas(trimmed(lookup), "chunk long, kind int, size int, data binary, more binary, sums binary")
        return materialise(back.groupBy("chunk").applyInPandas(gather, SCORED))

    done = []
    for i in range(TURNS):
        done.append(ask(docs.filter(turn() == i)))
        release(spark)
    head_b.destroy()
    fit_b.destroy()
    for part in model.parts:
        discard(part)
    return functools.reduce(DataFrame.unionByName, done)


def score(docs: DataFrame, labels: DataFrame, most_trusted: int | None, head: int) -> DataFrame:
    """SCORED for each row of docs(doc_id, lang, k_text, text). most_trusted: a caller's own bound on the documents to learn from; None: all.
    One model is made and asked after the other."""
    chosen = materialise(trusted_ids(labels, most_trusted))
    docs = docs.withColumn("fold", fold())
    bits_b = docs.sparkSession.sparkContext.broadcast(map_of_ids(chosen.select("doc_id")))
    plan = layout(docs, bits_b, shards(docs))

    def learnt(f: int) -> tuple[DataFrame, dict] | None:
        own = likely(docs.filter(F.col("fold") == f), bits_b).join(chosen, "doc_id", "left_semi")
        return fitted(own.groupBy("doc_id", F.xxhash64("text")).agg(F.min("text").alias("text")), plan)  # a row that is repeated trains once

    first, done = learnt(0), []
    if first:
        done.append(scored_by(docs.filter("fold = 1"), *first, 0, head, plan))
    second = learnt(1)
    if second:
        done.append(scored_by(docs.filter("fold = 0") if first else docs, *second, 1, head, plan))
    elif first:
        done.append(scored_by(docs.filter("fold = 0"), *learnt(0), 0, head, plan))
    bits_b.destroy()
    return functools.reduce(DataFrame.unionByName, done) if done else map_slices(docs.select("doc_id", "k_text", "lang", "text"), SCORED, unjudged, 3)


def quantiles(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by, n, at: the least thousandth that `share` of the values of each group don't exceed, from exact counts by thousandth."""
    bins = rows.groupBy(*by, F.floor(F.col(value) * 1000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    each = Window.partitionBy(*by)
    run = bins.withColumns({"upto": F.sum("n").over(each.orderBy("bin")), "all": F.sum("n").over(each)})
    return run.filter(F.col("upto") >= F.col("all") * share).groupBy(*by).agg(F.first("all").alias("n"), ((F.min("bin") + 1) / 1000.0).alias("at"))


def classify(docs: DataFrame, labels: DataFrame, most_trusted: int | None = None, good: float = 0.99, prior_docs: int = 100, spread: int = 20, head: int = 1_000_000) -> DataFrame:
    """doc_id, k_text, lang, n_words, log_ppl, kept for each row of docs(doc_id, text, lang)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), row_key(F.col("doc_id"), F.col("text"))[1], "text")
    with scope(docs.sparkSession):
        scored = materialise(score(keyed, labels, most_trusted, head), outside=True).withColumn("l", F.coalesce("lang", F.lit("")))
    release(docs.sparkSession)
    by = ["l", "model"]
    mid = quantiles(scored.filter("log_ppl is not null"), by, "log_ppl", 0.5).select(*by, F.col("at").alias("mid"))
    far = (F.col("log_ppl") - F.col("mid")) * F.sqrt(F.col("n_words") / (F.col("n_words") + spread))
    placed = materialise(scored.join(mid, by, "left").withColumn("far", far))
    ids = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = materialise(placed.filter("far is not null").join(ids, "doc_id", "left_semi").select(*by, "far"))
    whole = quantiles(trusted, ["model"], "far", good).select("model", F.col("at").alias("all_at"))
    own = quantiles(trusted, by, "far", good)
    fence = materialise(mid.select(*by).join(whole, "model", "left").join(own, by, "left").select(*by, ((F.coalesce("n", F.lit(0)) * F.coalesce("at", F.lit(0.0)) + F.col("all_at") * prior_docs) / (F.coalesce("n", F.lit(0)) + prior_docs)).alias("fence")))
    out = placed.join(fence, by, "left")
    kept = F.col("log_ppl").isNotNull() & F.coalesce(F.col("far") <= F.col("fence"), F.lit(True))
    return out.select("doc_id", "k_text", "lang", "n_words", "log_ppl", "far", kept.alias("kept"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    out = classify(docs, labels)
    bad = materialise(out.filter(~F.col("kept")).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k_id"), "k_text").distinct())
    rows = boxed(docs).join(bad, ["k_id", "k_text"], "left_anti")
    return rows.select(*unboxed(rows, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_words", F.round("log_ppl", 4).alias("log_ppl"), "kept")
