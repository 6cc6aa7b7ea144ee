"""Alignment of two tokenizers over a corpus, by dense count matrices striped by id.

1. Each worker encodes its documents with both tokenizers and cuts them where tokens of both end. Where neither tokenizer can merge
   across a place (between a character and the white space after it), a text is the sum of its units, so units are encoded and aligned once
   and kept in a bounded cache. A chunk of documents leaves one row for each stripe of the first tokenizer's ids (id modulo the number of stripes):
   its distinct id pairs, how many of its documents hold each, and which. This table is written, so nothing is encoded twice.
2. Pairs and their document counts, not documents, go to their stripe, where np.add.at adds them into the stripe's dense block of counts.
   A stripe's rows are dealt to as many slots as their size asks for, and blocks of slots are summed in a tree, so a pair
   that is on every document costs each chunk one number. Row maxima of the whole block mark each id's best partners.
3. Links go to the same slots as the counts of their stripe and are scored there, block by block; a document's sums meet again by chunk.

Memory: a block holds (ids / stripes) x ids counts whatever the input; slots, chunks and caches have stated bounds.

Defined results: null and empty texts, and those whose joined token bytes differ from a space and the text, have zeros and ''. Each row
is a document, repeated rows and ids too. Only doc_id and text are read. An empty table gives no rows. Texts are read whole; a text
with characters outside a plainly classified range is encoded whole. Special strings inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PieceCache, byte_ranks, is_plain, materialise, sliced, table

#: Stripes of the first tokenizer's ids. A block of 50,257 / 128 x 32,000 counts takes 100 MB at most.
STRIPES = 128
#: Characters and documents of a chunk (positions of documents are written in 16 bits).
CHUNK_CHARS, CHUNK_DOCS = 1 << 22, 60_000
#: Bytes of links that one slot takes about; more slots a stripe beyond that.
SLOT_BYTES = 96 << 20
#: Slots whose blocks are summed in one task.
FAN_IN = 32

#: Fixed value: the byte-level tokenizer's pattern of pre-tokens.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = re.compile(r"\s*\S+|\s+")
#: Units that are longer aren't kept in the cache.
LONG_UNIT = 64

DOCS = "array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>"
LINKS = f"chunk long, stripe int, bytes long, row binary, b binary, n binary, doc binary, mult binary, docs {DOCS}"
COUNTS = "stripe int, salt int, row binary, b binary, n binary, best binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class Aligner:
    """Texts -> records (n_a, n_b, n_groups, n_links, groups, links), None where bytes differ. links are a << 16 | b, 32 bits each."""

    def __init__(self, a_path: str, b_path: str, cache_entries: int = 250_000):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(a_path)
        self.tok.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        special = set(self.tok.get_added_tokens_decoder())
        ranks = byte_ranks({t: i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if i not in special})
        self.a_bytes = [b""] * self.tok.get_vocab_size()
        for data, i in ranks.items():
            self.a_bytes[i] = data
        n, piece = self.sp.get_piece_size(), self.sp.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.sp.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_len, self.b_len = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # Texts are cut into units only if no piece goes on across white space but in its first characters.
        self.space = self.sp.piece_to_id("▁")
        self.cuts = not any(re.search("[^▁]▁", piece(i)) for i in range(n))
        inside = sorted({c for i in range(n) if len(piece(i)) > 1 for c in piece(i) if c.isspace()})
        self.uncut = re.compile("[" + re.escape("".join(inside)) + "]") if inside else None
        self.merge = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.shown = [f"{i}{sign}".encode() for i in range(max(len(self.a_bytes), n)) for sign in ",|;"]
        self.shown_len = np.array([len(x) for x in self.shown], np.int64)
        self.cache = PieceCache(self.of_units, most=cache_entries)

    def by_unit(self, text: str) -> bool:
        return self.cuts and is_plain(text) and not (self.uncut and self.uncut.search(text))

    def of_units(self, units: list[str]) -> list:
        """Units stand as they do in a text after a space: what doesn't start with one is given the library's own space, which is taken off."""
        b = self.sp.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        b = [[self.space] if u == " " else x if u[0] == " " else x[1:] for u, x in zip(units, b)]
        return self.aligned(units, list(map(self.merge, units)), b)

    def of_texts(self, texts: list[str]) -> list:
        return self.aligned([f" {t}" for t in texts], [self.tok.encode(f" {t}", add_special_tokens=False).ids for t in texts], self.sp.encode(texts, num_threads=1))

    def aligned(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> list:
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        want = "".join(units).encode()
        if b"".join(map(self.a_bytes.__getitem__, flat_a)) != want or b"".join(map(self.b_bytes.__getitem__, flat_b)) != want:
            if len(units) == 1:
                return [None]
            middle = len(units) // 2
            return self.aligned(units[:middle], a[:middle], b[:middle]) + self.aligned(units[middle:], a[middle:], b[middle:])
        if not flat_a:
            return [None] * len(units)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        end_a, end_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        start_a, start_b = end_a - self.a_len[ids_a], end_b - self.b_len[ids_b]
        first, stop = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        each = stop - first
        to_b = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first, each)
        links = (np.repeat(ids_a, each) << 16 | ids_b[to_b]).astype("<u4").tobytes()
        upto_a = np.cumsum(n_a)
        upto_link, ends = np.cumsum(each)[upto_a - 1], np.intersect1d(end_a, end_b, assume_unique=True)
        upto_group = np.searchsorted(ends, end_a[upto_a - 1], "right")
        # Tokens in the order in which groups are shown, each with the sign that follows it: a,a|b;a|b,b;
        group_a, group_b = np.searchsorted(ends, end_a, "left"), np.searchsorted(ends, end_b, "left")
        shown, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.int64)
        at_a, at_b = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left"), np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        shown[at_a], shown[at_b] = ids_a, ids_b
        sign[at_a[np.searchsorted(end_a, ends)]], sign[at_b[np.searchsorted(end_b, ends)]] = 1, 2
        token = shown * 3 + sign
        text = b"".join(map(self.shown.__getitem__, token.tolist()))
        upto_text = np.cumsum(self.shown_len[token])[np.cumsum(n_a + n_b) - 1]
        found, l0, g0, t0 = [], 0, 0, 0
        for x, y, g1, l1, t1 in zip(n_a.tolist(), n_b.tolist(), upto_group.tolist(), upto_link.tolist(), upto_text.tolist()):
            found.append((x, y, g1 - g0, l1 - l0, text[t0 : t1 - 1], links[4 * l0 : 4 * l1]))
            l0, g0, t0 = l1, g1, t1
        return found

    def chunk(self, texts: list[str | None]) -> tuple[list, list]:
        """For each text (n_a, n_b, n_groups, n_links, sha256); and for each unit of the chunk its links, with the units of each text."""
        code: defaultdict = defaultdict()
        code.default_factory = code.__len__
        units_of = []
        for t in texts:
            units = [] if not t else UNIT.findall(f" {t}") if self.by_unit(t) else [(t,)]
            units_of.append(np.fromiter(map(code.__getitem__, units), np.int64, len(units)))
        short = [u for u in code if isinstance(u, str) and len(u) <= LONG_UNIT]
        self.cache.learn(short)
        long = [u for u in code if isinstance(u, str) and len(u) > LONG_UNIT]
        whole = [u for u in code if isinstance(u, tuple)]
        other = dict(zip(long, self.of_units(long) if long else ())) | dict(zip(whole, self.of_texts([u[0] for u in whole])))
        records = [other[u] if u in other else self.cache[u] for u in code]
        sums = np.array([r[:4] if r else (0, 0, 0, 0) for r in records], np.int64).reshape(-1, 4)
        bad = np.array([r is None for r in records], bool)
        shown = [r[4] if r else b"" for r in records]
        docs, kept = [], []
        for units in units_of:
            if not len(units) or bad[units].any():
                docs.append((0, 0, 0, 0, ""))
                kept.append(units[:0])
            else:
                docs.append((*sums[units].sum(0).tolist(), hashlib.sha256(b";".join(map(shown.__getitem__, units.tolist()))).hexdigest()))
                kept.append(units)
        return docs, [kept, [r[5] if r else b"" for r in records], sums[:, 3]]


def links_by_stripe(kept: list[np.ndarray], links: list[bytes], n_links: np.ndarray) -> Iterator[tuple]:
    """(stripe, row, b, n, doc, mult): the distinct id pairs of a chunk in a stripe, the number of documents that hold each, which, and how often."""
    per = [np.unique(u, return_counts=True) for u in kept]
    n_docs, sizes = len(kept), np.array([len(u) for u, _ in per], np.int64)
    if not sizes.sum():
        return
    unit, times, doc = np.concatenate([u for u, _ in per]), np.concatenate([c for _, c in per]), np.repeat(np.arange(n_docs), sizes)
    flat = np.frombuffer(b"".join(links), "<u4").astype(np.int64)
    a, b = flat >> 16, flat & 0xFFFF
    pairs, code = np.unique((a % STRIPES) << 40 | (a // STRIPES) << 16 | b, return_inverse=True)
    each = n_links[unit]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - (np.cumsum(n_links) - n_links)[unit], each)
    key = code[at] * n_docs + np.repeat(doc, each)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    mult = np.add.reduceat(np.repeat(times, each)[order], new)
    pair, doc = key[new] // n_docs, key[new] % n_docs
    n = np.bincount(pair, minlength=len(pairs))
    used = n > 0
    pairs, n = pairs[used], n[used]
    upto = np.concatenate(([0], np.cumsum(n)))
    bounds = np.searchsorted(pairs, np.arange(STRIPES + 1) << 40)
    for s, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if i < j:
            x, y = upto[i], upto[j]
            yield s, (pairs[i:j] >> 16 & 0xFFFFFF).astype("<u2"), (pairs[i:j] & 0xFFFF).astype("<u2"), n[i:j].astype("<u4"), doc[x:y].astype("<u2"), mult[x:y].astype("<u4")


def encode(docs: DataFrame, a_path: str, b_path: str, cache_entries: int) -> DataFrame:
    """LINKS: for each chunk, a row for each stripe, and one with its documents (stripe null)."""
    schema = arrow(LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, chunk = Aligner(a_path, b_path, cache_entries), TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in sliced([c.to_pylist() for c in batch.columns], 1, CHUNK_CHARS):
                for i in range(0, len(ids), CHUNK_DOCS):
                    docs, links = aligner.chunk(texts[i : i + CHUNK_DOCS])
                    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                    rows = [(chunk, None, 0, *[None] * 5, [{"doc_id": k} | dict(zip(names, d)) for k, d in zip(ids[i : i + CHUNK_DOCS], docs)])]
                    for s, *parts in links_by_stripe(*links):
                        rows.append((chunk, s, sum(x.nbytes for x in parts), *[x.tobytes() for x in parts], None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    chunk += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKS)


def added(rows: DataFrame, salts: int, size: tuple[int, int], last: bool) -> DataFrame:
    """COUNTS: the sums of rows (stripe, salt, row, b, n) of each slot, from a dense block. last: with the row maxima marked."""
    schema = arrow(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = stripe = salt = None
        for batch in batches:
            for s, t, row, b, n in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None:
                    block, stripe, salt = np.zeros(size[0] * size[1], np.int64), s, t
                n = np.frombuffer(n, "<u4" if len(n) == 2 * len(row) else "<i8")
                np.add.at(block, np.frombuffer(row, "<u2").astype(np.int64) * size[1] + np.frombuffer(b, "<u2"), n.astype(np.int64))
        if block is None:
            return
        most = block.reshape(size).max(axis=1)
        full = np.flatnonzero(block)
        for i in range(0, len(full), 1 << 20):
            at = full[i : i + (1 << 20)]
            row, n = at // size[1], block[at]
            best = (n == most[row]).tobytes() if last else b""
            out = [[stripe], [salt], [row.astype("<u2").tobytes()], [(at % size[1]).astype("<u2").tobytes()], [n.astype("<i8").tobytes()], [best]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    slot = F.col("stripe") * salts + F.col("salt")
    return rows.select("stripe", "salt", "row", "b", "n").repartitionById(STRIPES * salts, slot.cast("int")).mapInArrow(run, COUNTS)


def scored(links: DataFrame, counts: DataFrame, salts: int, size: tuple[int, int]) -> DataFrame:
    """chunk, best, total: what the links of one stripe add to n_best and count_sum of a chunk's documents. Links meet their stripe's counts in their slot."""

    def smallest(x: np.ndarray) -> bytes:
        return x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<u8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = marked = None
        for batch in batches:
            out: list[tuple] = []
            for chunk, row, b, n, best, doc, mult in zip(*(c.to_pylist() for c in batch.columns[1:])):
                at = np.frombuffer(row, "<u2").astype(np.int64) * size[1] + np.frombuffer(b, "<u2")
                if chunk is None:
                    if block is None:
                        block, marked = np.zeros(size[0] * size[1], np.int64), np.zeros(size[0] * size[1], bool)
                    block[at], marked[at] = np.frombuffer(n, "<i8"), np.frombuffer(best, bool)
                    continue
                n, doc, mult = np.frombuffer(n, "<u4"), np.frombuffer(doc, "<u2"), np.frombuffer(mult, "<u4").astype(np.int64)
                total, hits = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(total, doc, np.repeat(block[at], n) * mult)
                np.add.at(hits, doc, np.repeat(marked[at], n) * mult)
                out.append((chunk, smallest(hits), smallest(total), len(total)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.int32()))], ["chunk", "best", "total", "n"])

    none = lambda kind: F.lit(None).cast(kind)
    copies = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none("long").alias("chunk"), "row", "b", "n", "best", none("binary").alias("doc"), none("binary").alias("mult"))
    own = links.select("stripe", "salt", "chunk", "row", "b", "n", none("binary").alias("best"), "doc", "mult")
    slot = (F.col("stripe") * salts + F.col("salt")).cast("int")
    both = own.unionByName(copies).withColumn("kind", F.col("chunk").isNotNull()).repartitionById(STRIPES * salts, slot).sortWithinPartitions("kind")
    return both.select("kind", "chunk", "row", "b", "n", "best", "doc", "mult").mapInArrow(run, "chunk long, best binary, total binary, n int")


def gathered(group: pa.Table, schema: pa.Schema) -> pa.Table:
    """A chunk's documents with the sums of its stripes; a chunk and its stripes have bounded size."""
    docs = next(x for x in group["docs"].to_pylist() if x is not None)
    n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for b, t, n in zip(group["best"].to_pylist(), group["total"].to_pylist(), group["n"].to_pylist()):
        if n:
            n_best[:n] += np.frombuffer(b, f"<u{len(b) // n}").astype(np.int64)
            total[:n] += np.frombuffer(t, f"<u{len(t) // n}").astype(np.int64)
    columns = {k: [d[k] for d in docs] for k in docs[0]} | {"n_best": n_best, "count_sum": total}
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def align(docs: DataFrame, a_path: str, b_path: str, cache_entries: int = 250_000, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """One row (RESULT) for each row of docs(doc_id, text)."""
    from tokenizers import Tokenizer
    import sentencepiece

    ids = Tokenizer.from_file(a_path).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    size = -(-ids[0] // STRIPES), ids[1]
    written = materialise(encode(docs, a_path, b_path, cache_entries))
    salts = 1 + (written.agg(F.sum("bytes")).first()[0] or 0) // (STRIPES * slot_bytes)
    links = written.filter("stripe IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    counts, left = added(links, salts, size, salts == 1), salts
    while left > 1:
        fewer = -(-left // FAN_IN)
        counts = added(counts.withColumn("salt", (F.col("salt") / FAN_IN).cast("int")), fewer, size, fewer == 1)
        left = fewer
    sums = scored(links, materialise(counts), salts, size).select("chunk", F.lit(None).cast(DOCS).alias("docs"), "best", "total", "n")
    own = written.filter("stripe IS NULL").select("chunk", "docs", F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("total"), F.lit(None).cast("int").alias("n"))
    schema = arrow(RESULT)
    return own.unionByName(sums).groupBy("chunk").applyInArrow(lambda group: gathered(group, schema), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
