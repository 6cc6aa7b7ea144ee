"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A text's likelihood in a language is the sum
over all its segmentations into pieces. No piece spans two runs of letters, so that sum is a product over the text's
words, and the forward algorithm has to run once for each distinct word: workers keep a bounded cache of words.
Piece probabilities are fitted by expectation-maximisation over word counts of a bounded sample of labelled texts.

Sample bound, on labelled rows alone: about docs_per_lang texts a language, and about labelled_rows in all (evenly fewer of each language where there
are many, 20 at least; a language with fewer gives all it has). Every word of these texts is learnt from, and every language is predicted. What
comes to the driver and is broadcast are each language's pieces that occur, of a vocabulary of fixed size, and one floor for the others. Texts
are scored against LANGS languages at a time, so a worker's tables have a bound whatever the number of languages.
Defined results: `und` with score 0 where the text is null or has no letter, or where nothing could be learnt; ties go to
the language that sorts first. A null doc_id is not held out and never learnt from. Each row gives one row; whole texts are read;
of the other columns only lang is read, in learning alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, materialise, table

#: Runs of letters (and of numerals that no rule calls digits, which are unknown to every language alike).
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-7
TINY, HUGE = 1e-200, 1e200
#: Longer words go one by one, with scaling against underflow.
LONG = 30
#: Languages that a text is scored against at a time.
LANGS = 256
#: Words of one length that are learnt from at a time.
CHUNK = 4096
#: First bits of a piece's hash that find it; about one in eight of their values has a piece.
BITS = 18
U = np.uint64
M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Piece -> number, for pieces of letters with or without the mark of a word's start; and the longest piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if p.lstrip("▁").isalpha() and "▁" not in p[1:] and p == p.lower()} | {"▁"})
    return {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))


def edges(word: str, pieces: dict[str, int], longest: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, piece number) of all pieces in ▁word, by their starts; -1 for a character that is no piece."""
    s = f"▁{word}"
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + longest) + 1):
            k = pieces.get(s[i:j])
            if k is not None:
                yield i, j, k
            elif j == i + 1:
                yield i, j, -1


def spans(size: int, longest: int) -> list[tuple[int, int]]:
    """(from, to) of all places in a word of this size where a piece may lie, by their ends."""
    return [(i, j) for j in range(1, size + 1) for i in range(max(0, j - longest), j)]


def substrings(words: list[str], size: int, longest: int) -> Iterator[np.ndarray]:
    """64-bit hashes of all substrings of words of one size, by width: one row a word, by their starts."""
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size).astype(U) + U(1)
    h = np.zeros((len(words), size), U)
    for width in range(1, min(size, longest) + 1):
        h = h[:, : size - width + 1] * M1 + letters[:, width - 1 :]
        x = (h ^ (h >> U(32))) * M2
        yield x ^ (x >> U(29))


@lru_cache(maxsize=2)
def hashed(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' hashes in order, their numbers, and where the hashes of each BITS first bits start."""
    by_size: dict[int, list[str]] = {}
    for piece in vocabulary(path)[0]:
        by_size.setdefault(len(piece), []).append(piece)
    pieces = vocabulary(path)[0]
    found = np.concatenate([list(substrings(x, size, size))[-1].ravel() for size, x in by_size.items()])
    number = np.array([pieces[p] for x in by_size.values() for p in x], np.int32)
    order = np.argsort(found)
    return found[order], number[order], np.searchsorted(found[order] >> U(64 - BITS), np.arange((1 << BITS) + 1, dtype=U)).astype(np.int32)


def numbers(words: list[str], size: int, path: str) -> np.ndarray:
    """The piece number in each span of each word (words of one length): the vocabulary's size for a lone unknown character, one more for
    no piece. Pieces are known by 64 bits, so that one of 10^12 substrings is mistaken with a probability below 0.002."""
    (pieces, longest), (known, number, start) = vocabulary(path), hashed(path)
    place = {x: i for i, x in enumerate(spans(size, longest))}
    out = np.empty((len(words), len(place)), np.int32)
    for width, hashes in enumerate(substrings(["▁" + w for w in words], size, longest), 1):
        h = hashes.ravel()
        first = (h >> U(64 - BITS)).astype(np.int64)
        ids = np.full(len(h), len(pieces) + (width > 1), np.int32)
        at = np.flatnonzero(start[first] < start[first + 1])
        here, end, h = start[first[at]], start[first[at] + 1], h[at]
        while len(at):
            hit = known[here] == h
            ids[at[hit]] = number[here[hit]]
            on = ~hit & (here + 1 < end)
            at, here, end, h = at[on], here[on] + 1, end[on], h[on]
        out[:, [place[i, i + width] for i in range(size - width + 1)]] = ids.reshape(hashes.shape)
    return out


def expected_long(word: str, pieces: dict[str, int], longest: int, p: np.ndarray) -> Iterator[tuple[int, float]]:
    """(piece number, expected uses) in one word of any length: sums over all segmentations in logarithms, which can't underflow."""
    q, size = np.log(p).tolist(), len(word) + 1
    ahead, behind = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
    ahead[0] = behind[size] = 0.0

    def plus(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)

    for i, j, k in edges(word, pieces, longest):
        ahead[j] = plus(ahead[j], ahead[i] + q[k])
    s = f"▁{word}"
    for i in range(size - 1, -1, -1):
        for j in range(i + 1, min(size, i + longest) + 1):
            k = pieces.get(s[i:j], -1 if j == i + 1 else None)
            if k is not None:
                behind[i] = plus(behind[i], q[k] + behind[j])
    for i, j, k in edges(word, pieces, longest):
        yield k, math.exp(min(0.0, ahead[i] + q[k] + behind[j] - ahead[size]))


def fit(words: list[str], counts: list[int], path: str, rounds: int = 4, smooth: float = 0.01) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations of all its words. Words of one length go
    through the forward and backward sums together, place by place; those longer than LONG one by one."""
    pieces, longest = vocabulary(path)
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w) + 1, []).append(i)
    times = np.array(counts, float)
    short = [(size, m[i : i + CHUNK]) for size, m in sorted(by_size.items()) if size <= LONG for i in range(0, len(m), CHUNK)]
    groups = [(size, numbers([words[i] for i in m], size, path), times[m]) for size, m in short]
    long = [i for size, m in sorted(by_size.items()) if size > LONG for i in m]
    p = np.full(len(pieces) + 1, 1 / len(pieces))
    p[-1] = UNKNOWN
    for _ in range(rounds):
        expected, q = np.zeros(len(pieces) + 2), np.append(p, 0.0)
        for size, ids, n in groups:
            at = spans(size, longest)
            ahead, behind = np.zeros((size + 1, len(ids))), np.zeros((size + 1, len(ids)))
            ahead[0] = behind[size] = 1.0
            for x, (i, j) in enumerate(at):
                ahead[j] += ahead[i] * q[ids[:, x]]
            scale = n / np.maximum(ahead[size], 1e-300)
            for x, (i, j) in sorted(enumerate(at), key=lambda z: -z[1][1]):
                used = q[ids[:, x]] * behind[j]
                behind[i] += used
                expected += np.bincount(ids[:, x], ahead[i] * used * scale, len(expected))
        for i in long:
            for k, e in expected_long(words[i], pieces, longest, p):
                expected[len(pieces) if k < 0 else k] += e * times[i]
        expected = expected[:-1]
        p = (expected + smooth) / (expected[:-1].sum() + smooth * len(pieces))
        p[-1] = UNKNOWN
    return p


class Scorer:
    """Log-likelihoods of words in every language, summed over all segmentations."""

    def __init__(self, model: dict[str, np.ndarray], path: str, most: int = 300_000):
        self.path, (self.pieces, self.longest) = path, vocabulary(path)
        self.langs = sorted(model)
        #: One row a piece, then the unknown character, then what is no piece.
        self.table = np.concatenate([np.stack([model[x] for x in self.langs], axis=1), np.zeros((1, len(self.langs)))]) if model else np.zeros((2, 0))
        self.p = self.table[:-1].tolist()
        self.most, self.again = most, set()
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))

    def word(self, word: str) -> list[float]:
        width, size, shift = range(len(self.langs)), len(word) + 1, 0.0
        ahead = [[0.0] * len(self.langs) for _ in range(size + 1)]
        ahead[0] = [1.0] * len(self.langs)
        at = 0
        for i, j, k in edges(word, self.pieces, self.longest):
            if i != at:
                at = i
                if max(ahead[i]) < TINY:
                    for x in range(i, min(size, i + self.longest) + 1):
                        ahead[x] = [v * HUGE for v in ahead[x]]
                    shift += math.log(HUGE)
            a, q, b = ahead[i], self.p[k], ahead[j]
            for x in width:
                b[x] += a[x] * q[x]
        return [math.log(v) - shift if v > 0 else -1e4 - shift for v in ahead[size]]

    def batch(self, words: list[str]) -> np.ndarray:
        """The same for many words: those of one length go through the forward algorithm together, place by place."""
        out = np.zeros((len(words), len(self.langs)))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w) + 1, []).append(i)
        for size, members in by_size.items():
            if size > LONG:
                out[members] = [self.word(words[i]) for i in members]
                continue
            ids = numbers([words[i] for i in members], size, self.path)
            ahead = [np.ones((len(members), len(self.langs)))] + [np.zeros((len(members), len(self.langs))) for _ in range(size)]
            for at, (i, j) in enumerate(spans(size, self.longest)):
                ahead[j] += ahead[i] * self.table[ids[:, at]]
            out[members] = np.log(np.maximum(ahead[size], 1e-300))
        return out

    def learn(self, words: list[str]) -> None:
        distinct = set(words)
        missing = [w for w in distinct if w not in self.index]
        if len(self.index) + len(missing) > self.most:
            kept = list(self.again) if 2 * len(self.again) < self.most else []
            self.rows = self.rows[[self.index[w] for w in kept]]
            self.index, self.again = {w: i for i, w in enumerate(kept)}, set()
            missing = [w for w in distinct if w not in self.index]
        else:
            self.again.update(distinct.difference(missing))
        if missing:
            first = len(self.index)
            self.index.update(zip(missing, range(first, first + len(missing))))
            if len(self.rows) < first + len(missing):
                grown = np.zeros((max(2 * len(self.rows), first + len(missing), 1024), len(self.langs)))
                grown[:first] = self.rows[:first]
                self.rows = grown
            self.rows[first : first + len(missing)] = self.batch(missing)

    def totals(self, split: list[list[str]]) -> np.ndarray:
        """Log-likelihood of each text, given as its words, in every language."""
        self.learn([w for s in split for w in s])
        at = (np.fromiter(map(self.index.__getitem__, s), np.int64, len(s)) for s in split)
        return np.array([self.rows[x].sum(axis=0) for x in at]).reshape(len(split), len(self.langs))


def predicted(scorers: Iterable[Scorer], texts: list[str | None]) -> list[tuple[str, float]]:
    """The likeliest language of each text and its share of all likelihoods, from scorers of some languages each, in order of language."""
    split = [WORDS.findall(t.lower()) if t else [] for t in texts]
    best, mass, lang = np.full(len(texts), -np.inf), np.zeros(len(texts)), ["und"] * len(texts)
    for scorer in scorers:
        total = scorer.totals(split)
        top = total.argmax(axis=1)
        value = total[np.arange(len(texts)), top]
        most = np.maximum(best, value)
        mass = mass * np.exp(best - most) + np.exp(total - most[:, None]).sum(axis=1)
        for i in np.flatnonzero(value > best):
            lang[i] = scorer.langs[top[i]]
        best = most
    lettered = [any(c.isalpha() for w in s for c in w) for s in split]
    return [(x, min(1.0, 1 / float(m))) if ok and m > 0 else ("und", 0.0) for x, m, ok in zip(lang, mass, lettered)]


def learnt_from() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def dense(model: dict[str, tuple], path: str) -> dict[str, np.ndarray]:
    """One vector over the fixed vocabulary for each language."""
    size, out = len(vocabulary(path)[0]), {}
    for lang, (ids, p, floor) in model.items():
        out[lang] = np.full(size + 1, floor)
        out[lang][ids] = p
        out[lang][-1] = UNKNOWN
    return out


def train(docs: DataFrame, path: str, docs_per_lang: int = 2000, labelled_rows: int = 400_000, rounds: int = 4) -> dict[str, tuple]:
    """By language: the pieces that occur, their probabilities, and the probability of any other piece."""
    labelled = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter("lang is not null and text is not null").filter(learnt_from())
    count = materialise(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    wanted = min(docs_per_lang, max(20, labelled_rows // max(1, count.count())))
    share = count.select("lang", (F.lit(float(wanted)) / F.col("n")).alias("share"))
    sample = labelled.join(share, "lang").filter((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) < F.col("share")).select("lang", "text")

    def factory():
        def run(columns):
            seen: Counter = Counter()
            for lang, t in zip(*columns):
                seen.update((lang, w) for w in WORDS.findall(t.lower()))
            return {"lang": [x[0] for x in seen], "word": [x[1] for x in seen], "n": list(seen.values())}

        return run

    words = map_slices(sample, "lang string, word string, n long", factory, 1).groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        p = fit(list(pdf.word), list(pdf.n), path, rounds)[:-1]
        ids = np.flatnonzero(p > p.min())
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "ids": [ids.astype(np.int32)], "p": [p[ids]], "floor": [p.min()]})

    rows = words.groupBy("lang").applyInPandas(em, "lang string, ids array<int>, p array<double>, floor double").collect()
    return {r.lang: (np.array(r.ids, np.int64), np.array(r.p), r.floor) for r in rows}


def identify(docs: DataFrame, model: dict[str, tuple], path: str, cache_words: int = 300_000, langs: int = LANGS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text). Up to `langs` languages have one table and cache of words for a
    whole task; more are gone through in blocks of so many, with tables made anew for each slice of texts."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        names = sorted(known.value)
        blocks = [names[i : i + langs] for i in range(0, len(names), langs)]
        kept: list[Scorer] = []

        def scorers() -> Iterator[Scorer]:
            yield from kept
            for block in blocks[len(kept) :]:
                scorer = Scorer(dense({x: known.value[x] for x in block}, path), path, cache_words)
                if len(blocks) == 1:
                    kept.append(scorer)
                yield scorer

        def run(columns):
            ids, held, texts = columns
            found = predicted(scorers(), texts)
            return {"doc_id": ids, "held_out": held, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return run

    held = F.coalesce(~learnt_from(), F.lit(False)).alias("held_out")
    return map_slices(docs.select(F.col("doc_id").cast("long"), held, "text"), "doc_id long, held_out boolean, lang_pred string, score double", factory, 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, train(docs, path), path)
