"""Alignment of tokenizers, ranked search and mixing of sources, against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plinth.llm import ranked_search, source_mixing, token_alignment
from plinth.llm.common import byte_ranks
from tests.llm.conftest import hard_rows
from tests.oracle import assert_same, views

A, B = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, token by token."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    a_bytes = {i: data for data, i in byte_ranks(tok.get_vocab()).items()}
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    found, held = [], Counter()
    for t in texts:
        a, b = (tok.encode(f" {t}", add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        want = f" {t}".encode()
        if not t or b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            found.append(None)
            continue
        spans = []
        for ids, data in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for x in ids:
                own.append((at, at + len(data[x]), x))
                at += len(data[x])
            spans.append(own)
        ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups = ["|".join(",".join(str(x) for s, e, x in own if lo < e <= hi) for own in spans) for lo, hi in zip([0, *ends], ends)]
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
        held.update(set(links))
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(held[p] == best[p[0]] for p in f[3]), sum(held[p] for p in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("slot_bytes", [1 << 20, 300])
def test_alignment_is_the_brute_force_one(spark, hard, slot_bytes):
    rows = [(r[0], r[1][:4000] if r[1] else r[1]) for r in hard_rows()]
    rows += [(100 + i, t) for i, t in enumerate(["a\r\nb \r c", " lead", "trail ", "  two  spaces \n\n nl ", "\n", " ", "▁ x", "tab\there", "1,234.5%", "naïve café's"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_alignment.align(docs, A, B, cache_entries=40, slot_bytes=slot_bytes).collect()
    want = plain_alignment([t for _, t in rows])
    assert sorted(str((i, *w)) for (i, _), w in zip(rows, want)) == sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in got)
    assert sum(w[3] > 0 for w in want) > 15


def test_alignment_of_nothing(empty):
    assert token_alignment.align(empty, A, B).count() == 0


def plain_search(rows, items, k):
    texts = [(i, [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(ranked_search.TERM, t or "")]) for i, t in rows]
    texts = [(i, w) for i, w in texts if w]
    total = sum(len(w) for _, w in texts)
    df = Counter(x for _, w in texts for x in set(w))
    out = []
    for item, t in items:
        terms = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(ranked_search.TERM, t or ""))
        scores = []
        for i, words in texts:
            tf, m = Counter(words), 75 + 25 * len(words) * len(texts) // total
            s = sum(n * math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x, n in terms.items() if tf[x])
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def test_search_is_the_brute_force_one(spark, hard, monkeypatch):
    items = [(1, "Alpha1 BETA2 gamma3 beta2"), (2, None), (3, "zzz nowhere"), (4, "two Words ... ñandú straße 漢字"), (4, "x y z"), (5, " ".join(r[1] or "" for r in hard_rows())), (None, "one id")]
    df = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in hard_rows()]
    for docs, k, most in ((hard, 3, 10**6), (hard, 20, 10**6), (hard.repartition(7), 1, 5)):
        monkeypatch.setattr(ranked_search, "BLOCK_PAIRS", 300 if most == 5 else 400_000)
        got = ranked_search.ranked_search(docs, df, k).collect()
        assert sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in got) == plain_search(rows, items, k)


def test_small_chunks_give_the_same(spark, hard):
    n_docs, n_terms = ranked_search.totals(hard)
    items = spark.createDataFrame([(1, "alpha1 beta2 gamma3"), (2, hard_rows()[6][1])], "item_id long, text string")
    index = ranked_search.build(hard.repartition(20), n_docs, n_terms).cache()
    want = sorted(map(str, ranked_search.ranked_search(hard, items).collect()))
    assert sorted(map(str, ranked_search.search(index, items, n_docs, n_terms).collect())) == want
    assert all(n == b"" or len(n) == r.df for r in index.filter("term <> ''").collect() for n in [r.impact])


def test_search_of_nothing(spark, hard, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(empty, items).count() == 0
    assert ranked_search.ranked_search(hard, items.limit(0)).count() == 0


def plain_mix(rows):
    """doc_id, size, source_size, target, taken by cumulated sums in order of the hash."""
    size = {n: len(re.findall(source_mixing.WORD, r[1] or "")) for n, r in enumerate(rows)}
    key = {n: (r[3] is None, r[3] or "") for n, r in enumerate(rows)}
    h = {n: int(hashlib.md5(f"{'' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).hexdigest()[:15], 16) for n, r in enumerate(rows)}
    sums = Counter()
    for n in size:
        sums[key[n]] += size[n]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(sums))}
    full: set = set()
    while True:
        left, w = 1.5 * sum(sums.values()) - sum(2 * sums[k] for k in full), sum(weight[k] for k in sums if k not in full)
        target = {k: 2.0 * sums[k] if k in full else weight[k] * left / w for k in sums}
        above = {k for k in sums if target[k] > 2 * sums[k]}
        if not above:
            break
        full |= above
    out = []
    for k in sums:
        times = int(target[k] // sums[k]) if sums[k] else 0
        rest, by = target[k] - times * sums[k], defaultdict(int)
        for n in size:
            if key[n] == k:
                by[h[n]] += size[n]
        cut, upto = -1, 0
        if rest > 0:
            cuts = [(abs(rest), 0, -1)]
            for x in sorted(by):
                upto += by[x]
                cuts.append((abs(upto - rest), upto, x))
            cut = min(cuts)[2]
        out += [(rows[n][0], size[n], sums[k], round(target[k], 6), size[n] * (times + (h[n] <= cut))) for n in size if key[n] == k]
    return sorted(map(str, out))


def test_mix_is_the_brute_force_one(spark, hard):
    rows = hard_rows()
    got = source_mixing.mix(hard).collect()
    assert sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in got) == plain_mix(rows)
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "en", f"s{i * i % 11}", 1, "", "", "") for i in range(3000)]
    got = source_mixing.mix(spark.createDataFrame(rows, hard.schema).repartition(5))
    assert sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in got.collect()) == plain_mix(rows)


def test_mix_reruns_agree_and_meet_targets(spark, sf_dir):
    rows = [source_mixing.query(spark, sf_dir).collect() for _ in range(2)]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1]))
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows[0])


def test_targets_of_large_sources(spark):
    rows = [(f"s{i}", n, w) for i, (n, w) in enumerate([(10**14, 5), (3, 2), (7 * 10**13, 1), (0, 5)])]
    got = source_mixing.targeted(spark.createDataFrame(rows, "key string, source_size long, weight int"), sum(r[1] for r in rows), 150, 2)
    assert {r.key: r.target for r in got.collect()} == {"s0": 2.0 * 10**14, "s1": 6.0, "s2": 1.5 * (17 * 10**13 + 3) - 2 * 10**14 - 6, "s3": 0.0}


def test_mix_of_nothing(empty):
    assert source_mixing.mix(empty).count() == 0


@pytest.mark.parametrize("module", [ranked_search, source_mixing])
def test_sql(spark, sf_dir, module):
    assert_same(module.query(spark, sf_dir), views(sf_dir), module.ORACLE)


def test_mix_is_native(spark, sf_dir):
    plan = source_mixing.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
