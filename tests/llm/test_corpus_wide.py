"""Operators that compare documents: line dedup, classifier, near-dedup, repeated strings, decontamination, pipeline."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import decontamination, line_dedup, near_dedup, quality_classifier, quality_rules, suffix_dedup
from plinth.llm import queries as registered
from tests.llm.conftest import SCHEMA, WORDS, hard_rows, sentence
from tests.oracle import assert_same, views


@pytest.mark.parametrize("name", sorted(registered.ORACLE))
def test_against_sql(spark, sf_dir, name):
    assert_same(registered.QUERIES[name](spark, sf_dir), views(sf_dir), registered.ORACLE[name])


def brute_lines(rows):
    docs = sorted({(-1 << 63 if i is None else i, t or "") for i, t, *_ in rows}, key=lambda x: x[0])
    at = defaultdict(list)
    for i, t in docs:
        own = [(n, x.strip(" ")) for n, x in enumerate(t.split("\n")) if x.strip(" ")] if t else []
        for k in range(len(own) - 2):
            at[tuple(x for _, x in own[k : k + 3])].append((i, t, own[k][0], own[k + 2][0]))
    gone = defaultdict(set)
    for places in at.values():
        for i, t, a, b in places[1:]:
            gone[i, t] |= set(range(a, b + 1))
    return {k: len(v) for k, v in gone.items()}


def test_line_dedup_of_hard_texts(hard, empty):
    got = line_dedup.dedup(hard).select("doc_id", "row", "kept", "n_lines", "n_removed").collect()
    assert len(got) == len(hard_rows())
    want = brute_lines([r for r in hard_rows() if r[0] != 3])
    for r in got:
        if r.doc_id != 3:
            assert r.n_removed == want.get((-1 << 63 if r.doc_id is None else r.doc_id, r.row.text or ""), 0)
    cleaned = line_dedup.clean(hard)
    assert cleaned.columns == hard.columns and cleaned.filter("t_norm = 'own norm'").count() > 0
    assert line_dedup.dedup(empty).count() == 0


def test_join_by_count_is_a_join(spark):
    from plinth.llm.common import FREQUENT, joined_by_count

    rows = spark.range(3 * FREQUENT).select((F.col("id") % 3).alias("hot"), F.col("id").alias("x")).select(F.when(F.col("hot") == 0, F.col("x")).otherwise(F.col("hot") - 10).alias("k"), "x")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("first")).filter("k <> 3")
    got = joined_by_count(rows, keyed, ["k"], "n", rows.count())
    assert keyed.filter(F.col("n") * FREQUENT >= rows.count()).count() == 2
    assert sorted(map(tuple, got.select("k", "x", "first").collect())) == sorted(map(tuple, rows.join(keyed, "k").select("k", "x", "first").collect()))


def test_repeated_strings_against_brute_force(spark, hard, empty):
    rng = random.Random(2)
    block = sentence(rng, 30)
    rows = [(i, t) for i, t, *_ in hard_rows() if i is not None] + [(100 + i, sentence(rng, rng.randrange(40)) + block[rng.randrange(40) :] + sentence(rng, 5)) for i in range(30)]
    for length in (40, 64, 200):
        data = [(i, (t or "").encode()) for i, t in rows]
        seen = Counter(t[s : s + length] for _, t in data for s in range(len(t) - length + 1))
        want = []
        for i, t in data:
            gone = np.zeros(len(t), bool)
            for s in range(len(t) - length + 1):
                if seen[t[s : s + length]] > 1:
                    gone[s : s + length] = True
            want.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for chunk_bytes, parts in ((3000, 3), (300, 1), (10**6, 2)):  # 300: most documents are cut into pieces
            found = suffix_dedup.repeats(df, length, chunk_bytes, parts).collect()
            got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found]
            assert sorted(got) == sorted(want), (length, chunk_bytes)
    assert suffix_dedup.repeats(empty).count() == 0
    assert suffix_dedup.repeats(hard).count() == len(hard_rows())


def test_levels_merge_geometrically():
    rng = np.random.default_rng(0)
    family, times, prints = suffix_dedup.Levels(), Counter(), defaultdict(set)
    for turn in range(40):
        key = rng.integers(0, 900, 50).astype(np.uint64)
        text = key * np.uint64(7) + (rng.random(50) < 0.02).astype(np.uint64)
        counts = rng.random(50) < 0.8
        run, place = suffix_dedup.entries(key, text, counts)
        assert (run[0][place] == key).all()
        family.add(run)
        times.update(key[counts].tolist())
        for k, t in zip(key.tolist(), text.tolist()):
            prints[k].add(t)
        if turn % 7 == 0:  # a family that was written and read again goes on as it was
            family = suffix_dedup.Levels([suffix_dedup.unpacked_run(**suffix_dedup.packed_run(r)) for r in family.runs])
        sizes = [len(r[0]) for r in family.runs]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        keys = np.array(sorted(prints), np.uint64)  # at any time, with no closing merge
        want = [suffix_dedup.SEVERAL if len(prints[k]) > 1 else min(times[k], 2) for k in keys.tolist()]
        assert family.known(keys).tolist() == want
    assert len(family.runs) > 1


def test_a_new_batch_meets_the_written_family(spark):
    """The second batch's runs are scanned against the table that the first one left."""
    rng = random.Random(3)
    shared, width = sentence(rng, 80), 4
    docs = spark.createDataFrame([(i, sentence(rng, 30) + (shared if i % 9 == 0 else "")) for i in range(40)], "doc_id long, text string").coalesce(1)
    runs = suffix_dedup.dealt(suffix_dedup.materialise(suffix_dedup.chunked(docs, 200, 2000, 2)), width)
    family = suffix_dedup.materialise(suffix_dedup.added(runs.filter("part = 0"), None))
    grown = suffix_dedup.materialise(suffix_dedup.added(runs.filter("part = 1"), family))
    of = lambda rows: {s: suffix_dedup.Levels(list(suffix_dedup.runs_of(p))) for s, p in rows.toPandas().groupby("shard")}
    one, two, want = of(family), of(grown), of(suffix_dedup.added(runs, None))
    assert sum(len(r[0]) for x in one.values() for r in x.runs) < sum(len(r[0]) for x in two.values() for r in x.runs)
    for shard, found in two.items():
        keys = np.unique(np.concatenate([r[0] for r in want[shard].runs]))
        assert (found.known(keys) == want[shard].known(keys)).all() and (found.known(keys) > 0).all()
    suffix_dedup.discard(family)


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_rows():
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = sentence(rng, 120).split()
        for _ in range(1 + g % 5):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(copy)))
    hot = sentence(rng, 80)
    rows += [(200 + i, hot + " " + sentence(rng, 120)) for i in range(25)]  # share a passage, but are not alike
    return rows


def test_groups_against_brute_force(spark):
    rows = near_rows()
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.k_id: r.group.id for r in near_dedup.groups(docs).collect()}
    assert got == root
    assert sorted(r.doc_id for r in near_dedup.clean(docs).collect()) == sorted(set(root.values()))


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    pool = near_dedup.mixed(rng.integers(1, 2**63, 400).astype(np.uint64))
    wa, wb = rng.integers(0, 6, 400), rng.integers(0, 6, 400)
    a, b = np.repeat(pool, wa), np.repeat(pool, wb)
    sig, _ = near_dedup.signatures([a, b, a], 4000)
    x, y = wa / wa.sum(), wb / wb.sum()
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(400) if x[i] and y[i])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and (sig[0] == sig[2]).all()


def test_repeated_lines_do_not_hide_a_copy(spark):
    rng = random.Random(12)
    rows = []
    for g in range(6):
        base, line = sentence(rng, 304), sentence(rng, 12)
        rows += [(2 * g, base), (2 * g + 1, base + ("\n" + line) * 30)]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert len(a & b) > 0.9 * len(a | b)
    got = {r.k_id: r.group.id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def variants_of_one_base(n, seed=21):
    """A base, and n variants of it: each is similar to the base at 0.8 and more, and hardly any two are to each other."""
    rng = random.Random(seed)
    base = sentence(rng, 400).split()
    rows = [(n, " ".join(base))]
    for i in range(n):
        copy = list(base)
        for part in range(0, 399, 57):
            copy[part + rng.randrange(5, 52)] = f"own{i}x{part}"
        rows.append((i, " ".join(copy)))
    return rows


def test_variants_of_one_base_are_one_group(spark):
    rows = variants_of_one_base(1000)
    sets = [shingles(t) for _, t in rows]
    jaccard = lambda x, y: len(x & y) / len(x | y)
    assert all(jaccard(sets[0], s) >= 0.8 for s in sets[1:]) and np.mean([jaccard(sets[i], sets[i + 1]) < 0.8 for i in range(1, 1000)]) > 0.7
    got = Counter(r.group.id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got[0] >= 998  # 20 bands of 5 registers miss a pair at 0.84 now and then


def test_blocks_hold_every_pair_not_connected_yet(spark):
    row = lambda x: (x, 0)
    rows = [(0, 7, row(i)) for i in range(60)] + [(0, 8, row(i)) for i in range(3)] + [(0, 9, row(i)) for i in (50, 51)]
    roots = [(row(i), row(0)) for i in range(45)] + [(row(i), row(50)) for i in range(50, 54)]
    key = "struct<id: long, text: long>"
    sized = [(*r, 100) for r in rows]
    found = near_dedup.blocks(spark.createDataFrame(sized, f"band int, key long, n {key}, of long"), spark.createDataFrame(roots, f"n {key}, root {key}"), 800).collect()
    held = defaultdict(list)
    for r in found:
        held[r.band, r.key, r.i, r.j].append(r)
    met = {frozenset((x.n.id, y.n.id)) for (_, _, i, j), m in held.items() for x in m for y in m if x.root != y.root and (x.c, y.c) == (i, j)}
    root = {n[0]: r[0] for n, r in roots}
    assert met == {frozenset((i, j)) for i in range(60) for j in range(i) if root.get(i, i) != root.get(j, j)}
    assert {k[1] for k in held} == {7}
    assert max(map(len, held.values())) < 40


@pytest.mark.parametrize("same", [True, False])
def test_blocks_connect_all_that_is_similar(same):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, (4, 40))
    sets = [np.unique(np.where(rng.random(40) < 0.12, rng.integers(0, 2**62, 40), base[i % 4])) for i in range(30)]
    ids = np.array([(i % 2 * (not same), i // 2 if i < 8 else i, 0) for i in range(30)])
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    meet = [(i, j) for i in range(30) for j in range(i) if same or ids[i, 0] != ids[j, 0]]

    def labels(links):
        out = {i: int(ids[i, 1]) + 100 for i in range(30)}
        for i, j in links:
            a, b = out[i], out[j]
            out = {k: min(a, b) if v in (a, b) else v for k, v in out.items()}
        return out

    found = near_dedup.connecting(ids, sets, same, 0, 0.8)
    assert all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in found) and len(found) < 30
    assert labels(found) == labels([(i, j) for i, j in meet if jaccard(sets[i], sets[j]) >= 0.8])


def test_links_of_the_test_table(spark):
    """Of all links at the threshold in sf0.01, by an inverted index of all shingles, none is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect() if r.text}
    texts = {r.doc_id: " ".join(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in docs.collect()}
    at, pairs = defaultdict(list), set()
    for i, s in sorted(sets.items()):
        for x in s:
            pairs |= {(j, i) for j in at[x]}
            at[x].append(i)
    links = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = {r.k_id: r.group.id for r in near_dedup.groups(docs).collect()}
    assert len(links) > 50 and all(group[i] == group[j] for i, j in links)
    assert sum(texts[i] != texts[j] for i, j in links) > 10


def test_a_kept_document_that_is_repeated_is_kept_once(spark):
    text = sentence(random.Random(8), 50)
    rows = [(1, text, "a")] * 5 + [(1, text, "b"), (2, text, "a"), (3, None, "a"), (3, None, "a"), (3, "", "a"), (None, "!", None), (None, "!", None), (4, "other words", "a")]
    left = near_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert left.columns == ["doc_id", "text", "lang"]
    assert Counter(map(tuple, left.collect())) == Counter([(1, text, "a"), (3, None, "a"), (3, "", "a"), (None, "!", None), (4, "other words", "a")])


def test_near_dedup_of_hard_texts(hard, empty):
    left = near_dedup.clean(hard)
    assert left.columns == hard.columns
    kept = [r.doc_id for r in left.collect()]
    assert 6 in kept and 7 not in kept and 16 not in kept and {0, 1, 2, 5} <= set(kept)
    assert near_dedup.clean(empty).count() == 0


def brute_hits(text, items, size=10):
    """n_words, n_hit, n_items, items_sha256 of a text, word by word."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = cut(text), set(), set()
    for item, t in items:
        own = cut(t)
        n = min(len(own), size)
        if n:
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids.add(item)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force_on_all_paths(spark, hard, empty):
    rng = random.Random(4)
    texts = [t for _, t, *_ in hard_rows()]
    items = [(1, sentence(rng, 25)), (2, "two words"), (3, None), (4, "!!!"), (5, texts[6]), (5, texts[6]), (None, sentence(rng, 11)), (6, "One"), (7, "no id here"), (None, texts[15][:400]), (None, "é"), (8, "the same ten words " * 300), (9, texts[18])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str(tuple(brute_hits(t, items))) for t in texts)
    for most in ({}, {"most_windows": 0}, {"most_windows": 0, "most_hashes": 0}):
        got = decontamination.decontaminate(hard, bench, **most).select("hit.*").collect()
        assert sorted(str(tuple(r)) for r in got) == want, most
    assert sum("True" in x for x in want) >= 6
    none = decontamination.decontaminate(hard, bench.limit(0))
    assert none.filter("hit.contaminated").count() == 0 and none.count() == len(hard_rows())
    left = decontamination.clean(hard, bench)
    assert left.columns == hard.columns and left.filter("t_norm = 'own norm'").count() > 0
    assert decontamination.decontaminate(empty, bench).count() == 0


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney trigrams from the definition: P(w | u, v) as a function, and the set of words."""
    c3 = Counter(t for x in texts for t in zip(["<s>", "<s>", *x], ["<s>", *x], [*x, "</s>"]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def discount(c):
        of = Counter(c.values())
        n1, n2, n3, n4 = (max(of[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = (0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return [min(max(x, lo), hi) for x, lo, hi in zip(d, (0, 0.05, 0.05, 0.05), (0, 0.95, 1.95, 2.95))]

    d3, d2, d1 = discount(c3), discount(c2), discount(c1)

    def level(c, d, history):
        own = {k: n for k, n in c.items() if k[:-1] == history}
        total = sum(own.values())
        return own, total, sum(d[min(n, 3)] for n in own.values()) / total if total else 1.0

    def p1(w):
        total = sum(c1.values())
        return (c1[w] - d1[min(c1[w], 3)]) / total + sum(d1[min(n, 3)] for n in c1.values()) / total / (len(c1) + 1)

    def p2(v, w):
        own, total, left = level(c2, d2, (v,))
        return p1(w) if not total else max(own.get((v, w), 0) - d2[min(own.get((v, w), 0), 3)], 0) / total + left * p1(w)

    def p3(u, v, w):
        own, total, left = level(c3, d3, (u, v))
        return p2(v, w) if not total else max(own.get((u, v, w), 0) - d3[min(own.get((u, v, w), 0), 3)], 0) / total + left * p2(v, w)

    return p3, set(c1)


@pytest.mark.parametrize("head", [0, 40, 10**6])
def test_perplexities_are_those_of_a_plain_model(spark, head):
    """By the broadcast head, by the shards, and by both; each document by the model of the fold that it is not in."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: [words[min(int(rng.expovariate(0.3)), 11)] for _ in range(n)]
    docs = {i: text(rng.randrange(1, 25)) for i in range(40)}
    docs |= {100 + i: [*text(3), "never", *text(4), "seen"] for i in range(4)}
    trusted = list(range(30))
    fold = lambda i: zlib.crc32(str(i).encode()) % 2
    models = [plain_kneser_ney([docs[i] for i in trusted if fold(i) == f]) for f in (0, 1)]
    for p, known in models:
        for h in (("<s>", "<s>"), ("w0", "w1"), ("w11", "never")):
            assert abs(sum(p(*h, w) for w in [*known, "an unknown word"]) - 1) < 1e-9
    df = spark.createDataFrame([(i, "en", i, " ".join(t)) for i, t in docs.items()], "doc_id long, lang string, k_text long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(35, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.score(df, labels, 1000, head).collect()}
    assert len(got) == len(docs)
    for i, t in docs.items():
        p, _ = models[1 - fold(i)]
        want = -sum(np.log(p(*x)) for x in zip(["<s>", "<s>", *t], ["<s>", *t], [*t, "</s>"])) / (len(t) + 1)
        assert got[i].n_words == len(t) and abs(got[i].log_ppl - want) < 1e-3


@pytest.mark.parametrize("width", [3, 16])
def test_all_labelled_documents_train(spark, width):
    """12,000 labelled good, and words that many shards share: the perplexities are those of a plain model of them all."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(15)]
    docs = {i: [words[min(int(rng.expovariate(0.4)), 14)] for _ in range(rng.randrange(1, 7))] for i in range(12_000)}
    docs |= {20_000 + i: [*docs[i], "never", "w0", "w1"] for i in range(3)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 2
    models = [plain_kneser_ney([t for i, t in docs.items() if i < 12_000 and fold(i) == f])[0] for f in (0, 1)]
    df = spark.createDataFrame([(i, "en", " ".join(t)) for i, t in docs.items()], "doc_id long, lang string, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(12_000)], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = {r.doc_id: r for r in quality_classifier.classify(df, labels).filter("doc_id % 1000 < 3").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 39
    for i, r in got.items():
        t, p = docs[i], models[1 - fold(i)]
        want = -sum(np.log(p(*x)) for x in zip(["<s>", "<s>", *t], ["<s>", *t], [*t, "</s>"])) / (len(t) + 1)
        assert r.n_words == len(t) and abs(r.log_ppl - want) < 2e-4


def test_repeated_trusted_rows_train_once(spark):
    rng = random.Random(7)
    rows = [(i, "en", i, sentence(rng, 30)) for i in range(20)]
    schema, labels = "doc_id long, lang string, k_text long, text string", spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    once, often = (quality_classifier.score(spark.createDataFrame(r, schema), labels, 100, 10).select("doc_id", "log_ppl").distinct() for r in (rows, rows + rows[:5] * 20))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, often.collect()))


def test_words_are_split_and_hashed_by_columns():
    """Words are those of str.split(), and a word has one hash wherever it stands; 27 million words took 33 s when each was looked up by itself."""
    import pyarrow as pa

    rng, signs = random.Random(4), [*"ab é日😀\n\t\x00\x1c\x85\xa0   　​᠎", "ab", "xyz "]
    texts = [None, "", *("".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)), None, "x" * 40_000 + " y　" + "x" * 40_000, "x" * 32_768 + " " + "x" * 32_769, "z", ""]
    seen: dict[str, int] = {}
    for some in (pa.array(texts), pa.array(texts, pa.large_string()).slice(5, 900), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        found = quality_classifier.Words()(some)
        assert len(found) == len(some)
        for text, hashes in zip(some.to_pylist(), found):
            words = (text or "").split()
            assert len(words) == len(hashes) and all(seen.setdefault(w, int(h)) == h >= quality_classifier.CODES for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen)
    coded = quality_classifier.Words({seen["z"]: 5})(pa.array(["z a z"]))
    assert coded[0].tolist() == [5, seen["a"], 5]


def test_bitmaps_come_to_the_driver_as_arrow(spark, monkeypatch):
    """Rows would be held several times in the driver: as results, rows and pickles."""
    ids = spark.range(5000)
    monkeypatch.setattr(type(ids), "collect", None)
    bits = quality_classifier.map_of_ids(ids)
    assert quality_classifier.has(bits, quality_classifier.key_of_id(np.arange(5000))).all()
    assert quality_classifier.has(bits, quality_classifier.key_of_id(np.arange(10_000, 20_000))).mean() < 0.01


def test_a_chunk_needs_little_memory():
    """All n-grams are asked for: memory by token, as two tasks and idle workers share an executor."""
    import tracemalloc

    rng = np.random.default_rng(3)
    chunk = quality_classifier.Chunk(0, quality_classifier.Layout(16, []), (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.full(quality_classifier.MAP_BITS // 8, 255, np.uint8)))
    for _ in range(200):
        chunk.add(rng.integers(70_000, 100_000, 1000).astype(np.uint32), 6000)
    tracemalloc.start()
    try:
        rows = list(chunk.scored()[1])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rows) == 16 and most < 200 * 200_000


def test_shards_ask_in_fewer_ways_than_shards():
    """The rows that shards send each other grow less than with the square of their number."""
    plan = quality_classifier.Layout(400, [])
    rows = sum(b.num_rows for b in quality_classifier.asks(5, np.arange(100_000, dtype=np.uint64), np.ones(100_000, np.int64), plan.ways))
    assert rows == plan.ways == 80


def test_release_removes_the_last_shuffle(spark):
    import time

    from plinth.llm import common

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    common.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() - before
    common.release(spark)
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**48, 500).astype(np.uint64))
    assert (quality_classifier.expand(quality_classifier.squeeze(keys)) == keys).all()
    assert len(quality_classifier.expand(quality_classifier.squeeze(keys[:0]))) == 0


def test_classifier_rejects_junk_and_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0 and r.toxic == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) > 20


def test_classifier_of_hard_texts(spark, hard, empty):
    labels = spark.createDataFrame([(6, 1, 0), (15, 1, 0), (None, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = quality_classifier.classify(hard, given).collect()
        assert len(got) == len(hard_rows()) and all(not r.kept for r in got if r.log_ppl is None)
        assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), len((t or "").split())) for i, t, *_ in hard_rows())
        assert all(r.n_words or not r.kept for r in got)
    assert all(r.kept == (r.n_words > 0) for r in got)  # nothing is trusted: all that has words stays
    assert quality_classifier.clean(hard, labels).columns == hard.columns
    assert quality_classifier.classify(empty, labels).count() == 0


def test_scope_leaves_nothing_behind(spark, tmp_path):
    from plinth.llm import common

    kept = None
    with common.scope(spark):
        folder = common.SCOPES[-1].removeprefix("file://")
        inner = common.materialise(spark.range(5))
        kept = common.materialise(inner.filter("id > 1"), outside=True)
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 3
    common.discard(kept)
    assert not os.path.exists(kept.written_to.removeprefix("file://"))


def test_pipeline(spark, sf_dir, hard):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-dedup", "benchmark decontamination", "packing"]
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = quality_classifier.materialise(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, hard, sf_dir).columns == hard.columns


def test_pipeline_learns_from_all_labelled_documents(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    whole, seen = quality_classifier.trusted_ids, []
    monkeypatch.setattr(quality_classifier, "trusted_ids", lambda *given: seen.append(whole(*given).count()) or whole(*given))
    spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, "some words of a text", "en") for i in range(4)], "doc_id long, text string, lang string")
    assert corpus_pipeline.classify_quality(spark, docs, str(tmp_path)).count() == 4
    assert seen == [12_000]
