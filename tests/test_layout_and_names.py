"""Names that are alike, and things found on pages, against brute force."""

import random

from pyspark.sql import functions as F

from plinth.operators import layout, similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_pairs_are_all_pairs_and_candidates_few(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    left = [(rng.randrange(3), word(rng.randrange(0, 12))) for _ in range(150)] + [(1, None), (1, ""), (1, "a"), (0, "common start " + word(6))]
    right = [(b, n[:3] + n[4:] + "x" if n and i % 2 else n) for i, (b, n) in enumerate(left)] + [(1, "ab"), (2, "zz"), (0, "common start " + word(6))]
    s, t = spark.createDataFrame(left, "block int, name string"), spark.createDataFrame(right, "block int, other string")
    for most in (0.0, 0.1, 0.25, 0.5, 0.8):
        want = {(b, x, y) for b, x in left for c, y in right if b == c and x is not None and y is not None and distance(x, y) / max(len(x), len(y), 1) <= most + 1e-12}
        got = similar.pairs(s, t, "block", "name", "other", most).collect()
        assert {(r.block, r.name, r.other) for r in got} == want and len(got) == len(want)
    names = [(0, f"{rng.getrandbits(60):015x} of the common kind") for _ in range(400)]
    a, b = spark.createDataFrame(names, "block int, name string"), spark.createDataFrame([(0, n[:4] + "_" + n[5:]) for _, n in names], "block int, other string")
    assert 400 <= similar.candidates(a, b, "block", "name", "other", 0.1, 4).count() < 2400  # of 160,000 pairs


def test_thinning_is_the_greedy_choice(spark):
    rng = random.Random(6)
    hits = [(p, float(rng.randrange(200)), float(rng.randrange(40)), rng.randrange(50), i) for i, p in enumerate(rng.choices("ab", k=160))]
    kept = []
    for h in sorted(hits, key=lambda h: (-h[3], h[4])):
        if not any(k[0] == h[0] and abs(k[1] - h[1]) <= 35 and abs(k[2] - h[2]) <= 5 for k in kept):
            kept.append(h)
    df = spark.createDataFrame(hits, "page string, x double, y double, confidence int, id int")
    got = layout.thinned(df, "page", F.col("x"), F.col("y"), [-F.col("confidence"), F.col("id")], (35.0, 5.0)).collect()
    assert sorted(r.id for r in got) == sorted(k[4] for k in kept) and len(kept) < 60
    assert layout.thinned(df.limit(0), "page", F.col("x"), F.col("y"), [F.col("id")], (1.0, 1.0)).count() == 0


def test_stable_run_takes_the_longest_then_the_first(spark):
    rows = [("i", y) for y in (0, 1, 5, 9, 10, 30, 34, 38, 60)] + [("j", 3)]
    lines = layout.lines_of(spark.createDataFrame(rows, "image string, y int"), ["image"], "y")
    got = layout.stable_run(lines, ["image"], (3, 5), 2).collect()
    assert [(r.image, r.y0, r.y1, r.lines) for r in got] == [("i", 0, 10, 3)]


def test_votes(spark):
    rows = [("a", 1, 50.0), ("a", 1, 70.0), ("a", 2, 99.0), ("b", 5, 85.0), ("b", 6, 40.0), ("c", 5, 85.0), ("c", 6, 60.0), ("d", 7, 20.0)]
    got = layout.decided(spark.createDataFrame(rows, "k string, v int, c double"), "k", "v", "c", 80, 50).collect()
    assert {r.k: (r.v, r.c if hasattr(r, "c") else r.confidence, r.decision) for r in got} == {"a": (1, 60.0, "consensus"), "b": (5, 85.0, "dominance"), "c": (None, None, "weak or conflicting"), "d": (None, None, "weak or conflicting")}


def test_best_triples_are_those_of_all(spark):
    rng = random.Random(8)
    rows = [("p", rng.randrange(2), rng.randrange(300), rng.randrange(3), float(rng.randrange(20))) for _ in range(90)]
    best = max((a[4] + b[4] + c[4], -b[1], -a[2], -b[2], -c[2]) for b in rows for a in rows for c in rows if (a[3], b[3], c[3]) == (0, 1, 2) and a[1] == b[1] == c[1] and a[2] <= b[2] - 10 and b[2] + 10 <= c[2] <= b[2] + 60)
    r = layout.best_triples(spark.createDataFrame(rows, "page string, line int, x int, field int, score double"), "page", 10, (10, 60)).first()
    assert (r.score, -r.line, -r.x0, -r.x1, -r.x2) == best
