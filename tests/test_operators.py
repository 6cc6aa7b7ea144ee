"""Operators on small frames: ties, nulls, zero spread, single rows, empty input, and closed forms against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import geo, text
from plinth.operators import allocate, completeness, composite, export, gates, hierarchy, joins, rank, rules, stats, temporal


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_competition_rank_and_percentile(spark):
    df = frame(spark, [("m", 1, 5.0), ("m", 2, 5.0), ("m", 3, 1.0), ("m", 4, None)], "metric string, id int, value double")
    got = {r.id: (r.rank, r.percentile) for r in rank.ranked(df, ["metric"], "value").collect()}
    assert got.pop(3) == (3, pytest.approx(100 / 3)) and got == {1: (1, 100.0), 2: (1, 100.0), 4: (None, None)}


def test_peer_tiers_share_tied_cuts(spark):
    tier = lambda vs: [r.tier for r in rank.peer_tiers(frame(spark, [("a", i, v) for i, v in enumerate(vs)], "axis string, id int, v int"), ["axis"], "v").orderBy("id").collect()]
    assert tier([1]) == [1]
    assert tier([7, 7, 7, 7, 7]) == [1] * 5
    assert tier([1, 2, 3, 4, 5, 6, 7]) == [1, 1, 2, 2, 3, 3, 4]


def test_top_with_ties_keeps_the_cutoff(spark):
    df = frame(spark, [("g", i, v) for i, v in enumerate([9, 8, 7, 6, 5, 5, 4])], "g string, id int, v int")
    assert rank.top_with_ties(df, ["g"], "v", 5).count() == 6


def test_winsor_and_zero_span(spark):
    df = frame(spark, [("a", i, float(i)) for i in range(21)] + [("flat", i, 3.0) for i in range(4)], "m string, id int, v double")
    got = stats.winsorised(df, ["m"], "v", F.lit(True)).collect()
    a = [r.scaled for r in got if r.m == "a"]
    assert min(a) == 0 and max(a) == 100 and all(r.scaled is None for r in got if r.m == "flat")


def test_correlation_of_a_constant_is_null(spark):
    rows = [(i, m, v) for i in range(5) for m, v in (("x", i), ("y", 2 * i), ("c", 1))]
    got = {(r.a, r.b): r.r for r in stats.correlations(frame(spark, rows, "e int, m string, v int"), "e", "m", "v").collect()}
    assert got["c", "x"] is None and abs(got["x", "y"] - 1) < 1e-12


def test_small_groups(spark):
    df = frame(spark, [("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    assert tuples(df.groupBy("k").agg(stats.spread_or_null(F.col("v")).alias("s")), "k", "s") == [("a", None), ("b", 1.0)]
    assert tuples(stats.order_statistics(df, ["k"], "v", {"m": F.floor(F.col("n") / 2)}), "k", "m") == [("a", 1.0), ("b", 3.0)]


def test_majority_tie(spark):
    df = frame(spark, [(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert tuples(stats.majority(df, ["k"], "v"), "k", "winner", "clear") == [(1, "x", False), (2, "z", True)]


def test_supersession_chain(spark):
    df = frame(spark, [(1, None), (2, 1), (3, 2), (4, 99)], "id int, old int")
    assert [r.id for r in temporal.active(df, "id", "old").orderBy("id").collect()] == [3, 4]
    assert [r.id for r in temporal.revisions(df, "id", "old").orderBy("id").collect()] == [1, 2]


def test_best_breaks_ties_by_the_last_member(spark):
    df = frame(spark, [("k", 1, 5), ("k", 2, 5)], "k string, id int, v int")
    assert temporal.best(df, ["k"], [F.col("v"), F.col("id")]).first().id == 2
    assert temporal.best(df.limit(0), ["k"], [F.col("v")]).count() == 0


def test_lookback_falls_back_to_rows(spark):
    df = frame(spark, [("a", y) for y in (1990, 1995, 2000)] + [("b", y) for y in (1998, 1999, 2000)], "k string, y int")
    assert tuples(temporal.lookback(df, ["k"], "y", 2, 2), "k", "y") == [("a", 1995), ("a", 2000), ("b", 1998), ("b", 1999), ("b", 2000)]


def test_snapshots_and_upserts(spark):
    a, b = frame(spark, [(1, 5, "x"), (2, 6, "y")], "k int, v int, w string"), frame(spark, [(2, None, "z"), (3, 7, "q")], "k int, v int, w string")
    assert tuples(temporal.snapshot_diff(a, b, "k", "v"), "k", "state") == [(1, "gone"), (2, "changed"), (3, "new")]
    assert tuples(temporal.upsert(a, b, "k"), "k", "v", "w") == [(1, 5, "x"), (2, 6, "z"), (3, 7, "q")]
    assert tuples(temporal.insert_absent(a, b, ["k"]), "k", "w") == [(1, "x"), (2, "y"), (3, "q")]


def test_asof_takes_rows_of_the_same_instant(spark):
    left, right = frame(spark, [("u", 5, 1), ("u", 1, 2)], "u string, t int, id int"), frame(spark, [("u", 5, 50), ("u", 3, 30), ("u", 9, 90)], "u string, t int, v int")
    assert tuples(temporal.asof(left, right, ["u"], "t", "v"), "id", "asof") == [(1, 50), (2, None)]


@pytest.mark.parametrize("periods, want", [({"a": [2020, 2021], "b": [2021, 2022], "c": [2021]}, {("a", 2021, True), ("b", 2021, True), ("c", 2021, True)}), ({"a": [2020], "b": [2021]}, {("a", 2020, False), ("b", 2021, False)})])
def test_matched_period(spark, periods, want):
    df = frame(spark, [(k, y, y) for k, ys in periods.items() for y in ys], "k string, p int, v int")
    assert {tuple(r) for r in joins.matched_period(df, "k", "p", len(periods)).select("k", "p", "matched").collect()} == want


def test_resolution_is_one_to_one(spark):
    s = frame(spark, [(1, "A", 0), (2, "A", 0), (3, "B", 0), (4, "C", 1)], "id int, name string, g int")
    t = frame(spark, [(10, "A", 0), (11, "B", 0), (12, "D", 0)], "t_id int, name string, g int")
    got = joins.resolve(s, t, "id", [("name", ["name"])], (["g"], "id", "t_id"))
    assert tuples(got, "id", "t_id", "method") == [(1, 10, "residual"), (2, 12, "residual"), (3, 11, "name"), (4, None, "unmatched")]


def test_boxes_meet_once(spark):
    rng = random.Random(3)
    box = lambda i: (i, x := rng.randrange(60), y := rng.randrange(60), x + 1 + rng.randrange(25), y + 1 + rng.randrange(25))
    a, b = [box(i) for i in range(30)], [box(i) for i in range(30)]
    want = {(p[0], q[0]) for p, q in itertools.product(a, b) if min(p[3], q[3]) > max(p[1], q[1]) and min(p[4], q[4]) > max(p[2], q[2])}
    mk = lambda rows, p: frame(spark, rows, f"{p}id int, {p}x0 int, {p}y0 int, {p}x1 int, {p}y1 int")
    got = joins.box_overlap(mk(a, "a_"), mk(b, "b_"), 10).collect()
    assert len(got) == len(want) and {(r.a_id, r.b_id) for r in got} == want


def test_allocation_adds_up(spark):
    rng = random.Random(1)
    rows = [(p, c, 17 + p, rng.randrange(9) if p else 0) for p in range(6) for c in range(7)]
    got = allocate.largest_remainder(frame(spark, rows, "p int, c int, total long, w long"), ["p"], "c", "total", "w").collect()
    for p in range(6):
        mine = [r.allocated for r in got if r.p == p]
        assert sum(mine) == 17 + p if any(w for q, _, _, w in rows if q == p) else mine == [None] * 7


def test_tranche_closed_form_is_the_greedy_choice(spark):
    rng = random.Random(8)
    for _ in range(6):
        rows = [("b", f"f{rng.randrange(6)}", i) for i in range(25)]
        chosen, families = [], []
        for _, f, i in rows:
            if len(chosen) < 6 and (f in families or len(families) < 3):
                families += [] if f in families else [f]
                chosen.append(i)
        got = completeness.tranche(frame(spark, rows, "board string, family string, place int"), ["board"], "family", "place", 6, 3)
        assert sorted(r.place for r in got.collect()) == chosen


def test_gates_need_thresholds():
    with pytest.raises(ValueError):
        gates.within(F.lit(1), None)
    with pytest.raises(ValueError):
        gates.at_least(F.lit(1), None)


def test_zero_denominators_never_pass(spark):
    df = frame(spark, [(0, 0), (10, 10)], "parent long, children long")
    assert [r[0] for r in df.select(gates.within(gates.back_aggregation_bias(F.col("parent"), F.col("children")), 5)).collect()] == [False, True]


def test_weighted_rate_and_errors(spark):
    df = frame(spark, [(10.0, 75.0), (30.0, 25.0)], "r double, w double")
    assert df.agg(stats.weighted_rate(F.col("r"), F.col("w"))).first()[0] == 15
    e = frame(spark, [(1.0, 1.0), (2.0, 3.0), (0.0, 1.0)], "o double, p double").agg(*[c.alias(k) for k, c in stats.errors(F.col("o"), F.col("p")).items()]).first()
    assert abs(e.mae - 2 / 3) < 1e-12 and e.mape == 25


def test_islands_and_gaps(spark):
    df = frame(spark, [("a", n) for n in (1, 2, 3, 7, 8, 8, 12)], "k string, n long")
    assert tuples(rank.islands(df, ["k"], "n"), "first", "last", "length") == [(1, 3, 3), (12, 12, 1), (7, 8, 2)]
    assert [r.missing for r in rank.sequence_gaps(df, ["k"], "n").orderBy("missing").collect()] == [4, 5, 6, 9, 10, 11]


def test_trend_words(spark):
    df = frame(spark, [("up", y, y) for y in (1, 2)] + [("down", y, -y) for y in (1, 2)] + [("flat", y, 1) for y in (1, 2)] + [("one", 1, 1)], "k string, y int, v int")
    word = lambda hib: {r.k: r.direction for r in rank.trend(df, ["k"], "y", "v", hib).collect()}
    assert word(F.lit(False)) == {"up": "worsening", "down": "improving", "flat": "stable", "one": "single"}
    assert word(F.lit(None).cast("boolean")) == {"up": "rising", "down": "falling", "flat": "flat", "one": "single"}


def test_rules_find_the_injected_violations(spark):
    df = frame(spark, [(1, "a", None, 5.0, "ok"), (1, "b", "n", None, "copied"), (2, "zz", None, None, "ok")], "id int, code string, note string, value double, method string")
    parent = frame(spark, [("a",), ("b",)], "code string")
    found = rules.check([
        rules.Rule("key", "error", lambda: rules.unique(df, ["id"])),
        rules.Rule("fk", "error", lambda: rules.foreign_key(df, ["id"], "code", parent, "code")),
        rules.Rule("words", "error", lambda: rules.forbidden(df, ["id"], "method", ["copied"])),
        rules.Rule("note", "warning", lambda: rules.required_if(df, ["id"], F.col("code") == "a", "note")),
        rules.Rule("one", "error", lambda: rules.exactly_one(df, ["id"], "value", "note")),
        rules.Rule("holds", "error", lambda: rules.holds(df, ["id"], F.col("value") < 1, F.col("value"))),
        rules.Rule("enum", "error", lambda: rules.member(df, ["id"], "code", ["a", "b"])),
    ])
    assert tuples(found, "rule", "key") == [("enum", "2"), ("fk", "2"), ("holds", "1"), ("key", "1"), ("note", "1"), ("one", "2"), ("words", "1")]
    assert rules.capped(found.unionByName(found).unionByName(found), 2).filter("rule = 'fk'").select("suppressed").collect()[0][0] == 1


def test_ledger_branches_and_duplicates(spark):
    e, s = frame(spark, [(1,), (2,)], "e int"), frame(spark, [("a",), ("b",), ("c",)], "s string")
    cells, explicit = frame(spark, [(1, "a", 9)], "e int, s string, value int"), frame(spark, [(1, "a", "held", "why"), (1, "b", "held", "why")], "e int, s string, state string, reason string")
    got = completeness.ledger(e, s, cells, explicit, ["e", "s"], [(F.col("s") == "c", "not applicable", "structure")])
    assert tuples(got, "e", "s", "status") == [(1, "a", "value"), (1, "b", "held"), (1, "c", "not applicable"), (2, "a", "unavailable"), (2, "b", "unavailable"), (2, "c", "not applicable")]
    assert completeness.duplicates(explicit.unionByName(explicit.limit(1)), ["e", "s"]).count() == 1


def test_pillars_need_all_parts(spark):
    df = frame(spark, [(1, 120.0, 50.0), (2, None, 50.0)], "id int, a double, b double")
    assert tuples(composite.pillars(df, ["a", "b"]), "id", "score", "missing") == [(1, 75.0, []), (2, None, ["a"])]


def test_ancestors_and_spread(spark):
    tree = frame(spark, [("b", "a"), ("c", "b"), ("d", "c")], "n string, p string")
    assert tuples(hierarchy.ancestors(tree, "n", "p", 3).filter("n = 'd'"), "ancestor", "distance") == [("a", 3), ("b", 2), ("c", 1)]
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert tuples(hierarchy.spread(edges, "a", 4), "node", "steps") == [("a", 0), ("b", 1), ("c", 1)]


def test_symmetry(spark):
    got = joins.asymmetric(frame(spark, [(1, 2), (2, 1), (3, 3), (4, 5)], "a int, b int"), "a", "b")
    assert tuples(got, "a", "b", "problem") == [(3, 3, "self"), (4, 5, "one-way")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.uuid5(F.lit("unit:persons"), "c9a6f7b2-3e1d-4a8f-9c2b-5d7e1f4a8b3c")) == "3add048e-c42d-5b05-994c-dad9c6812cc4"
    assert [one(text.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 111)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th"]
    assert [one(text.clean_number(F.lit(x))) for x in ("1,234", "(5)", "-", "#N/A", "12%", "", "–")] == [1234, -5, None, None, 12, None, None]
    assert one(text.normalise_name(F.lit("  Murang'a & Co/Ltd "))) == "muranga and co ltd"
    assert one(text.canonical_url(F.lit("http://a/b?z=1&a=2#top"))) == "http://a/b?a=2&z=1"
    assert one(text.fiscal_year(F.lit("2024-06-30").cast("date"))) == "2023/24" and one(text.fiscal_year(F.lit("2024-07-01").cast("date"))) == "2024/25"
    assert [one(text.search_score(F.lit("x small ring"), F.lit(lab), "ring")) for lab in ("ring", "ring two", "big ring", "x", "spring")] == [120, 95, 72, 50, 50]
    assert one(text.label_score(F.lit("Homa Bay"), F.lit("homa-bay"))) == 100


def test_vectorised_functions(spark):
    from plinth.functions.vectorised import fold_accents, sequence_ratio

    row = frame(spark, [("Élan", "abcd", "bcde"), (None, None, "x")], "a string, b string, c string").select(fold_accents("a").alias("f"), sequence_ratio("b", "c").alias("r")).collect()
    assert row[0].f == "Elan" and row[0].r == 0.75 and row[1].f is None and row[1].r is None


def test_geometry(spark):
    square = F.array(*[F.array(*map(F.lit, map(float, p))) for p in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    hole = F.array(*[F.array(*map(F.lit, map(float, p))) for p in ((1, 1), (2, 1), (2, 2), (1, 2))])
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(geo.ring_area(square)) == 16 and one(geo.polygon_area(F.array(square, hole))) == 15
    assert one(geo.contains(square, F.lit(1.5), F.lit(3.0))) and not one(geo.contains(square, F.lit(5.0), F.lit(3.0)))
    assert tuple(one(geo.bounds(square))) == (0, 0, 4, 4)


def test_fingerprint_ignores_order(spark):
    df = frame(spark, [(i, None if i % 3 else "x") for i in range(20)], "a int, b string")
    assert export.fingerprint(df, ["a", "b"]).collect() == export.fingerprint(df.orderBy(F.desc("a")).repartition(3), ["a", "b"]).collect()
    assert export.fingerprint(df, ["a", "b"]).collect() != export.fingerprint(df.fillna({"b": ""}), ["a", "b"]).collect()


def test_lanes_cover_all_orders(spark):
    from plinth.plans import catalogue

    sf_dir = "/root/testdata/sf0.01"  # the smaller table has no customer from 200 on
    got = catalogue.QUERIES["q_lanes"](spark, sf_dir).collect()
    assert sorted(r.o_orderkey for r in got) == sorted(r.o_orderkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect())
    ends = {}
    for r in sorted(got, key=lambda r: (r.o_custkey, r.start, r.o_orderkey)):
        mine = ends.setdefault(r.o_custkey, [])
        at = next((i for i, e in enumerate(mine) if e < r.start), len(mine))
        mine[at : at + 1] = [r.end]
        assert r.lane == at
