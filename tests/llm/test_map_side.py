"""Operators that work document by document: token counts, packing, HTML, language, quality rules."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plinth.llm import html_extraction, language_id, packing, quality_rules, token_counts
from plinth.llm.common import PieceCache
from tests.llm.conftest import hard_rows

CLIP, BYTES, PIECES = (str(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_token_counts_are_the_librarys(hard):
    tok = Tokenizer.from_file(CLIP)
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in hard_rows())
    got = token_counts.token_counts(hard, CLIP, sample_docs=5, entries=20, cache_entries=30).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_token_counts_of_nothing(empty):
    assert token_counts.token_counts(empty, CLIP).count() == 0


def test_cache_forgets_single_words_only():
    c = PieceCache(lambda ws: [len(w) for w in ws], {"base": 4}, most=6)
    c.learn(["a", "bb"])
    c.learn(["a", "ccc"])
    c.learn(["dddd", "eeeee", "ffffff"])
    assert c["a"] == 1 and c["base"] == 4 and "bb" not in c and c["ffffff"] == 6


def test_packing_is_a_partition_of_all_ids(hard):
    tok = Tokenizer.from_file(BYTES)
    got = packing.pack(hard, BYTES, capacity=64, cache_entries=50).collect()
    by_seq, total = defaultdict(list), Counter()
    ids = defaultdict(list)
    for i, t, *_ in hard_rows():
        ids[i].append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert total == {i: sum(map(len, x)) for i, x in ids.items()}
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    padding = sum(0 if n & (n - 1) == 0 else 64 - n for n in (sum(x for _, x in p) for p in by_seq.values()))
    assert padding < 0.1 * sum(total.values())


def test_whole_documents_stay_in_one_piece(hard):
    cut, whole = (packing.pack(hard, BYTES, whole=w).collect() for w in (False, True))
    assert sum(r.length for r in cut) == sum(r.length for r in whole)
    for rows in (cut, whole):
        by_seq = defaultdict(list)
        for r in rows:
            by_seq[r.sequence_id].append((r.offset, r.length))
        assert all(sum(n for _, n in x) <= 1024 and sorted(x)[0][0] == 0 for x in by_seq.values())
    assert len(whole) < len(cut) and all(r.start % 1024 == 0 and r.length == min(1024, r.doc_tokens - r.start) for r in whole)


def test_cuts_fill_classes():
    for n in (1, 63, 64, 1023, 1024, 1025, 5000):
        cuts = packing.cuts(n, 1024)
        assert sum(c[1] for c in cuts) == n and all(k * length <= 1024 for _, length, k in cuts)
    assert packing.pack and packing.cuts(0, 1024) == []


def test_packing_nothing(empty):
    assert packing.pack(empty, BYTES).count() == 0


PAGE = """<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><nav><a href=/a>Menu one</a></nav><header>Site</header><div class="side-bar ad">Buy</div>
<article><header><h1>Head &amp; more</h1></header><p>First  <b>bold</b>
line &mdash; done.<p>Second &lt;ok&gt; a < b.<br>same block<ul><li>item one is long enough</li><li>item two</li></ul><div id=comments><p>no comment</p></div><form>f</form></article>
<aside>x</aside><footer>&copy;</footer></body></html>"""


def test_html():
    assert html_extraction.main_text(PAGE) == "Head & more\nFirst bold line — done.\nSecond <ok> a < b. same block\nitem one is long enough\nitem two"
    plain = "<div>" + "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3)) + "</div><div><a href=1>x</a> <a href=2>y</a></div>"
    assert html_extraction.main_text(plain).count("word") == 90 and "x" not in html_extraction.main_text(plain)


def test_hints_are_noise_but_remove_nothing_by_themselves():
    prose = "".join(f"<p>{'prose of the page ' * 6}{i}</p>" for i in range(3))
    for name, gone in (("sidebar", True), ("left-sidebar", True), ("with-sidebar", False), ("has_comments", False), ("user-comments", True), ("header-ad", True), ("adventure", False), ("cookie-notice", True), ("content no-ads", False), ("tag-legal", False), ("content side-by-side", False), ("legal", True), ("comments-open", False)):
        for part in ("<p>a part beside the text</p>", "a part beside the text"):
            text = html_extraction.main_text(f"<body><div>{prose}<div class='{name}'>{part}</div></div></body>")
            assert ("a part beside" not in text) is gone and text.count("prose") == 18, name
    article = "<article><h1>T</h1><h2 id=legal>Legal</h2><p>one para</p><section id=legal-framework><p>framework</p></section><section id=related-work class=related>before<p>more</p></section><div class=notice>note well</div><div id=comments>reader</div><div class='ad'>buy</div></article>"
    assert html_extraction.main_text(article) == "T\nLegal\none para\nframework\nbefore\nmore\nnote well"
    form = f"<body><form><div class='post tag-legal'><h1>T</h1>{prose}<input value=x><select><option>o</select></div></form><nav><a href=/>home</a></nav></body>"
    assert html_extraction.main_text(form).count("prose") == 18 and "home" not in html_extraction.main_text(form) and html_extraction.main_text(form).startswith("T\n")


def neutral(html):
    """A page whose parts say nothing of their roles."""
    import re

    return re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", html).replace(' class="ad"', "")


def test_density_alone_finds_most_articles(spark, sf_dir, monkeypatch):
    from html import unescape
    import re

    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r.html]
    want = []
    for html in pages:
        parts = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", html, re.S)[1])
        parts = [" ".join(unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
        want.append("\n".join(p for p in parts if p))
    assert [html_extraction.main_text(x) for x in pages] == want
    alone = [html_extraction.main_text(neutral(x)) for x in pages]
    assert sum(x == y for x, y in zip(alone, want)) >= 0.9 * len(pages)  # else a page's article is too short for its sum to win
    right = html_extraction.densities
    monkeypatch.setattr(html_extraction, "densities", lambda tree: (*right(tree)[:3], *[[0.0] * len(tree.tag)] * 2))
    assert sum(html_extraction.main_text(neutral(x)) == y for x, y in zip(pages, want)) < 0.1 * len(pages)


def test_text_that_is_linked_or_named_like_noise_stays():
    long = "Some long text of the article which is long enough to count as text, with more words."
    page = f"""<body><nav><a>Home</a></nav><article><h1><a>The title</a></h1><p>{long}</p><p><a>See the full long report here</a></p><h2><a>Part two</a></h2><p>{long}</p>
      <h3>References</h3><ol><li><a>First source of it</a></li><li><a>Second source</a></li></ol><aside>He was the best, they said.</aside><p class='share'>The share price fell.</p>
      <div class='social'>He was a social worker in town.</div><div class='share'><a>Twitter</a> <a>Facebook</a></div><aside class='related'><a>Another page</a></aside><div class='comments'><p>I liked this.</p></div></article><footer>Copyright</footer></body>"""
    want = ["The title", long, "See the full long report here", "Part two", long, "References", "First source of it", "Second source", "He was the best, they said.", "The share price fell.", "He was a social worker in town."]
    assert html_extraction.main_text(page).split("\n") == want
    assert html_extraction.main_text(f"<body><div class=menu><a>Home</a><a>About</a></div><div><p>{long}</p><p><a>See the report</a></p><p>{long}</p></div></body>").split("\n") == [long, "See the report", long]
    for tag in ("section",):
        assert html_extraction.main_text(f"<body><{tag}><h2>One</h2><p>{long} {long}</p><p>{long}</p></{tag}><{tag}><h2>End</h2><p>A short close.</p></{tag}></body>").endswith("End\nA short close.")


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "text", "<div class='comments'>" * 60_000 + "text", "<b><div>" + "<i>" * 60_000 + "</b>" * 60_000, "<b>" * 60_000 + "<p>x" * 60_000, "<p class='ads'><b>" * 20_000, "<article><section>" + "<div>" * 60_000 + "deep"])
def test_deep_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    html_extraction.main_text(page)
    assert time.process_time() - began < 8


def brute_densities(html):
    """Composite densities and sums of a well-formed page, node by node, straight from the definition."""
    from xml.etree import ElementTree

    root, found = ElementTree.fromstring(html), []
    size = lambda s: len((s or "").replace(" ", ""))

    def walk(e, link):
        link = link or e.tag in ("a", "nav")
        c, lc, t, lt, kids = size(e.text), size(e.text) * link, 0, 0, []
        for k in e:
            x = walk(k, link)
            kids.append(x)
            c, lc, t, lt = c + x["c"] + size(k.tail), lc + x["lc"] + size(k.tail) * link, t + x["t"] + 1, lt + x["lt"] + (k.tag == "a" or link or k.tag == "nav")
        found.append(x := {"c": c, "lc": lc, "t": t, "lt": lt, "kids": kids})
        return x

    page = walk(root, False)
    for x in found:
        c, lc, t, lt = x["c"], x["lc"], max(x["t"], 1), max(x["lt"], 1)
        x["d"] = 0.0 if not c else c / t * np.log(max(c / max(lc, 1) * t / lt, 1.0000001)) / np.log(c / max(c - lc, 1) * lc + page["lc"] / max(page["c"], 1) * c + np.e)
    return sorted((x["c"], round(x["d"], 6), round(sum(k["d"] for k in x["kids"]), 6)) for x in found)


def test_densities_against_brute_force():
    rng = np.random.default_rng(4)

    def part(depth):
        tag = rng.choice(["div", "section", "a", "span", "b"] if depth else ["a", "b", "i"])
        inner = "".join(part(depth - 1) if rng.random() < 0.6 else " word" * rng.integers(1, 9) for _ in range(rng.integers(1, 5))) if depth else "text " * rng.integers(0, 5)
        return f"<{tag}>{inner}</{tag}>" if tag != "a" else f"<a>{'link ' * rng.integers(1, 4)}</a>"

    for _ in range(30):
        html = f"<body><nav><a>home</a>menu</nav>{''.join(part(3) for _ in range(4))}</body>"
        tree = html_extraction.Tree()
        tree.feed(html)
        chars, _, _, density, total = html_extraction.densities(tree)
        assert sorted((c, round(d, 6), round(s, 6)) for c, d, s in list(zip(chars, density, total))[1:]) == brute_densities(html)


def test_equal_sums_take_the_first_node():
    one = "<div><p>some words of equal length</p><p>some words of equal length</p></div>"
    assert html_extraction.main_text(f"<body><div>{one}</div><div>{one.replace('some', 'same')}</div></body>").startswith("some")


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<a href='", "<!-- ", "<script>", "</p></div>", "<div>" * 3000 + "deep", "text only", "<p>a" * 500])
def test_broken_html(html):
    assert isinstance(html_extraction.main_text(html), str)


def test_html_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, None, "", None)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.n_chars for r in got].count(0) == 2 and all(len(r.text) == r.n_chars for r in got) and len(got) == 4


def test_forward_sums_all_segmentations():
    pieces, longest = language_id.vocabulary(PIECES)
    p = np.random.default_rng(1).random(len(pieces) + 1)
    p /= p.sum()

    def brute(s):
        if not s:
            return 1.0
        return sum((p[pieces[s[:j]]] if s[:j] in pieces else p[-1] if j == 1 else 0.0) * brute(s[j:]) for j in range(1, len(s) + 1))

    scorer = language_id.Scorer({"aa": p, "bb": p[::-1].copy()}, PIECES)
    for w in ("the", "straße", "x", "naïve", "漢a"):
        assert np.isclose(scorer.word(w)[0], np.log(brute("▁" + w)))
    assert np.isfinite(scorer.word("ab" * 2000)).all()
    many = ["the", "x", "漢a", "straße", "ab" * 40, "the" * 9]
    assert np.allclose(scorer.batch(many), [scorer.word(w) for w in many])
    scorer.most = 4
    for words in (["the", "x"], ["the", "straße"], ["naïve", "a", "b"], ["the", "x"]):
        scorer.learn(words)
        assert np.allclose(scorer.rows[[scorer.index[w] for w in words]], [scorer.word(w) for w in words])


def test_pieces_found_by_hash_are_those_of_the_vocabulary():
    pieces, longest = language_id.vocabulary(PIECES)
    rng = np.random.default_rng(8)
    letters, some = list("aeiourstnlßé漢qz"), [p.lstrip("▁") for p in list(pieces)[::7]]
    words = {"".join(rng.choice(letters, n)) for n in rng.integers(1, 25, 300)} | {a + b for a, b in zip(some, some[::-1])}
    for n in {len(w) for w in words}:
        same = sorted(w for w in words if len(w) == n)
        want = [[pieces.get(m[i:j], len(pieces) + (j - i > 1)) for i, j in language_id.spans(n + 1, longest)] for m in ("▁" + w for w in same)]
        assert (language_id.numbers(same, n + 1, PIECES) == np.array(want)).all()


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs, language_id.train(docs, PIECES), PIECES).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_all_languages_are_learnt_from_and_predicted(spark):
    rng = np.random.default_rng(3)
    odd = {f"rare{i}": "".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for i in range(40)}
    rows = [(i, "common words here " * 3, f"l{i % 7}") for i in range(200)] + [(1000 * i + k, f"{w} {w}", lang) for i, (lang, w) in enumerate(odd.items(), 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, PIECES)
    assert set(model) == {f"l{i}" for i in range(7)} | set(odd)
    p = language_id.dense(model, PIECES)["l0"]
    assert len(model["l0"][0]) < 100 and abs(p[:-1].sum() - 1) < 1e-9 and p[-1] == language_id.UNKNOWN
    few = language_id.train(docs, PIECES, docs_per_lang=30, labelled_rows=47)
    assert set(few) == set(model)
    one, many = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model, PIECES, langs=n).collect()} for n in (256, 5))
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in many.items()} and all(abs(one[k][1] - many[k][1]) < 1e-9 for k in one)
    assert sum(one[k][0] == lang for k, _, lang in rows if k >= 1000) > 0.9 * 240


def test_learning_counts_every_segmentation(monkeypatch):
    words, counts = ["the", "straße", "naïve", "漢a", "ab" * 20, "x", "other"], [9, 2, 1, 3, 4, 1, 7]
    pieces, _ = language_id.vocabulary(PIECES)
    size = len(pieces)

    def cuts(s):
        if not s:
            yield []
        for j in range(1, len(s) + 1):
            if s[:j] in pieces or j == 1:
                yield from ([pieces.get(s[:j], size), *rest] for rest in cuts(s[j:]))

    p = np.append(np.full(size, 1 / size), language_id.UNKNOWN)
    for _ in range(2):
        expected = np.zeros(size + 1)
        for w, n in zip(words, counts):
            if len(w) > 20:
                continue
            found = [(c, p[c].prod()) for c in cuts("▁" + w)]
            whole = sum(x for _, x in found)
            for c, x in found:
                np.add.at(expected, c, n * x / whole)
        p = np.append((expected[:-1] + 0.01) / (expected[:-1].sum() + 0.01 * size), language_id.UNKNOWN)
    short = [(w, n) for w, n in zip(words, counts) if len(w) <= 20]
    assert np.allclose(language_id.fit(*map(list, zip(*short)), PIECES, 2), p, rtol=1e-9)
    together = language_id.fit(words, counts, PIECES)
    monkeypatch.setattr(language_id, "CHUNK", 2)
    assert np.allclose(language_id.fit(words, counts, PIECES), together, rtol=1e-9)
    monkeypatch.setattr(language_id, "LONG", 1)
    assert np.allclose(language_id.fit(words, counts, PIECES), together, rtol=1e-9)
    assert np.isfinite(language_id.fit(["ab" * 3000, "x"], [1, 1], PIECES)).all()


def test_language_of_hard_texts(hard, empty):
    model = language_id.train(hard, PIECES)
    got = language_id.identify(hard, model, PIECES).collect()
    assert len(got) == len(hard_rows()) and {r.lang_pred for r in got} <= {*model, "und"}
    texts = [t for _, t, *_ in hard_rows()]
    assert sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in t or "") for t in texts)
    assert language_id.train(empty, PIECES) == {}
    assert {r.lang_pred for r in language_id.identify(hard, {}, PIECES).collect()} == {"und"}


def brute_repeats(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)})


def test_quality_measures(hard, empty):
    import re

    for _, t, *_ in hard_rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, chars, symbols, lines, repeats = quality_rules.measures(t)
        assert (n, chars, symbols, repeats) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), brute_repeats([w.encode() for w in words]))
        own = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert lines == len(own) - len(set(own))
    got = quality_rules.quality_rules(hard).collect()
    assert len(got) == len(hard_rows()) and all(not r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0


def test_bad_hosts_are_rejected_and_few_failures_forgiven(spark):
    good = "all of these words differ from one another so that nothing here ever repeats itself at length"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, "bad", "awful") for i in range(80)] + [(2000, good, "awful"), (3000, "bad", "small"), (3001, good, "small")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and not got[2000].kept and got[2000].host_rejected and not got[2000].base_failed and got[3001].kept
