"""Source divergence, whitening and HTML extraction."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import divergence, frames, mincut, radix, whitening
from ridgeline.llm.dom import blocks

FOLD = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, g string, value long, item string, rank int, n long, term string, base long"


def brute_audit(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(FOLD))
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: counts[lang, s] for x, s in counts if x == lang}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("limits", [False, True])
def test_divergence_against_brute_force(spark, monkeypatch, limits):
    if limits:  # every join shuffled and salted, partial counts handed on early
        monkeypatch.setattr(frames, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(frames, "HOT_ROWS", 5)
        monkeypatch.setattr(divergence, "HELD", 50)
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Être", "ÊTRE", "ß", "日本", "A", "\U0001f600"]
    rows = [(None, None, None), ("", "en", "x"), ("1 2 3", "none", "a"), ("once", "none", "b"), (" ".join(words), None, "s1"), (" ".join(words * 3), None, "s1"), (" ".join(words), "", None)]
    for _ in range(150):
        lang = r.choice(["en", "de", None])
        rows.append((r.choice([" ", "-", "3"]).join(r.choices(words, k=r.randrange(0, 60), weights=[1 / (i + 1) for i in range(len(words))])), lang, r.choice(["s1", "s1", "s2", "s3", None, "s4"])))
    docs = spark.createDataFrame([(i, t, g, s, "g", 1, "i", 2, 3, "t", 4) for i, (t, g, s) in enumerate(rows)], DOCS).repartition(3)
    got = divergence.audit(docs, ranks=9) if limits else divergence.op11_source_divergence(docs)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, ranks=9 if limits else 200)


def test_shares_of_any_size(spark):
    for n, total in ((0, 0), (0, 7), (10**12, 3 * 10**12), (9 * 10**9 - 1, 10**13), (9 * 10**9, 10**13), (2**60, 2**61)):
        got = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("t")).select(divergence.share("n", "t")).first()[0]
        assert got == 1 + (10**9 * (n + 1) // total if total else 0)


def test_radix_select(spark, monkeypatch):
    """Values over all bits, many ties with long common beginnings, groups of null and of fewer rows than ranks."""
    monkeypatch.setattr(frames, "HOT_ROWS", 40)
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 0)
    r = random.Random(6)
    rows = [(g, r.choice([0, 1, 5, 2**16, 2**16 + 1, 2**40, 2**62, 2**63 - 1]), f"{g}{i}") for g in ("a", None) for i in range(150)]
    rows += [("ties", 7, "x" * 30 + "é" * (i % 9) + "y" * (i // 9)) for i in range(200)] + [("ties", 8, "above"), ("ties", 6, "below")] + [("few", 3, "b"), ("few", 3, "a"), ("few", None, "c")]
    df = spark.createDataFrame(rows, "grp string, v long, name string").repartition(5)
    for k, few in ((17, 4),):
        got = sorted(((x.grp or "", x.item, x.value, x.rank) for x in radix.ranked(df, ["grp"], "v", "name", k, few).collect()), key=str)
        want = []
        for g in ("a", None, "ties", "few"):
            own = sorted(((-v, n.encode(), n) for h, v, n in rows if h == g and v is not None))[:k]
            want += [(g or "", n, -v, i + 1) for i, (v, _, n) in enumerate(own)]
        assert got == sorted(want, key=str)
    ties = spark.createDataFrame([("g", f"p{i:05d}".encode(), 50) for i in range(1000)], "g string, item binary, room long").cache()
    assert radix.first_ties(ties, 10).count() <= 60


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert divergence.op11_source_divergence(docs).count() == 0
    docs = spark.createDataFrame([(None,) * 11] * 4, DOCS)
    assert divergence.op11_source_divergence(docs).count() == 0


def test_long_text_is_audited_whole(spark):
    text = " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(1_200_000)) + " last"
    rows = [(text, "en", "a"), ("last qaa", "en", "b"), ("last", "en", "b")]
    docs = spark.createDataFrame([(i, *x, "g", 1, "i", 2, 3, "t", 4) for i, x in enumerate(rows)], DOCS)
    assert sorted(map(tuple, divergence.audit(docs, least_docs=2).collect())) == brute_audit(rows, least=2)


VECTORS = "vec_id long, embedding array<float>, label int, component int, n long, x string, v double, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 4.0, "w") for i, v in rows], VECTORS).repartition(3)


def brute_whitening(x, k):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    values, q = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / values.sum()


def test_whitening_against_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 7)).astype(np.float32) * np.arange(1, 8, dtype=np.float32)
    rows = [(i, [float(v) for v in base[i % 45]]) for i in range(60)]  # repeated vectors
    rows += [(None, rows[3][1]), (3, rows[3][1]), (100, None), (101, [1.0] * 6 + [None]), (102, [float("nan")] * 7), (103, [float("inf")] * 7), (104, [float("-inf")] + [0.0] * 6)]
    good = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(256 * np.array([v for _, v in good], dtype=np.float32).astype(float)).astype(np.int64)
    n, deviation, whitened, explained = brute_whitening(x, 4)
    got = whitening.op12_embedding_whitening(vectors(spark, rows)).collect()
    assert len(got) == 4 * len(good) and {g.n for g in got} == {n} and max(g.identity_error for g in got) < 1e-9
    assert sorted((str(g.vec_id), g.deviation) for g in got if g.component == 1) == sorted((str(i), int(d)) for (i, _), d in zip(good, deviation, strict=True))
    for k in range(4):
        own = sorted((str(g.vec_id), g.whitened) for g in got if g.component == k + 1)
        assert all(abs(g.explained - explained[k]) < 1e-9 for g in got if g.component == k + 1)
        assert any(np.allclose([w for _, w in own], [w for _, w in sorted((str(i), sign * w) for (i, _), w in zip(good, whitened[:, k], strict=True))]) for sign in (1, -1))


def test_whitening_of_odd_vectors(spark):
    big = [(1, [1e30, 2.0]), (2, [3.0, -4.0]), (3, [3.0]), (4, []), (5, [3.0, 0.0])]
    got = whitening.op12_embedding_whitening(vectors(spark, big)).collect()
    assert len(got) == 10 and {g.n for g in got} == {4}  # a shorter vector ends in zeros
    assert all(g.whitened is None and g.deviation is None for g in got if g.component == 2)  # lost beside 1e30
    same = whitening.op12_embedding_whitening(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(g.n, g.deviation, g.whitened, g.explained) for g in same} == {(1, 0, None, 0.0)}
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        assert whitening.op12_embedding_whitening(vectors(spark, rows)).count() == 0


def test_whole_numbers_of_any_size():
    model = whitening.Whitening(5, (2**70, 3), np.ones(2), np.eye(2), 2.0)
    y = whitening._centred(np.array([[2**60, 1]]), model)
    assert y.tolist() == [[5 * 2**60 - 2**70, 2]]


def test_minimum_cut_is_the_least_over_all_labellings():
    r = random.Random(1)
    for _ in range(1500):
        n = r.randint(1, 8)
        own = [r.randint(-6, 6) for _ in range(n)]
        edges = {(i, j): r.randint(1, 4) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4}

        def cost(side, own=own, edges=edges):
            return sum(max(0, x) if not s else max(0, -x) for x, s in zip(own, side, strict=True)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])

        best = min(itertools.product((False, True), repeat=n), key=lambda s: (cost(s), -sum(s)))
        assert tuple(mincut.minimum_cut(own, edges)) == best


PAGE = """<!doctype html><html><head><title>T</title><script>if(a<b){document.write("<p>no</p>")}</script></head><body class="has-sidebar nav-open">
<header class="site-header"><h1>My Site</h1><form action=/s><label>Search</label><input name=q><button>Go</button></form></header>
<div id="cookie-notice">We use cookies to improve your experience. <a href=#>Accept</a></div><nav class=menu><ul><li><a href=/>Home<li><a href=/a>About</a></ul></nav>
<div class="layout-with-sidebar"><main><article class="post"><header><h1>Title of&nbsp;it &amp; more</h1></header><p>First <b>bold</b>text, with a<br>break &lt;here&gt; &#8364;5.
<p>Second paragraph is here.<aside class=pull>Read also: that</aside><div class="ad-slot"><p>Buy now our great product today, it is the best.</p></div><!-- <p>no</p> -->
<ul><li>One item<li>Two  items</ul><table><tr><td>c1<td>c2</table><blockquote>Quoted words.</blockquote><script>var x="</p>";</script><footer>Filed under x</footer></article>
<section id=comments><h2>3 comments</h2><article class=comment><p>Great article, thanks a lot for writing all of this down.</p></article></section></main>
<div class=sidebar><h3>Trending</h3><p>Some teaser text that is long as a paragraph, really, it goes on.</p></div></div><footer><p>&copy; 2024 Site.</p></footer></body></html>"""
TEXT = "Title of it & more\nFirst boldtext, with a break <here> €5.\nSecond paragraph is here.\nOne item\nTwo items\nc1\nc2\nQuoted words."


def brute_articles(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1].replace("<br>", " ")
    parts = (" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_extraction(spark, sf):
    got = {r.page_id: r for r in mincut.op13_html_extraction(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(pages) == len(got)
    for p in pages:
        assert got[p.page_id].text == brute_articles(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "u", "<article></article>"), (4, "u", "<article>a<b"), (5, "u", "<article>1 < 2 and 3 > 2</article"), (6, "u", "<article>x<p hidden>no<p>y</article>")]
    pages = spark.createDataFrame([(*r, 1, "f", True) for r in rows], "page_id long, url string, html string, n int, feature string, content boolean").repartition(3)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in mincut.op13_html_extraction(pages).collect()), key=str)
    want = [(1, TEXT), (1, TEXT), (None, ""), (2, ""), (3, ""), (4, "a"), (5, "1 < 2 and 3 > 2"), (6, "x\ny")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert mincut.op13_html_extraction(pages.limit(0)).count() == 0


def test_pages_that_declare_nothing():
    """Form and neighbours decide."""
    page = "<div><a href=x>Home</a></div><div><a href=y>News</a></div><div><p>A first paragraph of running text, long enough to be one.</p><p>Short one.</p><p>A third paragraph that goes on for quite a few words more.</p></div><div><a href=z>Imprint</a></div>"
    assert mincut.main_text(page, mincut.weights()) == "A first paragraph of running text, long enough to be one.\nShort one.\nA third paragraph that goes on for quite a few words more."


@pytest.mark.parametrize("html", ["<div>" * 200_000 + "x", "<a " * 300_000, '<a "' * 300_000, "<p>ab cd." * 100_000, "</p>" * 500_000, "<" * 500_000, "<ul><li>" * 100_000, "<b>" * 200_000 + "x" + "</b>" * 200_000, "&amp" * 500_000, "<!--" * 300_000, "<b><p>" * 100_000, "<a x='>" + '<p ">t' * 100_000, "<p><table>" + "<div>" * 100_000 + "<h1>" * 100_000], ids=range(13))
def test_broken_pages_are_read_in_linear_time(html):
    began = time.time()
    mincut.main_text(html, mincut.weights())
    assert time.time() - began < 60


def test_part_of_a_long_page():
    page = f"<body><nav><a href=x>a</a></nav><article>{'<p>Some words of a paragraph here.</p>' * 150_000}<p>end.</p></article></body>"
    assert mincut.main_text(page, mincut.weights()).count("\n") == 150_000 and len(blocks(page)) == 150_002
