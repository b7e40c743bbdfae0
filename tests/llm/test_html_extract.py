import html
import math
import re
import time
import tracemalloc
from itertools import product

from pricelens.llm import html_extract as H
from pricelens.llm.dom import walk


def test_held_out_accuracy():
    field, wrong, total = H.default_field(), 0, 0
    for leaves, labels in H.labelled_pages(150, seed=4242):
        got = field.decode(leaves)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.02


def test_viterbi_like_brute_force():
    field = H.default_field()
    for leaves, _ in H.labelled_pages(20, seed=1):
        leaves = leaves[:9]
        score = [[sum(field.weights.get(f, (0, 0))[s] for f in H.features(x)) for s in (0, 1)] for x in leaves]
        value = lambda p: sum(score[k][s] for k, s in enumerate(p)) + sum(field.step[a][b] for a, b in zip(p, p[1:], strict=False))
        best = max(product((0, 1), repeat=len(leaves)), key=value)
        assert abs(value(field.decode(leaves)) - value(best)) < 1e-9


def test_query_on_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.query(spark, sf).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("</?(?:p|h1|br)>", " ", re.sub("</?b>", "", inner))).split())
        assert r["n_chars"] == len(r["text"])


def test_edges(spark):
    cases = [None, "", "   ", "<script>x</script>", "<div><p>a < b &amp;&nbsp;c &#x41; &eacute &bogus;</p>", "<p" * 2000, "<p a='" + "x" * 5000, "<b>" * 3000 + "deep", "<!-- <p>no</p> --><p>Yes, this is it.</p>"]
    df = spark.createDataFrame([(k, None, h, "t") for k, h in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in H.extract(spark, df).collect()}
    assert [got[k] for k in range(4)] == ["", "", "", ""]
    assert got[4] == "a < b & c A é &bogus;" and got[8] == "Yes, this is it."
    assert H.extract(spark, df.limit(0)).count() == 0


def test_layouts():
    page = """<body><header><a href=/>Site</a></header><nav><a href=/a>Home</a></nav><div class="cookie-notice">We use cookies to serve you better.</div>
    <article><h1>Title</h1><p>First <i>par</i>agraph of the text.<p>Second one, with a <a href=/x>link</a> inside it.<ul><li>One item.<li>Two</ul>
    <div class="ad-box">Buy it now!</div><p>Last paragraph stands here.</p><section class="comments"><h3>Replies</h3><p>I liked it a lot.</p></section></article>
    <aside>Other stories</aside><form><label>Your mail</label></form><footer>&copy; Site</footer>"""
    assert H.main_text(page, H.default_field()) == "Title First paragraph of the text. Second one, with a link inside it. One item. Two Last paragraph stands here."


WIKI = """<body><div id="mw-page"><ul class="menu"><li><a href=/m>Main page</a><li><a href=/r>Random article</a></ul></div>
<div id="content"><h1>Grey heron</h1><div id="siteSub">From the free encyclopedia</div><div id="toc"><ul><li><a href="#a">Range</a><li><a href="#b">Diet</a></ul></div>
<p>The grey heron is a wading bird of the heron family, found across much of the old world.</p><h2>Range</h2>
<p>It lives near lakes, rivers and ponds, and on the coast, where it stands still for a long time and waits for fish.</p></div>
<div class="footer"><p>Text is available under a free licence.</p></div>"""
BLOG = """<body><header class="header"><a href=/>My garden</a></header><div class="post"><h1>Seeds in spring</h1><p class="date">12 May 2019</p>
<p>This year I have sown the beans much later than before, and they came up within a week.</p><p>The peas did not do as well, as the ground was wet.</p>
<div class="comments"><h3>Comments</h3><p>Mine did well, thank you for asking.</p></div></div><aside><h3>About</h3><p>I write about plants.</p></aside><footer>My garden, 2019</footer>"""
TABLE = """<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a><br><a href=3>Contact</a></td><td><h1>The old mill</h1>
<p>The mill stands at the end of the village and was built by three brothers, who came from the coast.<p>It was sold twice, and has been empty since the war ended.</td></tr>
<tr><td>Copyright 2004 Village society</td></tr></table>"""


def test_unlike_layouts():
    field = H.default_field()
    text = H.main_text(WIKI, field)
    assert text.startswith("Grey heron The grey heron is a wading bird") and text.endswith("waits for fish.") and "encyclopedia" not in text and "Diet" not in text
    assert H.main_text(BLOG, field) == "Seeds in spring This year I have sown the beans much later than before, and they came up within a week. The peas did not do as well, as the ground was wet."
    assert H.main_text(TABLE, field) == "The old mill The mill stands at the end of the village and was built by three brothers, who came from the coast. It was sold twice, and has been empty since the war ended."


def test_deep_and_malformed_pages_cost_in_proportion():
    field = H.default_field()
    pages = ["<div>x " * 60_000, "".join(f"<div class=c{k}>x " for k in range(30_000)), "<p>" + "<b>x" * 60_000 + "</i>" * 60_000, "<div>" * 30_000 + "</p></span>x" * 30_000, "<ul>" + "<li>x<div>" * 30_000]
    for page in pages:
        began = time.perf_counter()
        tracemalloc.start()
        H.main_text(page, field)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.perf_counter() - began < 60 and peak < 200 * len(page)


def test_unclosed_elements_end():
    leaves = walk("<form><select><option>x</form><p>Kept.</p><div><object><i>y</div>Also kept.<noscript>z<p>And this.</p><script>gone <p>gone")
    assert [x.text for x in leaves] == ["Kept.", "Also kept.", "And this."]


def test_fit_on_separable_pages():
    """Weights fitted to pages whose blocks one feature tells apart give back the labels, and the likelihood rises."""
    pages = [(walk(f"<nav>{k} a</nav><p>{k} b.</p><p>{k} c.</p><footer>d</footer>"), [0, 1, 1, 0]) for k in range(12)]

    def likelihood(field):
        total = 0.0
        for leaves, labels in pages:
            score = [field.score(H.features(x)) for x in leaves]
            value = lambda p, score=score: sum(score[k][s] for k, s in enumerate(p)) + sum(field.step[a][b] for a, b in zip(p, p[1:], strict=False))
            total += value(labels) - math.log(sum(math.exp(value(p)) for p in product((0, 1), repeat=len(leaves))))
        return total

    few, many = H.fit(pages, rounds=2), H.fit(pages, rounds=60)
    assert likelihood(few) < likelihood(many) < 0
    assert all(many.decode(leaves) == labels for leaves, labels in pages)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "u", BLOG, 1), (1, None, BLOG, 2), (1, None, BLOG, 2)], "page_id long, url string, html string, n_chars int")
    got = H.extract(spark, df).collect()
    assert len(got) == 3 and len({r["text"] for r in got}) == 1 and {r["page_id"] for r in got} == {None, 1}


def test_walk_paths():
    leaves = walk("<div class='Top menu'><p>a<b>b</b>c<p>d</div>e")
    assert [x.text for x in leaves] == ["abc", "d", "e"]
    assert leaves[0].path[0].names == ("top", "menu") and leaves[2].path == ()
