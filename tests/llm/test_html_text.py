import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm.html_text import DIMS, Labeller, blocks_of, by_tags, extract_text, features, fit_labeller, padded, variant

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a>b">Home</a><li><a href=/x>News</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div>
<article><h1>Head\n &lt;line&gt;</h1><p><b>One&nbsp;&copy; two<br>three<p>Four <i>five</i>
 six</p><script>x()</script><ul><li>seven<li>eight</ul>nine</article><footer>&copy; foot</footer></body></html>"""


def test_blocks():
    got = blocks_of(PAGE)
    assert [b[1] for b in got] == ["Home", "News", "Buy", "Head <line>", "One © two three", "Four five six", "seven", "eight", "nine", "© foot"]
    assert [by_tags(b[0].words()) for b in got] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 0]
    assert got[0][2] == 1.0 and got[4][2] == 0.0
    assert blocks_of(None) == blocks_of("") == blocks_of("<p></p> <!-- x") == []
    assert [b[1] for b in blocks_of("a < b <p>c<script>d")] == ["a < b", "c"]
    assert len(blocks_of("<div>" * 3000 + "x" * 300_000)) == 1


def test_gradients():
    rng = np.random.default_rng(0)
    m = Labeller()
    m.w = [w.astype(np.float64) for w in m.w]
    m.out = rng.normal(size=m.out.shape)
    x, mask = padded([rng.normal(size=(n, DIMS)) for n in (3, 5, 1)])
    y = (rng.random(mask.shape) < 0.5).astype(float)
    _, grads = m.gradients(x, mask, y)
    for k, at in ((0, (3, 5)), (0, (DIMS + 2, 40)), (1, (DIMS + 3, 20)), (1, (-1, 3))):
        w, e = m.w[k], 1e-2
        w[at] += e
        up = m.gradients(x, mask, y)[0]
        w[at] -= 2 * e
        down = m.gradients(x, mask, y)[0]
        w[at] += e
        assert grads[k][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-4)


def test_extracts_the_article_of_real_pages_and_of_variants(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labeller = fit_labeller(pages)
    got = {r.page_id: r for r in extract_text(pages.selectExpr("*", "1 AS text", "2 AS n_chars"), labeller).collect()}
    rng, wrong, total = np.random.default_rng(5), 0, 0
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        blocks = blocks_of(r["html"])
        labels = [by_tags(b[0].words()) for b in blocks]
        want = "\n\n".join(b[1] for b, y in zip(blocks, labels, strict=True) if y)
        assert got[r["page_id"]].text == want and got[r["page_id"]].n_chars == len(want)
        b, y = variant(blocks, labels, rng)
        p = labeller.label([features(b)])[0]
        wrong, total = wrong + ((p >= 0.5) != np.array(y)).sum(), total + len(y)
    assert wrong < 0.01 * total


def test_odd_pages(spark):
    odd = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>" + "word " * 200_000), (3, "u", "<nav>x</nav>"), (None, "u", "plain")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string")
    model = fit_labeller(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rows = extract_text(df, model).collect()
    assert len(rows) == 5 and {r.n_chars for r in rows if r.page_id in (1, 2)} == {0}
    assert max(r.n_chars for r in rows) == 999_999
    assert extract_text(df.limit(0), fit_labeller(df.limit(0))).collect() == []


def test_no_text_is_lost_to_markup():
    texts = lambda page: [b[1] for b in blocks_of(page)]
    assert texts("<article><p>one</p><p don't>two</p><p>three it's</p></article>") == ["one", "two", "three it's"]
    assert texts("<p>He said <math>x</math> ok <svg/> and <object>o</object><noscript>n</noscript> z") == ["He said x ok and on z"]
    assert texts("<p>a <svg><title/>in</svg> b<p>c <textarea>d<p>e <select><option>f</select> g") == ["a in b", "c d", "e", "f", "g"]
    assert texts("<html><head><title>t</title><p>no end of the head<p title='a>b' x=\"it's\">next<!--> shown <!-- not --> too") == ["no end of the head", "next shown too"]
    assert texts('<p a="unclosed>one</p><p>two</p>') == ["one", "two"]


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x", "<div>x" * 30_000, "<b>x" * 100_000, "<textarea>x" * 30_000, "<p x='" * 60_000, "<!--" * 60_000, "<" * 300_000, "<a " * 300_000, "</p>" * 100_000, "<li><ul>" * 20_000, "<td>x" * 50_000])
def test_time_is_linear_in_the_page(page):
    start = time.time()
    blocks_of(page)
    assert time.time() - start < 5


#: Hand-labelled pages: (html, main text). Written for this test, with furniture inside and around the article.
GOLDEN = [
    ("<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><main><article><h1>Rivers rise again</h1><p>Heavy rain fell on the upper valley for three days.</p><p>Farmers moved their cattle to higher ground.</p>"
     "<aside class=related><h3>Related</h3><a href=/x>Dams explained</a></aside><p>The water is expected to fall by Friday.</p></article></main><footer>All rights reserved</footer></body></html>",
     ["Rivers rise again", "Heavy rain fell on the upper valley for three days.", "Farmers moved their cattle to higher ground.", "The water is expected to fall by Friday."]),
    ("<body><div class='site'><div class='menu'><ul><li><a href=a>Start</a><li><a href=b>Archive</a></ul></div><div class='cookie notice'>We use cookies to improve the service.</div><div class='content'><h2>A short walk</h2><p>The path begins behind the old mill.</p><ul><li>Bring good shoes.</li><li>Bring water.</li></ul></div>"
     "<div class='sidebar'><p>Subscribe to our letter</p></div><div id='comments'><div class='comment'><p>Nice walk, thank you!</p></div></div></div></body>",
     ["A short walk", "The path begins behind the old mill.", "Bring good shoes.", "Bring water."]),
    ("<html><body><header><h2>The Daily Leaf</h2></header><form action=/s><label>Search</label><input></form><article class=post><h1>On bread</h1><blockquote>Flour, water, salt.</blockquote><p>Nothing else is needed, <b>but time</b>.</p><div class=ad>Buy our oven now</div></article>"
     "<section class=comments><p>I tried it and it works.</p></section><footer><p>Contact</p></footer></body></html>",
     ["On bread", "Flour, water, salt.", "Nothing else is needed, but time ."]),
    ("<body><div class=page><div class='banner advert'>Win a trip today</div><main><h1>Winter birds</h1><p>Finches come in flocks when snow covers the fields.</p><p>Owls hunt by day in hard winters.</p><figure><figcaption>A finch at the window.</figcaption></figure></main><aside><p>Most read</p><ul><li><a href=1>Spring birds</a></ul></aside></div></body>",
     ["Winter birds", "Finches come in flocks when snow covers the fields.", "Owls hunt by day in hard winters.", "A finch at the window."]),
    ("<body><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav><article><h1>Notes</h1><table><tr><td>Depth</td><td>12 m</td></tr></table><p>The lake is deepest at its northern end.</p></article><div class='newsletter'><p>Get our newsletter</p></div><footer>Imprint</footer></body>",
     ["Notes", "Depth", "12 m", "The lake is deepest at its northern end."]),
]


def test_block_recall_and_precision_on_golden_pages(spark):
    labeller = fit_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    df = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(GOLDEN)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in extract_text(df, labeller).collect()}
    squeeze = lambda x: x.replace(" .", ".")
    found = wanted = right = 0
    for i, (_, main) in enumerate(GOLDEN):
        a, b = [squeeze(x) for x in got[i]], [squeeze(x) for x in main]
        hits = sum(x in b for x in a)
        found, wanted, right = found + len(a), wanted + len(b), right + hits
    assert right / wanted >= 0.9 and right / found >= 0.9, (right, wanted, found, got)


def test_the_query_equals_pages_labelled_one_by_one(spark):
    """Plain loops: one page and one block at a time through the network's equations, with the model that the query fits."""
    from tidemark.llm import queries

    data = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{data}/pages.parquet")
    labeller = fit_labeller(pages)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    n = len(labeller.out) // 2
    got = {r.page_id: r for r in queries.op7_html_extraction(spark, data).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        blocks = blocks_of(r.html)
        x, states = features(blocks).astype(float), []
        for w, order in ((labeller.w[0], range(len(blocks))), (labeller.w[1], range(len(blocks) - 1, -1, -1))):
            h, c, out = np.zeros(n), np.zeros(n), {}
            for t in order:
                z = np.concatenate([x[t], h, [1.0]]) @ w
                f, i, o, g = sigmoid(z[:n]), sigmoid(z[n : 2 * n]), sigmoid(z[2 * n : 3 * n]), np.tanh(z[3 * n :])
                c = f * c + i * g
                h = out[t] = o * np.tanh(c)
            states.append(out)
        chance = [sigmoid(np.concatenate([states[0][t], states[1][t], [1.0]]) @ labeller.out) for t in range(len(blocks))]
        want = "\n\n".join(b[1] for b, p in zip(blocks, chance, strict=True) if p >= 0.5)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
