import math
import random
from itertools import product

import pytest

from geomatch.llm import html


@pytest.fixture(scope="module")
def field():
    return html.fit(list(html.training_pages([], 400)))


def test_blocks_and_white_space():
    page = "<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body>lead<p>One <b>two<br>three\n <p>a&amp;b &lt;c&#233; <!-- no --><a href='>'>link</a><ul><li>x<li>y</ul>tail<style>p{}</style></body>"
    found = html.blocks(page)
    assert [b.text for b in found] == ["lead", "One two three", "a&b <cé link", "x", "y", "tail"]
    assert found[2].linked == 4 and [e[0] for e in found[3].path][-2:] == ["ul", "li"]


def test_odd_markup():
    assert [b.text for b in html.blocks("a < b <p class=x>c</p")] == ["a < b", "c"]
    assert [b.text for b in html.blocks("<p a='>open quote")] == ["open quote"]
    assert html.blocks(None) == html.blocks("") == html.blocks("<p> \n</p>") == html.blocks("<script>x") == []
    assert [b.text for b in html.blocks("<div>a</i></div></div><p>b")] == ["a", "b"]
    assert len(html.blocks("<p>x" * 20_000)) == 20_000


def score(field, page, labels):
    total = field.start[labels[0]]
    for i, (b, y) in enumerate(zip(page, labels)):
        total += y * sum(field.weights.get(f, 0.0) for f in html._path_features(b.path) + html._text_features(b))
        total += field.moves[labels[i - 1]][y] if i else 0
    return total


def test_viterbi_finds_the_best_labelling(field):
    rng = random.Random(1)
    for page, _ in list(html.training_pages([], 60, seed=5)):
        own = html.blocks(page)
        own = own[(at := rng.randrange(len(own))) : at + 9]
        best = max(score(field, own, y) for y in product((0, 1), repeat=len(own)))
        assert math.isclose(score(field, own, [int(x) for x in field.label(own)]), best, abs_tol=1e-6)


def test_held_out_pages(field):
    right = total = 0
    for page, labels in html.training_pages(["alpha", "beta", "gamma", "delta"], 200, seed=99):
        own = field.label(html.blocks(page))
        right += sum(a == b for a, b in zip(own, labels))
        total += len(labels)
    assert right / total > 0.98


def test_layouts_that_are_not_in_training(field):
    article = "<h2>A title of the page</h2><p>The first part of the text, with words. And more of them.</p><p>The second part is as long. It ends here.</p>"
    want = "A title of the page\n\nThe first part of the text, with words. And more of them.\n\nThe second part is as long. It ends here."
    around = [
        '<header><h1>Site</h1></header><nav><a href="/">Home</a><a href="/b">About</a></nav><main>{}</main><aside><p>Read this too. It is good.</p></aside><footer>© 2020 Site. All rights.</footer>',
        '<div class="cookie-notice">We use cookies here. You know it.</div><div id="content"><div class="post">{}</div></div><div id="comments"><h3>Two replies</h3><p>I liked it. Thank you very much for it.</p></div>',
        '<ul class="menu"><li><a href="/">Home</a></li></ul><article>{}</article><form><label>Mail</label><p>Sign up for news. It is free.</p><button>Go</button></form><div class="advert">Buy it now. It is cheap.</div>',
    ]
    for page in around:
        assert field.extract("<html><body>" + page.format(article) + "</body></html>") == want


def test_pages(spark, field):
    pages = [(1, "u", "<article><h1>T</h1><p>Some text is here, of course. It goes on.</p></article><footer>© x</footer>"), (1, "u", None), (None, None, ""), (2, "v", "<article>" + "<p>Long text is here, yes. It goes on and on.</p>" * 5000 + "</article>")]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    rows = html.extract(table, field).collect()
    assert sorted((str(r.page_id), r.n_chars == len(r.text), bool(r.text)) for r in rows) == [("1", True, False), ("1", True, True), ("2", True, True), ("None", True, False)]
    assert max(r.n_chars for r in rows) == 5000 * (len("Long text is here, yes. It goes on and on.") + 2) - 2
    assert html.extract(table.filter("false")).count() == 0
    trained = html.extract(table).filter("page_id = 1 and n_chars > 0").first()
    assert trained.text == "T\n\nSome text is here, of course. It goes on."
