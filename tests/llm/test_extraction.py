import html
import itertools
import re
import time
from math import exp

import pytest

from tallyforge.llm import extraction as E
from tallyforge.llm.dom import Dom


@pytest.fixture(scope="module")
def model(spark):
    return E.train(E.labelled(spark))


def article(page):
    """The text of the article of a page as the test tables have them, by plain patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"</?b>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    rows = E.extract(pages).collect()
    assert len(rows) == len(want) and all(want[r.page_id] == (r.url, r.text) and r.n_chars == len(r.text) for r in rows)


def test_marginals_equal_summing_over_all_labels(model):
    for page in E.LABELLED[5:9]:
        parents, kinds, shapes = E._kinds(Dom(page))
        n = len(parents)
        total, ones = 0.0, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            w = (0.01, 0.99)[y[0]] * exp(sum(model[f"{kinds[i]}|{y[parents[i]]}|{y[i]}"] for i in range(1, n)) + sum(model[f"{s}|{y[i]}"] for i, s in enumerate(shapes) if s))
            total += w
            for i in range(n):
                ones[i] += w * y[i]
        assert E.marginals(parents, kinds, shapes, model) == pytest.approx([x / total for x in ones], rel=1e-9)


ADVERT = "Buy this thing today. It is a very good thing, and it does not cost much at all, as you will see."
COMMENT = '<div class="comment"><p>A very long comment. It has sentences and goes on for more than eighty characters, as some readers do.</p></div>'


@pytest.mark.parametrize("page, want", [
    ('<html><body class="home"><header><h1>Site</h1></header><div class="wrap has-sidebar"><article><h1>T</h1><p>One. Two and more.</p><aside>no</aside><div class="ad-box">' + ADVERT + "</div><p>End</p></article></div>"
        '<section id="comments">' + COMMENT * 300 + "</section><footer>f</footer></body></html>", "T\nOne. Two and more.\nEnd"),
    ('<div id="nav"><a>x</a></div><div class="cookie-banner"><p>' + ADVERT + '</p></div><main><h1>A &amp; B</h1><p>x\n\t y<br>z</p><form><input><label>Name</label></form><script>var a="<p>no</p>"</script></main>', "A & B\nx y z"),
    ("", ""), (None, ""), ("just text", "just text"), ("<article><p>a<p>b<li>c", "a\nb\nc"), ("<article>a<!-- no --><b>b</b><style>p{}</style> c</article>", "ab c"),
])
def test_pages(model, page, want):
    assert E.text_of(page, model) == want


@pytest.mark.parametrize("k", range(10))
def test_held_out_pages(spark, k):
    """Each labelled page by a model of the others."""
    rest = spark.createDataFrame([(h,) for i, h in enumerate(E.LABELLED) if i != k], "html string")
    dom = Dom(E.LABELLED[k])
    y = E._labels(dom, E._kinds(dom)[0])[len(dom.nodes) :]
    got = E.text_of(E.LABELLED[k], E.train(rest)).split("\n")
    right = sum((b[1] in got) == bool(v) for b, v in zip(dom.blocks, y))
    assert right >= 0.8 * len(y)


@pytest.mark.parametrize("page", ['<a href="' * 100_000, "<p" * 100_000, "<!--" * 100_000, "<![x" * 50_000, "<div>" * 50_000 + "x", "<li><b>" * 30_000, "<i>" + "<p>x</p>" * 20_000], ids=range(7))
def test_time_in_proportion(model, page):
    began = time.time()
    E.text_of(page, model)
    assert time.time() - began < 15
