"""The main text of pages by a tree-structured graphical model.

Each block element and each block of text has a hidden label, content or not; an element is content if some text in it is. Potentials connect
every node with its parent, by what the node is: its tag and the part of the page that its own or an outer tag, class, id or role names.
Blocks of text outside any such part have a potential of their shape, too, and what is in a part that is named as main text one for that. One pass of messages up the tree and one down give each block's
marginal; blocks of 0.5 or more are the text. Potentials are smoothed counts over labelled pages.

Null and empty pages give an empty text. Whole pages are read, one at a time in a task, in time in proportion to their length. Repeated and
null ids are rows of their own; other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyforge.llm.dom import HEADING, Dom
from tallyforge.llm.shared import picked, with_python

#: Parts of a page by tag, then by words of class, id and role. Fixed values.
TAGS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "dialog": "notice", "search": "form", "article": "main", "main": "main"}
WORDS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc skip",
    "header": "header masthead banner topbar",
    "footer": "footer copyright colophon contentinfo",
    "side": "sidebar aside side widget related recommended recommendations trending popular complementary",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall disclaimer",
    "comment": "comment comments disqus reply replies respond discussion",
    "form": "form login signup search share sharing social",
    "main": "article content main post entry story body text prose",
}
PART = {w: part for part, words in WORDS.items() for w in words.split()}
#: Tags that are alike as nodes.
GROUP = {**dict.fromkeys(HEADING, "heading"), **dict.fromkeys("p blockquote pre".split(), "paragraph"), **dict.fromkeys("ul ol dl li dt dd".split(), "list"), **dict.fromkeys("table tbody thead tfoot tr td th".split(), "table")}
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Weight of what is expected before any page has been seen.
PRIOR = 0.01

#: Labelled pages: an element with y="1" and what is in it is content up to the next y; other text is not.
LABELLED = (
    '<html><body><nav><ul><li><a>Home</a></li><li><a>About</a></li></ul></nav><div class="ad">Buy it now. Cheap.</div><article y="1"><h1>A title</h1><p>Some long text that goes on, and on. And ends here after a while, at last it does.<p>Short one.<ul><li>item</li></ul></article><footer>c 2020</footer></body></html>',
    '<body><header><h1>Site</h1><a>Login</a></header><main><div y="1"><h2>Heading</h2><p>Text with a sentence. Another one follows, with some more words to it.</p><blockquote><p>quote</p></blockquote><table><tr><td>cell</td></tr></table></div><aside><h3>Related</h3><ul><li><a>link</a></li></ul><p>A long text about other things that could stand in an article as well. It does not.</p></aside></main><footer><p>Imprint. All rights reserved.</p></footer></body>',
    '<body><div id="menu"><a>One</a><a>Two</a></div><div id="content" y="1"><h1>Title</h1><div><p>First paragraph, with a sentence in it. It goes on.</p><p>Next</p></div><div class="ad" y="0"><p>Advert. Buy this thing today, it is a very good thing to buy.</p></div><ol><li>a</li></ol></div><div class="sidebar"><p>Something long beside the text, which is not part of it. Really.</p></div><div id="footer">foot</div></body>',
    '<body><div class="cookie-notice"><p>We use cookies to make this site better. Please accept all of them now.</p></div><div class="post"><article y="1"><h1>T</h1><p>Body text of the post. Two sentences in here, and a half.</p></article></div><section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all. It is a long comment, of many words, by a reader.</p></div><div class="comment"><p>Nice.</p></div><form><p>Your name</p></form></section></body>',
    '<body><div><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Sport</a></li></ul></div><div y="1"><h1>Plain</h1><p>This page names no part of itself. Still it has a text with sentences, which is what we want.</p><p>One more paragraph with enough words in it. It has two sentences.</p><p>End</p></div><div><a>Imprint</a> <a>Contact</a></div></body>',
    '<div><a>Start</a> | <a>Help</a></div><h1 y="1">Old page</h1><div y="1">Text lies in the page itself, with a few sentences. It has no paragraphs at all, as old pages have.</div><p y="1">A paragraph that follows. It is content, too.</p><div><a>back</a></div>',
    '<p y="1">Just a paragraph</p>', '<h1 y="1">Title</h1><p y="1">x</p><p y="1">And a sentence that is long enough to look like one. Yes.</p>', '<body><p y="1">short</p><ul y="1"><li>one</li><li>two</li></ul></body>',
    '<body><main y="1"><h1>T</h1><nav y="0"><a>toc</a></nav><section><h2>S</h2><p>Words in a section of the main part. They count.</p><pre>code</pre><div class="share" y="0"><p>Share this</p></div><div class="newsletter" y="0"><p>Subscribe to our letter. It comes weekly and costs nothing at all.</p></div></section><footer y="0"><p>Filed under news. By the author of this.</p></footer><section class="comments" y="0"><p>Reader says something long here. It has sentences and all.</p></section></main></body>',
)


def shape(text: str, linked: int) -> str:
    """Length, share of links, and whether there is a sentence."""
    n = len(text)
    return f"{0 if n < 25 else 1 if n < 80 else 2}{'l' if linked * 3 > n else '-'}{'s' if re.search(r'[.!?…。！？؟।](?:$|[ ”»\")])', text) or chr(0x3002) in text else '-'}"


def _parts(dom: Dom) -> list[str]:
    """The part of the page that each node is in: the outermost that is no main text, else the innermost main one, else none."""
    n = len(dom.nodes)
    own, holds = [""] * n, [False] * n
    for i in range(n - 1, 0, -1):
        parent, tag, given = dom.nodes[i]
        words = [] if tag in ("html", "body") else [w.lower() for a in ("class", "id", "role") for w in _TOKEN.findall(given.get(a) or "")]
        named = [PART[w] for w in words if w in PART]
        bad = next((x for x in named if x != "main"), "")
        if bad and bad != "comment" and holds[i]:
            bad = ""  # a wrapper that is called after what stands beside the text
        own[i] = bad or TAGS.get(tag) or ("main" if named else "")
        if holds[i] or own[i] == "main" and tag in ("article", "main"):
            holds[parent] = True
    out = [""] * n
    for i in range(1, n):
        above = out[dom.nodes[i][0]]
        mine = "" if own[i] == "header" and above == "main" else own[i]
        out[i] = above if above not in ("", "main") else mine or above
    return out


def _kinds(dom: Dom) -> tuple[list[int], list[str], list[str]]:
    """Parent, kind and shape of each node; blocks of text stand behind the elements."""
    parts = _parts(dom)
    parents = [p for p, _, _ in dom.nodes] + [b[0] for b in dom.blocks]
    kinds = [f"{part}/{GROUP.get(tag, 'box')}" for part, (_, tag, _) in zip(parts, dom.nodes)] + [f"{parts[b[0]]}/text" for b in dom.blocks]
    shown = {"main": lambda b: "main", "": lambda b: shape(b[1], b[2])}
    shapes = ["main" if p == "main" else "" for p in parts] + [shown[parts[b[0]]](b) if parts[b[0]] in shown else "" for b in dom.blocks]
    return parents, kinds, shapes


def _labels(dom: Dom, parents: list[int]) -> list[int]:
    given = [0] * len(dom.nodes)
    for i, (p, _, attributes) in enumerate(dom.nodes[1:], 1):
        given[i] = int(attributes["y"]) if "y" in attributes else given[p]
    y = [0] * len(dom.nodes) + [given[b[0]] for b in dom.blocks]
    for i in range(len(parents) - 1, 0, -1):
        if y[i]:
            y[parents[i]] = 1
    return y


def train(pages: DataFrame) -> dict[str, float]:
    """pages (html, with labels) -> potentials by key, as logarithms: `kind|parent|own` and `shape|own`. Pages are counted by Spark; what
    reaches the driver is a count for each kind of node, of which there are as many as parts times groups of tags."""
    schema = StructType([StructField("keys", StringType())])

    def keys(pages: list) -> list[pa.Array]:
        out = []
        for html in pages:
            dom = Dom(html or "")
            parents, kinds, shapes = _kinds(dom)
            y = _labels(dom, parents)
            out.append("\n".join([f"{kinds[i]}|{y[parents[i]]}|{y[i]}" for i in range(1, len(y))] + [f"{s}|{y[i]}" for i, s in enumerate(shapes) if s]))
        return [pa.array(out, pa.string())]

    found = with_python(picked(pages, html="html"), "html", schema, keys).select(F.explode(F.split("keys", "\n")).alias("key")).groupBy("key").count()
    n = Counter({r["key"]: r["count"] for r in found.collect()})
    model = {}
    for kind in {k.split("|")[0] for k in n if "/" in k} | {f"{p}/{g}" for p in ("", *WORDS) for g in ("box", "text", *GROUP.values())}:
        part = kind.split("/")[0]
        for above in (0, 1):
            one, other = n[f"{kind}|{above}|1"], n[f"{kind}|{above}|0"]
            # what is expected of a kind not met: nothing below what is not content, all of main text, none of the other parts
            expected = 0.001 if not above or part not in ("", "main") else 0.99 if part == "main" else 0.7
            weight = 1 if above and not part else PRIOR + 5
            p = min(0.999, max(0.0001 if above else 1e-6, (one + weight * expected) / (one + other + weight)))
            model[f"{kind}|{above}|1"], model[f"{kind}|{above}|0"] = log(p), log1p(-p)
    seen = [1 + sum(c for k, c in n.items() if "/" not in k and k.endswith(f"|{y}")) for y in (0, 1)]
    sums = [seen[y] - n[f"main|{y}"] for y in (0, 1)]
    for s in {"main"} | {f"{a}{b}{c}" for a in "012" for b in "l-" for c in "s-"}:
        for y in (0, 1):
            model[f"{s}|{y}"] = log((n[f"{s}|{y}"] + 0.5) / (seen if s == "main" else sums)[y])
    return model


def _sum(a: float, b: float) -> float:
    return max(a, b) + log1p(exp(-abs(a - b)))


def marginals(parents: list[int], kinds: list[str], shapes: list[str], model: dict[str, float]) -> list[float]:
    """The probability of each node to be content. Parents stand before their children, so one loop goes up and one down."""
    n = len(parents)
    edge = [[[model[f"{k}|{above}|{y}"] for y in (0, 1)] for above in (0, 1)] for k in kinds]
    up = [[model[f"{s}|{y}"] if s else 0.0 for y in (0, 1)] for s in shapes]
    sent = [[0.0, 0.0] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        for above in (0, 1):
            sent[i][above] = _sum(edge[i][above][0] + up[i][0], edge[i][above][1] + up[i][1])
            up[parents[i]][above] += sent[i][above]
    whole = [[log(0.01) + up[0][0], log(0.99) + up[0][1]]]
    for i in range(1, n):
        rest = [whole[parents[i]][above] - sent[i][above] for above in (0, 1)]
        down = [_sum(rest[0] + edge[i][0][y], rest[1] + edge[i][1][y]) for y in (0, 1)]
        most = max(down)
        whole.append([up[i][y] + down[y] - most for y in (0, 1)])
    return [1 / (1 + exp(min(700.0, a - b))) for a, b in whole]


def text_of(html: str | None, model: dict[str, float]) -> str:
    dom = Dom(html or "")
    found = marginals(*_kinds(dom), model)
    return "\n".join(b[1] for b, p in zip(dom.blocks, found[len(dom.nodes) :]) if p >= 0.5)


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in LABELLED], "html string")


def extract(pages: DataFrame, model: dict[str, float] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page. The model is some hundred numbers, which go along with the tasks."""
    known = train(labelled(pages.sparkSession)) if model is None else model

    def run(given: list) -> list[pa.Array]:
        texts = [text_of(h, known) for h in given]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    made = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])
    return with_python(picked(pages, page_id=page_id, url=url, html=html), "html", made, run, rows=64).select("page_id", "url", "text", "n_chars")
