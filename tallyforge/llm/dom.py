"""A page as a tree of block elements and blocks of text."""

from __future__ import annotations

import re
from html import unescape

# Elements of HTML by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style title noscript template svg math textarea select button iframe object canvas audio video datalist map".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li "
    "main menu nav ol p pre section search summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, and where looking for it stops.
CELLS = frozenset(("td", "th"))
ENDS = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **{t: (frozenset("thead tbody tfoot".split()), frozenset(("table",))) for t in ("thead", "tbody", "tfoot")},
    **{h: (HEADING, BLOCK - HEADING) for h in HEADING},
}
PARAGRAPH = (frozenset(("p",)), frozenset("table td th caption".split()))
#: Cells and rows lie in a paragraph's table, if in any.
KEEPS_PARAGRAPH = frozenset("html body caption legend tbody td tfoot th thead tr".split())
SPACE = " \t\n\r\f"
#: A start tag: only a quote behind = opens a value. Nothing is tried twice, so a tag that never ends costs one look to the end.
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s]*+))?""")
#: Elements whose content is not parsed, and their ends.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea iframe noembed noframes xmp".split()}
_BLANKS = str.maketrans({c: " " for c in SPACE})


class Dom:
    """nodes: (parent, tag, attributes) of each block element, parents first; node 0 is above all. blocks: (node, text, characters in links)
    in page order. Text between two borders of block elements is one block; white space in it is one space, at its ends none."""

    def __init__(self, html: str) -> None:
        self.nodes: list[tuple[int, str, dict]] = [(-1, "page", {})]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack: list[tuple[str, int]] = [("page", 0)]
        self.n_open: dict[str, int] = {}
        self.dropped = ""
        self.parts: list[str] = []
        self.linked = 0
        self._read(html)
        self.border()

    def _read(self, html: str) -> None:
        """Calls for tags and text in turn, in one pass. A tag or comment that does not end takes the rest of the page."""
        at = 0
        while (i := html.find("<", at)) >= 0:
            if i > at:
                self.handle_data(html[at:i])
            c = html[i + 1 : i + 2]
            if c.isascii() and c.isalpha():
                if not (m := _TAG.match(html, i)):
                    return
                tag, given, at = m[1].lower(), m[2], m.end()
                self.handle_starttag(tag, given, given.endswith("/"))
                if tag in _RAW and not given.endswith("/"):
                    if not (m := _RAW[tag].search(html, at)):
                        return
                    at = m.start()
            elif c in ("/", "!", "?") and c:
                comment = html.startswith("<!--", i)
                end = html.find("-->" if comment else ">", i + 2)
                if end < 0:
                    return
                name = html[i + 2 : end]
                if c == "/" and name[:1].isalpha():
                    self.handle_endtag(re.split(r"[\s/]", name, maxsplit=1)[0].lower())
                at = end + (3 if comment else 1)
            else:
                self.handle_data("<")
                at = i + 1
        if at < len(html):
            self.handle_data(html[at:])

    def border(self) -> None:
        """Ends the block of text."""
        if self.parts:
            text = " ".join(x for x in "".join(self.parts).translate(_BLANKS).split(" ") if x)
            if text:
                self.blocks.append((self.stack[-1][1], text, self.linked))
            self.parts, self.linked = [], 0

    def _pop(self) -> str:
        tag, _ = self.stack[-1]
        if tag in BLOCK:
            self.border()
        self.stack.pop()
        self.n_open[tag] -= 1
        return tag

    def _end(self, tags: frozenset, stops: frozenset) -> None:
        """Ends the innermost open element of the tags, and what is open in it, unless a stop is in between."""
        if not any(self.n_open.get(t) for t in tags):
            return
        for tag, _ in reversed(self.stack):
            if tag in tags:
                while self._pop() not in tags:
                    pass
                return
            if tag in stops:
                return

    def handle_starttag(self, tag: str, given: str, closed: bool = False) -> None:
        if self.dropped:
            return
        if tag in DROPPED:
            self.dropped = "" if closed else tag
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK:
            self.border()
            if tag not in KEEPS_PARAGRAPH:
                self._end(*PARAGRAPH)
            if tag in ENDS:
                self._end(*ENDS[tag])
            if tag == "hr" or tag in ("html", "body") and self.n_open.get(tag):
                return
            self.nodes.append((self.stack[-1][1], tag, {k.lower(): unescape(v.strip('"\'')) for k, v in _ATTRIBUTE.findall(given)}))
            self._push(tag, len(self.nodes) - 1)
        elif tag not in VOID:
            if tag == "a" and self.n_open.get("a"):
                self.handle_endtag("a")
            self._push(tag, self.stack[-1][1])

    def _push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag == self.dropped:
                self.dropped = ""
            return
        if tag in BLOCK and tag not in ("html", "body"):
            self.border()
            if tag in HEADING:
                self._end(HEADING, frozenset())
            else:
                self._end(frozenset((tag,)), frozenset(("table",)) if tag in ("p", "li", "dt", "dd") else frozenset())
        elif tag == "br":
            self.parts.append(" ")
        elif self.n_open.get(tag) and tag not in ("html", "body"):
            for i in range(len(self.stack) - 1, 0, -1):  # blocks inside stay open
                if self.stack[i][0] == tag:
                    del self.stack[i]
                    self.n_open[tag] -= 1
                    break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(unescape(data))
            if self.n_open.get("a"):
                self.linked += len(data.strip())
