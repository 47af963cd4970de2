"""HTML extraction with a tree-structured graphical model.

Every block element of a page is a node with two states, content or not. A node's own features (tag, words of class and id, links, length)
weigh its state; parent-child potentials tie it to its parent. Messages pass up from the leaves and down from the root, which gives
each node its marginal probability; the text of nodes that are more likely content than not is the page's text. All potentials are
counted from the labelled pages below.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from math import prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import ship

# Element names of HTML by what they do to text.
BLOCKS = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th nav header footer aside form fieldset address details summary hgroup search dialog center hr menu".split())
SILENT = set("head script style noscript template iframe object embed svg canvas button select option textarea input label audio video map math title".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# An element that opens one of these ends an open one of those.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "nav", "aside", "header", "footer", "form", "blockquote", "td", "th", "li", "figure", "details"}

# Words of class, id and role, by what they say.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "frame": "header footer head foot masthead banner site top bottom copyright colophon topbar contentinfo",
    "side": "sidebar side aside widget rail related recommended more popular trending complementary",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert message warning dialog",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion banner-ad",
    "comment": "comment comments reply replies discussion disqus respond responses feedback",
    "form": "form newsletter subscribe signup login search share social sharing",
    "text": "article content main post entry body story text prose page-content",
}
_HINT = {w: k for k, some in HINTS.items() for w in some.split()}

#: Labelled pages: y="1" marks content and y="0" the rest; what is inside follows until it is marked otherwise.
LABELLED = [
    '<html y="0"><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav><article y="1"><h1>A heading</h1><p>Long text of the article goes on for a while, and then some more of it.</p><p>Short.</p><p>Of.</p></article><footer><p>All rights reserved</p></footer></body></html>',
    '<html y="0"><body><header class="site-header"><h1>The Site</h1><p>The best there is, every day and every night.</p></header><div class="ad">Buy this now, it is cheap and good and you will want it.</div><main y="1"><article><h1>Title</h1><p>Some text with a <a href="x">link</a> in it and a good many words besides.</p><ul><li>First point of a list</li><li>Second point</li></ul><h2>Part</h2><p>More text.</p><aside y="0"><h3>Related</h3><p><a href="y">Another page that you may like</a></p></aside><div class="ad" y="0">Sponsored words of some length stand here</div></article></main><aside class="sidebar"><p>About the author of this page, who lives in a town.</p></aside><footer>Copyright of the owner</footer></body></html>',
    '<html y="0"><body><div class="cookie-notice"><p>We use cookies so that this page works as it should.</p><button>OK</button></div><div id="nav" class="menu"><a href="1">One</a> <a href="2">Two</a></div><div class="post" y="1"><h1>Title of the post</h1><div class="entry-content"><p>The text of the post is here, with quite a few words in it.</p><blockquote><p>Quoted words.</p></blockquote><pre>code here</pre><table><tr><td>1</td><td>two</td></tr></table></div></div><section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I liked this a lot, thank you for writing all of it down.</p></div><form class="reply"><p>Leave a reply</p></form></section><footer class="footer"><p>Contact us</p></footer></body></html>',
    '<html y="0"><body><nav class="breadcrumb"><ol><li><a href="a">Start</a></li><li>Here</li></ol></nav><main y="1"><header><h1>Heading in the text</h1><p>By someone</p></header><section><h2>First</h2><p>Words and words and words of a section that goes on and on.</p><figure><figcaption>What the picture shows</figcaption></figure></section><section><h2>Second</h2><p>Text.</p><ol><li>A step</li><li>Another step of some length, with all that has to be said</li></ol></section></main><section class="related"><h3>More</h3><ul><li><a href="p">A page</a></li></ul></section><form id="newsletter"><p>Sign up to get our letter every week</p></form><footer><div>Imprint</div></footer></body></html>',
    '<html y="0"><body><div class="banner notice"><p>This page will be down on Monday for some hours.</p></div><div id="content" y="1"><h1>Name</h1><p>Plain text on a plain page, in a division that says content.</p><dl><dt>Term</dt><dd>What the term means, in a sentence.</dd></dl><div class="share" y="0"><p>Share this</p></div><div class="promo" y="0"><p>Get a month for free if you come today and not tomorrow</p></div></div><div id="sidebar" class="widget"><ul><li><a href="t">Tag</a></li></ul></div><div class="comments"><ol><li><p>First! This is what a reader wrote under the page.</p></li></ol></div></body></html>',
    '<html y="0"><body><header><nav><a href="h">Home</a></nav></header><article y="1"><h1>Report</h1><p>It began with <b>bold</b> words and ended with plain ones, after a while.</p><div><p>A paragraph within a division.</p></div><h3>Small heading</h3><p>The end.</p><section class="comments" y="0"><h2>Replies</h2><article><p>A reply of a reader which is long enough to look like text of a page.</p></article></section></article><aside><div class="ad">Advert</div></aside><footer><ul><li><a href="i">Imprint</a></li></ul><p>More words in the footer of the page that nobody reads.</p></footer></body></html>',
    '<html y="0"><body><div y="1"><h2>Only a division</h2><p>No names anywhere, but long paragraphs of text that plainly are what the page is about.</p><p>A second one of the same kind follows it, as long as the first one was.</p></div><div><a href="1">One</a> | <a href="2">Two</a></div><form><p>Your name</p></form></body></html>',
    '<html y="0"><body><article y="1"><h1>What to do</h1><p>The text begins here, and goes on for as long as it has to.</p><div class="alert" y="0"><p>This page is out of date and will go away, so please read the new one.</p></div><p>Then it goes on with some more words, and a few after those.</p><div class="note"><p>A remark of the author that belongs to the text of the page.</p></div><div class="warning notice" y="0">We will be closed for the whole of next week, and then open again.</div><p>The end of it.</p><div class="feedback" y="0"><p>I have read this twice and liked it a lot, thank you very much.</p></div><div class="replies" y="0"><p>So did I, and I told all of my friends about it.</p></div></article><div class="popup" id="consent"><p>Please agree to what we do with all of your data.</p></div></body></html>',
    '<article y="1"><p>Few words.</p></article>',
    '<nav y="0"><a href="1">One</a></nav><article y="1"><h1>Name</h1><p>Two words</p><p>Of.</p></article><footer y="0">Us</footer>',
    '<article y="1"><h1>A name</h1><p>So it goes.</p></article><aside y="0"><p>Also here</p></aside>',
    '<p y="1">Only a paragraph.</p>',
]


_COMMENT_END = re.compile(r"--!?>")
_TAG_OPEN = re.compile(r"<[a-zA-Z/!?]")
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)")


class _Tree(HTMLParser):
    """Blocks of a page in document order: tag, hints, parent, label and text; and its text, in segments of one block each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.hint, self.parent, self.y = ["#"], [()], [-1], [None]
        self.chars, self.linked = [0], [0]
        self.segments: list[tuple[int, list[str]]] = []
        self.stack: list[tuple[str, int]] = [("#", 0)]
        # places in the stack: of each open tag, of blocks, and of what _end_open doesn't look behind
        self.places: dict[str, list[int]] = {}
        self.blocks, self.walls = [0], [0]
        self.silent = self.links = 0
        self.broken = True
        self.closing = self.torn = False

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in BLOCKS:
                self.broken = True
            elif tag == "br" and not self.silent:
                self.handle_data(" ")
            return
        if tag in BLOCKS:
            self._end_open(ENDS.get(tag, {"p"}))
        node = self.stack[-1][1]
        if tag in BLOCKS and not self.silent:
            a = dict(attrs)
            hints = {_HINT[w] for k in ("class", "id", "role") if a.get(k) for w in re.split(r"[^a-z]+", a[k].lower()) if w in _HINT}
            self.tag.append(tag)
            self.hint.append(tuple(sorted(hints)))
            self.parent.append(node)
            self.y.append(a.get("y", self.y[node]))
            self.chars.append(0)
            self.linked.append(0)
            node = len(self.tag) - 1
            self.broken = True
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        if tag in SCOPES or tag in SILENT:
            self.walls.append(len(self.stack))
        self.stack.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:  # HTML knows no other empty elements; foreign ones end here
            self.handle_endtag(tag)

    def _last(self, tag) -> int:
        return (self.places.get(tag) or [0])[-1]

    def _end_open(self, tags):
        while (i := max(map(self._last, tags))) and i >= self.walls[-1]:
            self._cut(i)

    def _cut(self, i):
        for t, _ in self.stack[i:]:
            self.silent -= t in SILENT
            self.links -= t == "a"
            self.broken |= t in BLOCKS
            self.places[t].pop()
        for some in (self.blocks, self.walls):
            while some[-1] >= i:
                some.pop()
        del self.stack[i:]

    def handle_endtag(self, tag):
        i = self._last(tag)
        if i and (tag in BLOCKS or i > self.blocks[-1]):  # an inline end tag doesn't reach out of its block
            self._cut(i)

    def handle_data(self, data):
        if self.silent:
            return
        node = self.stack[-1][1]
        if self.broken or not self.segments or self.segments[-1][0] != node:
            self.segments.append((node, []))
            self.broken = False
        self.segments[-1][1].append(data)
        n = len(data.strip())
        self.chars[node] += n
        self.linked[node] += n if self.links else 0

    def unknown_decl(self, data):
        return None

    def parse_marked_section(self, i, report=1):
        """What begins with <![ outside of foreign content is a comment up to the next >, whatever stands in it."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def parse_comment(self, i, report=1):
        """A comment that nothing ends goes on to the end of the page."""
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata) if self.closing else -1

    def parse_starttag(self, i):
        """A quotation mark that nothing closes ends with its tag; later tags are then read without their attributes."""
        if not self.torn:
            end = super().parse_starttag(i)
            if end >= 0 or not self.closing:
                return end
            self.torn = True
        end = self.rawdata.find(">", i)
        if name := _TAG.match(self.rawdata, i):
            self.handle_starttag(name[1].lower(), [])
        return end + 1 or len(self.rawdata)


def tree(html: str) -> _Tree:
    t = _Tree()
    # nothing ends a tag that begins after the last >
    cut = _TAG_OPEN.search(html, html.rfind(">") + 1)
    t.feed(html[: cut.start()] if cut else html)
    t.closing = True
    t.close()
    if t.rawdata and not t.silent:
        t.handle_data(t.rawdata)
    return t


def features(t: _Tree, i: int) -> list[str]:
    n, linked = t.chars[i], t.linked[i]
    return [f"tag={t.tag[i]}", *(f"hint={h}" for h in t.hint[i]), "links=" + ("none" if not linked else "some" if 2 * linked < n else "most"), "chars=" + ("none" if not n else "few" if n < 20 else "some" if n < 80 else "many")]


class Model:
    """Odds of content (state 1): of each feature, and for a child by its parent's state; counted from labelled pages, add-half smoothed."""

    def __init__(self, pages: list[str]):
        by, total, pairs, top = (Counter(), Counter()), [0, 0], Counter(), [0, 0]
        for page in pages:
            t = tree(page)
            for i in range(1, len(t.tag)):
                y = int(t.y[i])
                total[y] += 1
                by[y].update(features(t, i))
                if t.parent[i]:
                    pairs[int(t.y[t.parent[i]]), y] += 1
                else:
                    top[y] += 1
        self.odds = {f: (by[1][f] + 0.5) / (total[1] + 1) * (total[0] + 1) / (by[0][f] + 0.5) for f in {*by[0], *by[1]}}
        self.top = (top[1] + 0.5) / (top[0] + 0.5)
        self.psi = [[(pairs[p, y] + 0.5) / (pairs[p, 0] + pairs[p, 1] + 1) for y in (0, 1)] for p in (0, 1)]

    def marginals(self, t: _Tree) -> list[float]:
        """Probability of content by node: sum-product, leaves to root and back. Nodes stand after their parents."""
        n, psi = len(t.tag), self.psi
        own = [1.0] * n  # evidence as odds
        known: dict[tuple, float] = {}
        for i in range(1, n):
            c, linked = t.chars[i], t.linked[i]
            key = (t.tag[i], t.hint[i], (linked > 0) + (2 * linked >= c), (c > 0) + (c >= 20) + (c >= 80))
            if key not in known:
                known[key] = prod(self.odds.get(f, 1.0) for f in features(t, i))
            own[i] = known[key]
        below, up = own[:], [1.0] * n
        for i in range(n - 1, 0, -1):
            o = min(max(below[i], 1e-30), 1e30)
            up[i] = (psi[1][0] + psi[1][1] * o) / (psi[0][0] + psi[0][1] * o)
            if p := t.parent[i]:
                below[p] = min(max(below[p] * up[i], 1e-30), 1e30)
        belief = below[:]
        for i in range(1, n):
            if not t.parent[i]:  # elements without a parent are trees of their own
                belief[i] = min(max(below[i] * self.top, 1e-30), 1e30)
                continue
            rest = belief[t.parent[i]] / up[i]
            belief[i] = min(max(below[i] * (psi[0][1] + psi[1][1] * rest) / (psi[0][0] + psi[1][0] * rest), 1e-30), 1e30)
        return [b / (1 + b) for b in belief]


_models: list[Model] = []


def extract(html: str) -> str:
    if not _models:
        _models.append(Model(LABELLED))
    t = tree(html)
    content = _models[0].marginals(t)
    blocks = (" ".join("".join(parts).split()) for node, parts in t.segments if content[node] >= 0.5)
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points). Null and empty pages give the empty text; repeated rows each come back.

    Every page gives a row, whatever its markup: what cannot be read as markup is a comment or text. Pages are taken whole, in time that grows with
    their length; an empty table gives an empty result. Other columns play no part.
    """
    ship(pages.sparkSession)

    def of(batches):
        for b in batches:
            text = [extract(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(x) for x in text]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    out = rows.mapInPandas(of, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
