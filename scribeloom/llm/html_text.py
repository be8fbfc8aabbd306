"""Main text of web pages by tree scoring.

A page is read once into flat lists: nodes in page order, each with its parent,
and blocks of text, each with the node that holds it. Blocks pass points for
length and commas to their ancestors, less the further up; a node's points are
discounted by the share of its text that stands in links. The best node and its
good siblings are the article. All passes are linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|(?P<cut>\Z))|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|(?P<short>\Z))|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|[^<>]*+)>""",
    re.S,
)
# One attribute, name and value: the next match starts after it, so values are not searched for names.
ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
# Letters with a number or a size after them; what mixes them otherwise is made by a tool and says nothing.
CHUNK = re.compile(r"([A-Za-z]+)\d*(?:x\d+)?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "dialog", "svg", "canvas",
    "object", "audio", "video", "map", "datalist", "label", "fieldset",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PARAGRAPHS = {"p", "pre", "td", "th", "li", "dd", "dt", "blockquote", "figcaption", "caption", "summary", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# A start tag closes an open tag of these, up to the nearest tag of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"body"}),
}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu",
    "menubar", "toolbar", "note", "status",
}
# Words in class names and ids. A strong word names clutter whatever stands beside it.
STRONG = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "sponsors",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "navbar", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "disqus", "respond", "replies", "newsletter", "signup", "pagination", "outbrain", "taboola", "paywall",
}
UNLIKELY = {
    "banner", "promo", "promos", "promotion", "notice", "notices", "notification", "alert", "sidebar", "sidebars", "side", "rail", "nav",
    "navigation", "menu", "menus", "footer", "foot", "header", "masthead", "discussion", "share", "sharing", "social", "related",
    "recommended", "recommendations", "subscribe", "subscription", "login", "pager", "widget", "widgets", "toolbar", "skip", "tags",
}
# Strong words glued to others.
GLUED = re.compile(
    r"(?:ad|ads)(?:box|slot|unit|wrap|wrapper|container|block|banner|bar|space|zone|area|frame|holder|label|panel)"
    r"|(?:top|side|bottom|left|right|google|page|text|inline|header|footer)ads?"
    r"|(?:user|reader|site|post|article|page|blog)?comments?(?:list|box|form|area|section|thread|block|container|wrapper|body|text|s)?"
    r"|cookie(?:s|bar|banner|box|notice|consent|popup|info|law|message|wall|layer)+"
    r"|(?:site|page|main|global|blog|top|bottom)(?:footer|header|nav|navigation|menu|sidebar|banner)"
    r"|(?:left|right)(?:sidebar|nav|menu|rail)|(?:nav|menu|footer)(?:bar|menu|links|box|wrapper|container)|side(?:menu|links|box|nav)"
)
LIKELY = {"article", "content", "main", "body", "post", "entry", "text", "story"}
# A name with one of these tells of a state or the layout around it, as in has-sidebar and comments-closed.
STATES = {"with", "without", "has", "no", "is", "open", "opened", "closed", "enabled", "disabled", "layout"}
# What a footer without a name begins with.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I)
REACH = 5  # ancestors that get points
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0


def _is_clutter(tag: str, attrs: str) -> bool:
    """Whether a tag opens a part that isn't the article."""
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    names = []
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style":
            if HIDDEN.search(value):
                return True
        elif key == "role":
            if value.strip().lower() in ROLES:
                return True
        elif key in ("class", "id"):
            names.extend(value.split())
    return bool(names) and _names_clutter(names)


def _names_clutter(names: list[str]) -> bool:
    """Whether class names and ids say clutter: one strong word is enough; other
    words count unless another name is of the article's words alone."""
    weak = likely = False
    for name in names:
        chunks = [m[1] for x in re.split(r"[^A-Za-z0-9]+", name) if (m := CHUNK.fullmatch(x))]
        words = {x.lower() for chunk in chunks for x in NAME.findall(chunk)} | {chunk.lower() for chunk in chunks}
        if not words or words & STATES:
            continue
        if words & STRONG or any(GLUED.fullmatch(w) for w in words):
            return True
        weak = weak or bool(words & UNLIKELY)
        likely = likely or words <= LIKELY
    return weak and not likely


class _Page:
    """Nodes and blocks of one page."""

    def __init__(self, html: str):
        self.parent, self.tags = [-1], ["#page"]
        self.blocks: list[tuple[int, str, int]] = []  # holder, text, length in links
        self._stack, self._open = [0], Counter()
        self._holders = [0]  # the blocks of the stack
        self._dead = 0  # place in the stack of the outermost clutter, or 0
        self._links = 0
        self._text: list[str] = []
        self._link_chars = 0
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._holders[-1], text, self._link_chars))
            self._text, self._link_chars = [], 0

    def _add(self, raw: str) -> None:
        if not self._dead:
            text = unescape(raw)
            self._text.append(text)
            if self._links:
                self._link_chars += len(text.strip())

    def _pop_to(self, place: int) -> None:
        """Close all tags from this place of the stack on."""
        for n in self._stack[place:]:
            self._open[self.tags[n]] -= 1
            self._links -= self.tags[n] == "a"
            if self.tags[n] in BLOCKS:
                self._holders.pop()
        del self._stack[place:]
        if self._dead >= len(self._stack):
            self._dead = 0

    def _close(self, tags: set[str], until: set[str]) -> None:
        if any(self._open[t] > 0 for t in tags):
            outermost = None
            for place in range(len(self._stack) - 1, 0, -1):
                tag = self.tags[self._stack[place]]
                if tag in until:
                    break
                if tag in tags:
                    outermost = place
            if outermost:
                self._pop_to(outermost)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if self._open["p"] > 0:
                self._close({"p"}, BLOCKS - {"p"})
        elif tag == "br" and not self._dead:
            self._text.append(" ")
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag == "a" and self._links > 0:
            self._close({"a"}, BLOCKS)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            return
        self.parent.append(self._stack[-1])
        self.tags.append(tag)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] += 1
        self._links += tag == "a"
        if tag in BLOCKS:
            self._holders.append(self._stack[-1])
        if not self._dead and _is_clutter(tag, attrs):
            self._dead = len(self._stack) - 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self._open[tag] > 0:
            self._pop_to(next(i for i in range(len(self._stack) - 1, 0, -1) if self.tags[self._stack[i]] == tag))

    def _read(self, html: str) -> None:
        # Behind the last > no tag ends, so none is looked for: the pass stays linear.
        at, close = 0, html.rfind(">") + 1
        while m := TOKEN.search(html, at, close):
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if m["tag"]:
                tag = m["tag"].lower()
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at, close)
                    at = end.end() if end else len(html)
                else:
                    self._start(tag, m["attrs"])
            elif m["end"]:
                self._end(m["end"].lower())
            elif m["cut"] is not None:
                at = len(html)
            elif m["data"] is not None:
                if m["short"] is not None:
                    at = len(html)
                end = m.end("data") if m["short"] is None else at
                self._add(html[m.start("data") : end].replace("&", "&amp;"))
        rest = html[at:]
        if m := re.search(r"<!--|<!\[CDATA\[", rest):
            self._add(rest[: m.start()])
            if m[0] != "<!--":
                self._add(rest[m.end() :].replace("&", "&amp;"))
        elif rest:
            self._add(rest)
        self._flush()


def main_text(html: str | None) -> str:
    """The blocks of the article, one a line; empty if there is none.

    A null or empty page has no text. Of equally good nodes the first one wins.
    The article is the `article` or else the `main` that the best node lies in,
    or else the node itself, with its good siblings: those with points and, beside
    a node that is neither, those with a paragraph, list item or cell of two words
    or more that isn't links or a line of rights. A heading behind the node goes with the sibling after it.
    A `header` goes with all it holds, in an article as well.
    """
    if not html:
        return ""
    page = _Page(html)
    size = len(page.tags)
    points, chars, linked = [0.0] * size, [0] * size, [0] * size
    for holder, text, in_links in page.blocks:
        chars[holder] += len(text)
        linked[holder] += min(in_links, len(text))
        score = text.count(",") + min(len(text) / 100, 3.0) + (len(text) >= 25)
        score *= 1 - min(1.0, in_links / len(text))
        node = page.parent[holder] if page.tags[holder] in PARAGRAPHS and holder else holder
        for level in range(REACH):
            if node < 0:
                break
            points[node] += score / (1, 2, 6, 9, 12)[level]
            node = page.parent[node]
    for n in range(size - 1, 0, -1):
        chars[page.parent[n]] += chars[n]
        linked[page.parent[n]] += linked[n]
    density = [linked[n] / chars[n] if chars[n] else 0.0 for n in range(size)]
    final = [points[n] * (1 - density[n]) for n in range(size)]
    best = max(range(size), key=final.__getitem__)
    if not page.blocks or final[best] <= 0:
        return ""
    home = False
    for tag in ("article", "main"):
        node = best
        while node > 0 and page.tags[node] != tag:
            node = page.parent[node]
        if node > 0:
            best, home = node, True
            break
    told = [False] * size  # some paragraph below says something
    for holder, text, in_links in page.blocks:
        if page.tags[holder] in PARAGRAPHS and " " in text and 2 * in_links < len(text) and not RIGHTS.match(text):
            told[holder] = True
    for n in range(size - 1, 0, -1):
        told[page.parent[n]] |= told[n]
    kept = [False] * size
    kept[best] = True
    least = max(SIBLING_LEAST, SIBLING_SHARE * final[best])
    after = False  # whether the next sibling with text is kept
    for n in range(size - 1, 0, -1):
        if page.parent[n] == page.parent[best] and chars[n]:
            if n != best:
                plain = density[n] < 0.25
                heading = page.tags[n] in HEADINGS
                kept[n] = plain and (n < best or after) if heading else final[n] >= least or plain and told[n] and not home
            after = kept[n]
    for n in range(1, size):
        kept[n] = kept[n] or kept[page.parent[n]]
    return "\n".join(text for holder, text, _ in page.blocks if kept[holder])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of every page as column `text`.

    Other columns stay. Null and empty pages give an empty text; repeated rows
    are read one by one; an empty table stays empty. Work is by row, without a
    shuffle; a lost task is read again.
    """

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(None if page is None else page) for page in batch], dtype=object)

    return pages.withColumn(text, read(F.col(f"`{html}`")))


def op1(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
