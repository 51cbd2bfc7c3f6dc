"""Main text of web pages by tree scoring.

The page is parsed into a tree; every paragraph-like block gives points (one, one per comma, one per hundred characters up to
three) to its parent and half of them to its grandparent; a container's sum is discounted by its link density and moved by
what its tag, class and id say. The best container is kept, with those siblings that score near it or read like prose; inside
what is kept, menus, forms, scripts, notices, adverts, comments and the like are left out.

Class and id names of boilerplate leave a block out, but not one that holds the article itself or most of the page's text, nor prose inside
an article that only part of a name marks ("related-work"; not "related-posts", whose other part says nothing about a subject). Names that
an article's own blocks may bear as well (side, legal, discussion and others), and headers, leave out only what lies outside an article
or is mostly links. A list of links is a menu, unless it stands between paragraphs or is announced by a colon.

Parsing takes time in proportion to the page, whatever it holds: end tags and implied ends are looked up, not searched for.

Defined results: null, empty or tag-free html gives the text it has ("" if none); unclosed and misnested tags are closed as
browsers close them; a tag that the page's end cuts off is no text; a quote that is never closed does not hide what follows its tag;
references without a semicolon or cut off are decoded as html.unescape decodes them; repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import small_batches

# Element names of the HTML standard, by how they are parsed, and name parts that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
DROPPED = frozenset("script style noscript template iframe noembed noframes object embed svg math canvas audio video head title nav aside footer button select textarea input dialog menu".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
POINTS_FROM = frozenset("p pre td blockquote li dd".split()) | HEADS
ARTICLES = frozenset("article main".split())
COMMENTS = "comment comments commentlist disqus reply replies respond".split()
STRONG = COMMENTS + (
    "ad ads adv advert advertisement advertising adsense banner promo promotion sponsor sponsored breadcrumb breadcrumbs cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup login footer masthead menu nav navbar navigation pagination pager related recommended recommendations "
    "share sharing social sidebar widget toolbar topbar copyright disclaimer outbrain taboola"
).split()
FILLING = "area bar block body box btn button card cell col column container content count desc entry feed footer form grid group head header heading holder icon inline inner item link list main meta more outer panel post row section slot stories story tag teaser text thread title tools top bottom unit wrap wrapper zone".split()
WEAK = "discussion foot head header legal rail register side skip tagcloud tags toc".split()
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog)(?=$|[\s_-])", re.I)

#: Implied ends: a start tag of a kind closes the nearest open element of its kind unless a wall is nearer.
KINDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "p": (frozenset(("p",)), BLOCK - {"p"}),
    "li": (frozenset(("li",)), frozenset("ul ol menu table".split())),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "td": (frozenset(("td", "th")), frozenset(("table",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "head": (frozenset(("head",)), frozenset(("body",))),
    "cell": (frozenset(("td", "th", "table")), frozenset()),
}
KIND_OF = {"li": "li", "dt": "dd", "dd": "dd", "td": "td", "th": "td", "tr": "tr", "option": "option", "body": "head", "article": "head", "main": "head"}
MARKED = {tag: [k for k, (tags, walls) in KINDS.items() if tag in tags or tag in walls] for tag in {t for tags, walls in KINDS.values() for t in tags | walls}}

OTHER = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*(?:>|\Z)|<![^>]*(?:>|\Z)|</>", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r">|=\s*[\"']")
ATTR = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


def _names(words: list[str]) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words)})s?(?=$|[\s_-]|\d)", re.I)


BOILERPLATE, PERHAPS, COMMENT = _names(STRONG), _names(WEAK), _names(COMMENTS)
#: A name that has no word beside those of boilerplate and of layout.
WHOLE = re.compile(rf"(?=.*(?:^|[_-])(?:{'|'.join(STRONG)})s?(?:$|[_-]|\d))(?:(?:{'|'.join(STRONG + FILLING)})s?\d*(?:[_-]+|$)|\d+(?:[_-]+|$))+", re.I)
#: Inside an article, a block with a name in part of boilerplate is prose from so many characters on.
PROSE = 100
#: Why an element is left out: it never holds text of the article; its name says so, if it does not hold the article.
NEVER, NAMED = 2, 1


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "score", "chars", "link_chars", "links", "bad", "weak", "comment", "partly", "holds", "inside", "raw", "depth", "marks")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.score, self.chars, self.link_chars, self.links = 0.0, 0, 0, 0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.marks = parent.marks if parent is not None else {}
        if tag in MARKED:
            self.marks = self.marks | dict.fromkeys(MARKED[tag], self)
        self.holds = self.inside = self.partly = False
        self.raw = 0.0
        self.bad, self.weak, self.comment = NEVER if tag in DROPPED else NAMED if tag == "form" else 0, tag == "header", False
        if attrs and tag not in ("html", "body"):
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
            self.comment = bool(COMMENT.search(names))
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
                self.bad = NEVER
            elif self.comment or tag not in ARTICLES and (attrs.get("role", "").lower() in ROLES or bool(BOILERPLATE.search(names))):
                self.partly = not self.bad and attrs.get("role", "").lower() not in ROLES and not any(WHOLE.fullmatch(name) for name in names.split())
                self.bad = max(self.bad, NAMED)
            self.weak = self.weak or tag not in ARTICLES and bool(PERHAPS.search(names))


class _Tags:
    """Where tags end; a quote opens only behind an equals sign, and only if it is closed somewhere."""

    def __init__(self, html: str):
        self.html, self.last = html, {q: html.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place behind the tag, or -1 if the page ends before."""
        while (m := QUOTE_OR_END.search(self.html, at)) is not None:
            if m[0] == ">":
                return m.end()
            at = m.end()
            if at <= self.last[m[0][-1]]:
                at = self.html.index(m[0][-1], at) + 1
        return -1


def parse(html: str) -> Node:
    """The tree of a page; tolerant of anything."""
    root = node = Node("#root", {}, None)
    at, end, tags = 0, len(html), _Tags(html)
    opened: dict[str, list[Node]] = defaultdict(list)
    never_shut: set[str] = set()

    def close(upto: Node) -> Node:
        """Close what is open below and including `upto`; each element is closed once."""
        here = node
        while here is not upto.parent:
            opened[here.tag].pop()
            here = here.parent
        return here

    def implied(kind: str) -> Node:
        mark = node.marks.get(kind)
        return close(mark) if mark is not None and mark.tag in KINDS[kind][0] else node

    while at < end:
        start = html.find("<", at)
        if start < 0:
            node.items.append(html[at:])
            break
        m = NAME.match(html, start)
        if m is None:
            other = OTHER.match(html, start)
            if other is None:
                node.items.append(html[at : start + 1])
                at = start + 1
                continue
            if start > at:
                node.items.append(html[at:start])
            if other[0].startswith("<![CDATA["):
                node.items.append(other[0][9:].removesuffix("]]>"))
            at = other.end()
            continue
        if start > at:
            node.items.append(html[at:start])
        at = tags.end(m.end())
        if at < 0:
            break  # a tag that is cut off is no text
        tag, inner = m[2].lower(), html[m.end() : at - 1]
        if m[1]:
            if opened[tag]:
                wall = node.marks.get("cell")
                if tag in BLOCK or wall is None or opened[tag][-1].depth > wall.depth:
                    node = close(opened[tag][-1])
            continue
        attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTR.findall(inner)} if inner and not inner.isspace() else {}
        if tag in CLOSES_P:
            node = implied("p")
        if tag in KIND_OF:
            node = implied(KIND_OF[tag])
        child = Node(tag, attrs, node)
        node.items.append(child)
        if tag in VOID or inner.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            shut = None if tag in never_shut else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if shut is None:
                never_shut.add(tag)
            at = shut.end() if shut else end if tag in ("script", "style") else at
            continue
        opened[tag].append(child)
        node = child
    return root


def _ordered(root: Node, worst: int = 0) -> list[Node]:
    """All elements that are not left out (or no more than `worst`), parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(x for x in reversed(n.items) if isinstance(x, Node) and x.bad <= worst)
    return out


def _spare(root: Node) -> None:
    """Take back elements whose names mark them although the article is in them, and mark the doubtful ones outside of it."""
    nodes = _ordered(root, NAMED)
    for n in reversed(nodes):
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(x.strip())
            elif x.bad <= NAMED:
                n.chars += x.chars
                n.link_chars += x.chars if x.tag == "a" else x.link_chars
    for n in nodes:
        if n.partly and n.parent.inside and n.chars >= PROSE and 3 * n.link_chars < n.chars:
            n.bad, n.comment = 0, False
        n.inside = n.tag in ARTICLES and not n.bad or n.parent is not None and n.parent.inside and not n.bad
        if n.weak and not n.inside:
            n.bad = NAMED
    for n in reversed(nodes):
        n.holds = n.tag in ARTICLES and not n.bad or any(not isinstance(x, str) and x.bad <= NAMED and x.holds and not x.comment for x in n.items)
    for n in nodes:
        if n.bad and (n.holds or not root.holds and not n.comment and 2 * n.chars > root.chars):
            n.bad = 0
    for n in nodes:
        n.chars = n.link_chars = 0


def _score(nodes: list[Node]) -> None:
    own_commas: dict[int, int] = {}
    for n in reversed(nodes):
        commas = 0
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(x.strip())
                commas += x.count(",") + x.count("，") + x.count("、")
            elif not x.bad:
                n.chars += x.chars
                n.link_chars += x.chars if x.tag == "a" else x.link_chars
                n.links += x.links + (x.tag == "a")
                commas += own_commas.get(id(x), 0)
        own_commas[id(n)] = commas
        direct = any(isinstance(x, str) and x.strip() for x in n.items)
        if n.chars and (n.tag in POINTS_FROM or n.tag in ("div", "section", "article", "main", "body", "#root") and direct):
            points = (1 + commas + min(n.chars // 100, 3)) * (1 - n.link_chars / n.chars)
            if n.weak:
                points /= 2
            up = n.parent if n.tag in POINTS_FROM else n
            if up is not None:
                up.score += points
                if up.parent is not None:
                    up.parent.score += points / 2
    for n in nodes:
        n.raw = n.score
        if n.tag in ARTICLES:
            n.score += 25
        elif n.attrs and GOOD.search(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"):
            n.score += 15
        if n.chars:
            n.score *= 1 - n.link_chars / n.chars
            n.raw *= 1 - n.link_chars / n.chars


def _kept(nodes: list[Node]) -> list[Node | str]:
    """The best container, siblings that belong to it and loose text between them, in page order."""
    best = None
    for n in nodes:
        if (n.tag in BLOCK or n.tag == "#root") and n.chars and (best is None or n.score > best.score):
            best = n
    if best is None:
        return nodes[:1]
    while best.parent is not None and best.tag not in ("article", "main", "body", "div", "section", "td", "#root"):
        best = best.parent
    around = best.parent
    if around is None:
        return [best]
    # what a name says of the best one says nothing against those beside it; an article element does
    near = (lambda x: x.score >= max(10.0, best.score * 0.2)) if best.tag in ARTICLES else (lambda x: x.chars and x.raw >= best.raw * 0.2)
    kept: list[Node | str] = []
    loose: list[str] = []
    for x in around.items:
        if isinstance(x, str):
            loose.append(x)
            continue
        if x.bad:
            continue
        density = x.link_chars / x.chars if x.chars else 1
        prose = x.tag == "p" and (x.chars > 80 and density < 0.25 or 0 < x.chars <= 80 and density == 0)
        if x is best or near(x) and density < 0.5 or prose and best.tag not in ARTICLES:
            if kept:
                kept.extend(loose)
            loose.clear()
            kept.append(x)
    return kept


def _menu(n: Node) -> bool:
    """A list or block that is all links."""
    return n.tag in ("ul", "ol", "dl", "div", "section", "table", "p") and n.chars > 0 and n.link_chars >= 0.8 * n.chars and n.links > 2


def _announced(items: list[Node | str]) -> set[int]:
    """Places of lists of links that belong to the text: after a paragraph that ends in a colon, or between paragraphs."""
    there = [(i, x) for i, x in enumerate(items) if (x.strip() if isinstance(x, str) else not x.bad and x.chars)]
    prose = [isinstance(x, str) or x.tag in ("p", "blockquote", "pre") and 2 * x.link_chars < x.chars for _, x in there]
    out, after = set(), False
    for k in range(len(there) - 1, -1, -1):
        i, x = there[k]
        if k and prose[k - 1] and isinstance(x, Node) and _menu(x) and (after or _last_char(there[k - 1][1]) in ":："):
            out.add(i)
        after = after or prose[k]
    return out


def _last_char(x: Node | str) -> str:
    while not isinstance(x, str):
        x = next((y for y in reversed(x.items) if (y.strip() if isinstance(y, str) else not y.bad and y.chars)), "")
    return x.strip()[-1:] or " "


def blocks(tops: list[Node | str]) -> list[str]:
    """The text blocks under the given elements, in page order; white space inside a block is one space."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        text = SPACE.sub(" ", unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = list(reversed(tops))
    spared = {id(x) for x in tops}
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.bad or id(x) not in spared and (_menu(x) or x.weak and 2 * x.link_chars > x.chars):
            continue
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            if x.links > 2:
                spared.update(id(x.items[i]) for i in _announced(x.items))
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page, blocks joined by newlines."""
    if not html:
        return ""
    root = parse(html)
    _spare(root)
    nodes = _ordered(root)
    _score(nodes)
    return "\n".join(blocks(_kept(nodes)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([main_text(h) for h in htmls], dtype=object)

    return pages.select("page_id", "url", text_of(F.col(html_col)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
