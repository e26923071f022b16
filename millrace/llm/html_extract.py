"""Main text of web pages by tree scoring.

A page becomes a tree of block elements. Each block of text passes points for its length and its
commas to its ancestors, less with each level; a container's points are discounted by its share
of link text. The best container, or the article or main element that it lies in, is kept with those
of its siblings that read like the same article, and so are, at each level above, containers that score
like it or have its shape: an article split over several wrappers is one text. Subtrees that are page furniture
go. A form is furniture unless it holds most of the page's plain text, which stands in no furniture and beside no visible control: a server may wrap pages in one. The same
goes for an element whose class has words of an article and of furniture at once.

Defined results: a null or empty page, a page without text, and a page with furniture only give
an empty text; broken and unclosed markup is read as browsers do, closing what the new tag ends;
very long pages are read whole; repeated rows give repeated results; other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ship

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"\s+")

#: Elements whose content is text to be thrown away up to their end tag.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "video", "audio", "select", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never part of an article.
_FURNITURE = {"nav", "header", "footer", "aside", "button", "dialog", "menu", "head", "fieldset", "search"}
_FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note", "status"}
#: Words in a class or id that mark page furniture.
_FURNITURE_WORDS = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "advertorial", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "consent", "feedback", "reactions", "responses", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pager", "pagination", "popup", "popups", "promo", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Of these, words that name a part of an article too, where a word of an article stands beside them.
_LAYOUT_WORDS = {"banner", "header", "masthead", "skip"}
#: Words of an article's own container.
_ARTICLE_WORDS = {"article", "content", "main", "post", "story", "entry", "body"}
#: An opening tag that closes an open element of the second set.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
_CONTROLS = {"input", "select", "textarea", "button"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "body": set()}
_NO_P_CLOSE = {"head", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button"}


class _Node:
    __slots__ = ("children", "controls", "furniture", "link", "parent", "points", "size", "tag", "words")

    def __init__(self, tag: str, parent: _Node | None, furniture: bool = False, words: frozenset = frozenset()):
        self.tag, self.parent, self.furniture, self.words = tag, parent, furniture, words
        self.children: list = []  # nodes, and (text, is a link) pairs
        self.points, self.size, self.link, self.controls = 0.0, 0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _marks(attributes: str, tag: str) -> tuple[bool, bool, frozenset]:
    """Whether the attributes mark page furniture for sure, whether they do beside words of an article, and the words of class and id."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, False, frozenset()
    a = _attributes(attributes)
    words = frozenset(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()))
    marked, article = words & _FURNITURE_WORDS, bool(words & _ARTICLE_WORDS)
    bad = bool(marked) and not article
    bad |= a.get("role", "").lower() in _FURNITURE_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
    bad |= bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))
    own = tag in ("body", "html", "article", "main")
    return bad and not own, article and bool(marked - _LAYOUT_WORDS) and not own, words


def parse(page: str) -> _Node:
    """The tree of block elements; inline markup leaves only its text and whether it is a link."""
    root = node = _Node("#root", None)
    at, links, n = 0, 0, len(page)
    open_to_doubt: list[_Node] = []
    while at < n:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            node.children.append((page[at:upto], links > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _CONTROLS and not closing and (tag != "input" or _attributes(m[3]).get("type", "").strip().lower() != "hidden"):
            node.controls += 1
        if tag in _RAW and not closing:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            node.children.append((" ", False))
        elif tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag in _VOID:
            if tag in ("br", "hr", "img", "wbr"):
                node.children.append((" " if tag != "wbr" else "", False))
        elif tag in _BLOCK:
            links = 0
            if closing:
                up = node
                while up is not root and up.tag != tag:
                    up = up.parent
                if up is not root:
                    node = up.parent
                elif tag == "p":
                    pass
                continue
            if tag not in _NO_P_CLOSE and node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                node = node.parent
            if tag in _CLOSES:
                up = node
                while up is not root and up.tag not in _CLOSES[tag] and up.tag not in _SCOPE[tag] and up.tag not in ("table", "article", "main", "body"):
                    up = up.parent
                while up is not root and up.tag in _CLOSES[tag]:
                    node = up = up.parent
            bad, mixed, words = _marks(m[3], tag)
            child = _Node(tag, node, bad or tag in _FURNITURE, words)
            node.children.append(child)
            if (tag == "form" or mixed) and not child.furniture:
                open_to_doubt.append(child)
            if not m[3].endswith("/") or tag in ("p", "div"):
                node = child
    if open_to_doubt:
        whole = _plain(root)
        for x in open_to_doubt:
            x.furniture = 2 * _plain(x) <= whole
    return root


def _plain(node: _Node) -> int:
    """Characters below a node that stand in no furniture and in no element with a visible control of its own."""
    text, stack = 0, [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if type(c) is tuple:
                text += 0 if x.controls else len(c[0].strip())
            elif not c.furniture:
                stack.append(c)
    return text


def _clean(text: str) -> str:
    return _SPACES.sub(" ", html.unescape(text)).strip()


def _score(root: _Node) -> list[_Node]:
    """Give every container its points, text size and link size; the containers that got points."""
    scored: list[_Node] = []
    stack: list[tuple[_Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if node.furniture:
            continue
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if type(c) is _Node]
            continue
        own = " ".join(c[0] for c in node.children if type(c) is tuple)
        text = _clean(own) if own and not own.isspace() else ""
        node.size += len(text)
        node.link += sum(len(_clean(c[0])) for c in node.children if type(c) is tuple and c[1])
        if text:
            points = 1 + text.count(",") + text.count("、") + min(len(text) / 100, 3)
            inner = node.tag in ("p", "pre", "td", "th", "blockquote", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption")
            if node.tag[0] == "h" and node.tag[1:].isdigit():
                points = 1
            up, share = (node.parent if inner else node), 1.0
            for level in range(4):
                if up is None or up.tag == "#root" and level:
                    break
                if not up.points:
                    scored.append(up)
                up.points += points * share
                up, share = up.parent, (0.5 if level == 0 else share / 3)
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.link += node.link
    return scored


def _final(node: _Node) -> float:
    bonus = 1.5 if node.tag in ("article", "main") else 0.6 if node.tag in ("ul", "ol", "dl") else 1.0
    if node.words & _ARTICLE_WORDS:
        bonus *= 1.25
    return node.points * bonus * (1 - min(1.0, node.link / node.size) if node.size else 0.0)


def _blocks(node: _Node, out: list[str], spare: set[int] | None = None) -> None:
    """Append the text blocks below a node in page order; text around a nested block makes blocks of its own.

    With ``spare``, containers that are mostly links go, but for those numbered in it.
    """
    stack: list = [node]
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _clean("".join(run))
            run.clear()
            if text:
                out.append(text)

    while stack:
        x = stack.pop()
        if type(x) is tuple:
            run.append(x[0])
        elif x is None:
            flush()
        elif not x.furniture and (spare is None or id(x) in spare or 2 * x.link < x.size or not x.size):
            flush()
            stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def _shape(node: _Node) -> tuple:
    """Tag and class words of a node, and the tags below it by first containers down to the first block of text."""
    tags, x = [], node
    while x is not None:
        tags.append(x.tag)
        if any(type(c) is tuple and not c[0].isspace() for c in x.children):
            break
        x = next((c for c in x.children if type(c) is _Node and not c.furniture), None)
    return node.words, tuple(tags)


def _beside(c: _Node, best: _Node, most: float) -> bool:
    """Whether a sibling of the best container belongs to its article."""
    density = c.link / c.size
    same = bool(c.words) and c.words == best.words
    return (
        _final(c) + (0.2 * most if same else 0) >= max(10.0, most * 0.2) and density < 0.5
        or c.tag == "p" and c.size > 80 and density < 0.25
        or c.tag in ("h1", "h2", "h3") and density < 0.25
    )


def _above(c: _Node, path: _Node, most: float) -> bool:
    """Whether a container beside an ancestor (``path``) of the best one is another part of the article."""
    if c.tag not in ("div", "section", "article", "td", "tr", "table", "tbody") or c.link * 4 >= c.size:
        return False
    high, stack = 0.0, [c]
    while stack:
        x = stack.pop()
        high = max(high, _final(x))
        stack += [k for k in x.children if type(k) is _Node and not k.furniture]
    return high >= max(10.0, most * 0.2) or high >= 1.5 and _shape(c) == _shape(path)


def extract(page: str | None) -> str:
    """The main text of one page: its blocks joined by line ends, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    scored = _score(root)
    if not scored:
        return ""
    best = max(scored, key=_final)
    most = _final(best)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    own = next((k for k, x in enumerate(path) if x.tag in ("article", "main")), 0)
    out: list[str] = []
    # From the root down, with the parts before and after the best container in page order.
    after: list[list[_Node]] = []
    for k in range(len(path) - 1, own, -1):
        inner = path[k - 1]
        kept = [c if c is inner or not c.furniture and c.size and (_beside(c, best, most) if k == 1 else _above(c, inner, most)) else None for c in path[k].children if type(c) is _Node]
        at = kept.index(inner)
        for c in kept[:at]:
            if c is not None:
                _blocks(c, out)
        after.append([c for c in kept[at + 1 :] if c is not None])
    _blocks(path[own], out, {id(x) for x in path[: own + 1]} if own else None)
    for parts in reversed(after):
        for c in parts:
            _blocks(c, out)
    return "\n".join(out)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_SCHEMA)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``; one pass, no shuffle."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
