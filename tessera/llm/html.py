"""Main text of web pages by tree scoring.

A page is parsed into a tree (forgiving: unclosed tags end where HTML says
they do).  Parts that cannot be the article are left out: navigation, headers,
footers, sidebars, forms, scripts, styles, adverts, notices, comment sections,
by tag and role, and containers by the whole names of their class and id.  A
form, or a container named like a part of the layout, stays if it holds most of
the page's text outside of links; if no text at all is left without them, they
stay.  What is named as comments or adverts never does.  Every paragraph gives
points for its length and its commas to its parent, half of them to the
grandparent, a third to the ancestor above; a container's points are
discounted by its link density.  The best container is kept, together with
those of its siblings that score close to it or are paragraphs of prose.  What
is kept is returned whole: headings and short paragraphs too.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one newline.

Each page is worked on by itself, from the whole html.  Defined cases: null or
empty html, or a page without text, gives an empty text; repeated rows are
separate rows; null ids and urls stay null; equal scores go to the container
that comes first; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, load, pick

# One token: a comment, a declaration, or a tag with quoted attribute values.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")

RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block of text.
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
         "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
         "th", "thead", "title", "tr", "ul"}
#: A start tag on the left ends an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
          "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body", "html", "td", "th", "blockquote", "form",
         "aside", "nav", "header", "footer", "figure", "select"}
#: Never part of the article.
DROP = RAW | {"head", "nav", "footer", "aside", "button", "select", "input", "object", "embed", "svg", "canvas",
              "dialog", "menu", "label", "audio", "video", "map"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu",
              "menubar", "form", "toolbar", "note"}
#: Names (classes or ids) of other parts of the page.
DROP_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
              "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside",
              "footer", "footnav", "header", "masthead", "topbar", "toolbar", "comment", "comments", "feedback", "commentlist", "disqus",
              "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
              "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share",
              "sharing", "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "search",
              "copyright", "legal", "disclaimer", "skip", "toc", "rail", "outbrain", "taboola"}
#: Of these, what has text of its own but is never the article, however long.
FOREIGN_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "comment",
                 "comments", "feedback", "commentlist", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr",
                 "outbrain", "taboola"}
#: In a compound: words for a container, which say nothing by themselves, and
#: words for a state or for the article, which say it is another thing.
NEUTRAL_WORDS = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content",
                 "form", "global", "group", "holder", "inner", "item", "items", "left", "link", "links", "list", "main", "module",
                 "outer", "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "thread", "top",
                 "unit", "wrap", "wrapper"}
STATE_WORDS = {"has", "no", "non", "not", "with", "without", "is", "show", "hide", "toggle", "fixed", "sticky", "open", "closed"}
ARTICLE_WORDS = {"article", "entry", "post", "story", "hentry", "text"}
#: Elements that a name can leave out.
NAMED = {"div", "section", "ul", "ol", "dl", "table", "header", "details", "figure", "center", "address", "span", "iframe", "ins"}
#: Link density of a container that may stay.
LINKED = 0.33
#: Elements whose text scores.
PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd"}


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "named", "score", "chars", "link_chars")

    def __init__(self, tag, parent, drop=False, named=0):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.named = named  # 1: named like a part of the layout, 2: like a foreign part
        self.children: list = []
        self.score = 0.0
        self.chars = self.link_chars = 0


@lru_cache(maxsize=10_000)
def marks(name: str) -> int:
    """What one class or id names: 2 a foreign part of the page, 1 a part of
    its layout, 0 anything else.  A compound names such a part by its last
    word, or by its first if words for containers follow."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if not words or not STATE_WORDS.isdisjoint(words):
        return 0
    head = words[-1]
    if head not in DROP_WORDS:
        head = words[0]
        if not all(w in DROP_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
            return 0
        head = next((w for w in words if w in DROP_WORDS), "")
    foreign = not FOREIGN_WORDS.isdisjoint(words)
    if not head or not foreign and not ARTICLE_WORDS.isdisjoint(words) and head in ("header", "masthead", "banner"):
        return 0  # the article's own header
    return 2 if foreign else 1


def unwanted(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is left out by its tag or role, and what its class
    and id name."""
    if tag in DROP:
        return True, 0
    named = 1 if tag == "form" else 0
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, named
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for one in value.split():
                got = marks(one)
                # A text block goes by a foreign name alone, a container by any.
                if got == 2 or got and tag in NAMED:
                    named = max(named, got)
        elif name == "role" and value in DROP_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, 0
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0
    return False, named


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and the elements named like other parts of the page."""
    root, marked = Node("#root", None), []
    at, node, pos = root, root, 0
    while True:
        m = TOKEN.search(page, pos)
        text = page[pos:m.start()] if m else page[pos:]
        if text:
            at.children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root, marked
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            at = _end(at, tag)
            continue
        if tag in BLOCK:
            at = _close(at, {"p"}) if tag != "body" else at
        if tag in CLOSES:
            at = _close(at, CLOSES[tag])
        drop, named = unwanted(tag, m[3])
        if tag == "header" and not drop:
            drop = not _inside(at, "article")
        node = Node(tag, at, drop, named)
        if named and not drop:
            marked.append(node)
        if tag in ("h1", "main"):
            up = at
            while up is not None:  # what holds the title is judged by its text, whatever its name
                up.named = min(up.named, 1)
                up = up.parent
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/") or tag in ("p", "div", "a", "span"):
            at = node


def _inside(node: Node | None, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _close(at: Node, tags: set) -> Node:
    """Leave the nearest open element of ``tags`` inside the present scope."""
    node = at
    while node.parent is not None and node.tag not in SCOPE - tags:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return at


def _end(at: Node, tag: str) -> Node:
    node = at
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if node.tag in SCOPE and tag not in SCOPE:
            return at  # an end tag of a small element does not leave its container
        node = node.parent
    return at


def measure(root: Node) -> list[Node]:
    """Sets chars and link_chars of every kept node; returns them in page order."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str) and not c.drop]
    for n in reversed(order):
        n.chars = n.link_chars = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(SPACE.sub(" ", c).strip())
            elif not c.drop:
                n.chars += c.chars
                n.link_chars += c.link_chars
        if n.tag == "a":
            n.link_chars = n.chars
    return order


def leave_out_named(root: Node, named: list[Node]) -> None:
    """Sets drop of the named containers (in page order) that are no part of
    the article."""
    layout = [n for n in named if n.named == 1]
    for n in named:
        n.drop = n.named == 2
    if not layout:
        return
    measure(root)
    whole = root.chars - root.link_chars
    for n in layout:  # what lies in a container that stays is judged by itself
        n.drop = 2 * (n.chars - n.link_chars) <= whole or link_density(n) > LINKED


def flat_text(node: Node) -> str:
    """Text of a node's own blocks, as one string."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif not n.drop:
            todo += reversed(n.children)
    return SPACE.sub(" ", "".join(out)).strip()


def blocks(node: Node) -> list[str]:
    """The node's blocks of text in page order."""
    out, run, todo = [], [], [node]
    cut = object()

    def flush():
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    while todo:
        n = todo.pop()
        if n is cut:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif n.drop:
            continue
        elif n.tag == "br":
            run.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                todo.append(cut)
            todo += reversed(n.children)
    flush()
    return out


def own_prose(node: Node) -> str | None:
    """The text by which a node scores: a paragraph's, or the loose text that
    lies directly in a container."""
    if node.tag in PARAGRAPH:
        return None if any(not isinstance(c, str) and c.tag in BLOCK and not c.drop for c in node.children) else flat_text(node)
    if node.tag in ("div", "section", "article", "main", "body"):
        loose = SPACE.sub(" ", "".join(c if isinstance(c, str) else flat_text(c) if c.tag not in BLOCK else " "
                                       for c in node.children if isinstance(c, str) or not c.drop)).strip()
        return loose or None
    return None


def link_density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, named = parse(page)
    leave_out_named(root, named)
    text = best_text(root)
    if not text and any(n.named == 1 for n in named):  # a second try with the layout's parts
        for n in named:
            n.drop = n.named == 2
        return best_text(root)
    return text


def best_text(root: Node) -> str:
    """The text of the best container and its siblings."""
    order = measure(root)
    scored = set()
    for n in order:
        n.score = 0.0
    for n in order:
        prose = own_prose(n)
        if not prose:
            continue
        points = 1.0 + sum(prose.count(c) for c in ",،，、") + min(len(prose) / 100.0, 3.0)
        up = n if n.tag not in PARAGRAPH else n.parent
        for share in (1.0, 0.5, 1 / 3):
            if up is None or up.tag in ("#root", "html"):
                break
            up.score += points * share
            scored.add(up)
            up = up.parent
    best = None
    for n in order:
        if n in scored:
            n.score *= 1.0 - link_density(n)
            if best is None or n.score > best.score:
                best = n
    if best is None:  # no paragraph: whatever text there is
        return "\n".join(blocks(root))
    # An <article> or <main> around the best container holds the whole article.
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("body", "article", "main"):
        near = max(10.0, best.score * 0.2)
        kept = [n for n in best.parent.children if n is best or not isinstance(n, str) and not n.drop and _sibling(n, near)]
    return "\n".join(b for n in kept for b in blocks(n))


def _sibling(node: Node, near: float) -> bool:
    if node.tag in ("article", "section", "div") and node.score >= near:
        return True
    if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and node.chars:
        return link_density(node) < 0.5
    if node.tag in PARAGRAPH or node.tag == "blockquote":
        return node.chars > 0 and link_density(node) < 0.25
    return False


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (must have ``html``) with the column ``text`` instead of html."""

    def start():
        return lambda texts: ([main_text(t) for t in texts],)

    return add_columns(pages, ["html"], [("text", "string")], start).drop("html")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(load(spark, sf_dir, "pages"), "page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))
