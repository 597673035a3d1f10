"""Main text of HTML pages by composite text density.

The page becomes a tree with the end tags that HTML implies, in one pass whose steps do not
depend on the depth of the tree. Parts that are beside the article by their nature go first:
scripts, styles, menus, page headers and footers, sidebars, forms, hidden elements, and
blocks whose class, id or role names an advert, notice, menu or comment section.

For every node four counts are kept: characters, tags, characters in links, link tags. Its
composite density is its characters per tag, adjusted for links against the page's own share
of links; the sum over its children is its density sum. The container of highest sum is the
core of the article. The lowest density on the path from there to the body is the threshold:
what hangs beside that path (further sections, a lead, a headline) belongs to the article if
it is as dense, or if it is a heading or a text block in which links do not prevail. The path
ends below the body if it meets an article or main element.

Defined results: null, empty or tag-only html gives an empty text; a cut-off tag at the end
is dropped; repeated pages are extracted each; extra columns are ignored. A form, a header or
a block with a telling class stays if it holds an article or main element or an h1; a form also
if it holds most of a page without any of these; of a page header with the page's only h1 the h1
stays. Formulas stay in their line, without the source notes beside them; a dialog counts if open.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.arrowmap import add_columns

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe".split())
NEVER = set("script style noscript iframe template svg annotation annotation-xml nav footer aside form button select textarea input menu head title canvas".split())
MATH = set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = MATH | set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that may stand in a head; any other start tag, and text, ends it.
IN_HEAD = set("base link meta noscript script style template title".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure details address".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag closes, if they are open: by the name of the open element.
CLOSED_BY = {
    "p": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "tr": ["tr", "tbody", "tfoot", "thead"],
    "td": ["td", "th", "tr", "tbody", "tfoot"],
    "th": ["td", "th", "tr", "tbody", "tfoot"],
    "option": ["option", "optgroup"],
}
#: What an open element is not closed across.
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
EVERY_LIMIT = {"body", "article", "main", "section", "div", "table", "blockquote"}
#: End tags of inline elements do not reach out of these.
CELLS = ("td", "th", "article", "body")

#: Own choice: words in class, id or role that name menus, page heads and feet, sidebars,
#: notices, adverts and comments.
BESIDE = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar share sharing social masthead topbar footer contentinfo colophon "
    "sidebar complementary related recommended newsletter subscribe notice alert cookie cookies consent gdpr popup modal overlay banner "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus respond replies".split()
)
#: A class that starts with one of these tells of something else ("no-sidebar").
OTHERWISE = {"no", "not", "has", "have", "with", "without", "show", "is"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?)?")
WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("attributes", "children", "chars", "density", "has_h1", "has_main", "link_chars", "link_tags", "name", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, attributes: dict[str, str] | None = None):
        self.name, self.parent, self.attributes = name, parent, attributes or {}
        self.children: list[Node | str] = []
        self.has_h1 = self.has_main = False


class Tree:
    """Builds the tree; remembers where elements of each name are open."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.open = [self.root]
        self.where: dict[str, list[int]] = defaultdict(list)

    def last(self, names) -> int:
        """Depth of the innermost open element of these names, or -1."""
        return max((self.where[n][-1] for n in names if self.where[n]), default=-1)

    def close_from(self, depth: int) -> None:
        while len(self.open) > depth:
            self.where[self.open.pop().name].pop()

    def end_head(self) -> None:
        """Leave a head whose end tag is left out."""
        if self.open[-1].name == "head":
            self.close_from(len(self.open) - 1)

    def text(self, text: str) -> None:
        if not text.isspace():
            self.end_head()
        self.open[-1].children.append(text)

    def start(self, name: str, attributes: dict[str, str], empty: bool) -> None:
        if name == "html" or name == "body" and self.where["body"]:
            return
        if name not in IN_HEAD:
            self.end_head()
        for closed in OPEN_CLOSED_BY.get(name, ()):
            at = self.where[closed][-1] if self.where[closed] else -1
            if at > self.last(EVERY_LIMIT | LIMITS.get(closed, set())):
                self.close_from(at)
        node = Node(name, self.open[-1], attributes)
        self.open[-1].children.append(node)
        if not empty:
            self.where[name].append(len(self.open))
            self.open.append(node)

    def end(self, name: str) -> None:
        at = self.where[name][-1] if self.where[name] else -1
        if at > 0 and not (name in INLINE and self.last(CELLS) > at):
            self.close_from(at)


#: By start tag, the open elements that it closes.
OPEN_CLOSED_BY: dict[str, list[str]] = defaultdict(list)
for _open, _by in CLOSED_BY.items():
    for _name in _by:
        OPEN_CLOSED_BY[_name].append(_open)
OPEN_CLOSED_BY = dict(OPEN_CLOSED_BY)


def parse(html: str) -> Node:
    """Tree of the page. Quotes hold values only behind an equals sign, as in HTML."""
    tree, at, end = Tree(), 0, len(html)
    while at < end:
        mark = html.find("<", at)
        if mark != at:
            mark = end if mark < 0 else mark
            tree.text(unescape(html[at:mark]))
            at = mark
            continue
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        closing = html.startswith("/", at + 1)
        name = NAME.match(html, at + 1 + closing)
        if name is None:
            if html[at + 1 : at + 2] in ("!", "?", "/"):
                close = html.find(">", at)
                at = end if close < 0 else close + 1
            else:
                tree.text("<")
                at += 1
            continue
        attributes, at = read_attributes(html, name.end())
        if at < 0:
            break
        name = name[0].lower()
        if closing:
            tree.end(name)
            continue
        empty = name in VOID or name in RAW
        tree.start(name, attributes, empty)
        if name in RAW:
            at = raw_end(html, at, name)
    return tree.root


def read_attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from here on and where the tag ends, -1 if the page ends before."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(html, at)
        at = m.end()
        if m[1]:
            found.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
        elif at >= len(html):
            return found, -1
        elif html[at] == ">":
            return found, at + 1
        else:
            at += 1


RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


def raw_end(html: str, at: int, name: str) -> int:
    """Where the element ends whose content is no markup."""
    found = RAW_ENDS[name].search(html, at)
    return found.end() if found else len(html)


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out = [root]
    for n in out:
        out.extend(c for c in n.children if isinstance(c, Node))
    return out


def named_beside(node: Node) -> bool:
    """Whether class, id or role name something beside an article."""
    for key in ("class", "id", "role"):
        for token in node.attributes.get(key, "").lower().split():
            words = WORDS.findall(token)
            if words and words[0] not in OTHERWISE and not BESIDE.isdisjoint(words):
                return True
    return False


def hidden(node: Node) -> bool:
    a = node.attributes
    return node.name == "dialog" and "open" not in a or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").lower().replace(" ", "")


def prune(root: Node) -> None:
    """Replace the parts beside the article by empty nodes, in place."""
    nodes = in_order(root)
    for n in reversed(nodes):
        inner = [c for c in n.children if isinstance(c, Node)]
        n.has_h1 = n.name == "h1" or any(c.has_h1 for c in inner)
        n.has_main = n.has_h1 or n.name in ("article", "main") or any(c.has_main for c in inner)
        n.chars = sum(c.chars if isinstance(c, Node) else len(c.strip()) for c in n.children)
    n_h1 = sum(n.name == "h1" for n in nodes)

    def is_page(n: Node) -> bool:
        """Whether a form is the frame of the page: it holds the article, or most text of a page that marks none."""
        return n.name == "form" and (n.has_main or not root.has_main and 2 * n.chars > root.chars)

    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.name in ("article", "main")
        for i, c in enumerate(n.children):
            if isinstance(c, str):
                continue
            if c.name == "header" and not inside and c.has_h1 and n_h1 == 1:
                c.children = [next(x for x in in_order(c) if x.name == "h1")]
                todo.append((c, inside))
            elif hidden(c) or c.name in NEVER and not is_page(c) or c.name == "header" and not inside or named_beside(c) and not c.has_main and c.name != "body":
                n.children[i] = Node("#gap" if c.name in INLINE or c.name in RAW or c.name in ("button", "select", "input", "svg", "annotation", "annotation-xml") else "#cut", n)
            else:
                todo.append((c, inside))


def measure(root: Node) -> list[Node]:
    """Counts, composite density and density sum of every node."""
    nodes = in_order(root)
    for n in reversed(nodes):
        n.chars = n.link_chars = n.link_tags = n.tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += sum(map(len, c.split()))
            elif c.name[0] != "#":
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.name == "a")
        if n.name == "a":
            n.link_chars = n.chars
    page = root.link_chars / root.chars if root.chars else 0.0
    for n in reversed(nodes):
        n.density = density(n, page)
        n.sum = sum(c.density for c in n.children if isinstance(c, Node) and c.name not in INLINE)
    return nodes


#: Share of links that every node is taken to have besides its own, so that the size of a node
#: without links does not count.
SMOOTH = 0.01


def density(n: Node, page: float) -> float:
    """Characters per tag, weighed by how little of them are links; ``page`` is the page's share."""
    if not n.chars:
        return 0.0
    chars, tags = n.chars, max(n.tags, 1)
    little = chars / (n.link_chars + SMOOTH * chars) * tags / (n.link_tags + SMOOTH * tags)
    base = math.log(chars / (chars - n.link_chars + SMOOTH * chars) * n.link_chars + page * chars + math.e)
    return chars / tags * math.log(max(little, 1.0)) / math.log(base + math.e - 1)


def select(root: Node) -> list[tuple[Node, set[int] | None]]:
    """The path from the body (or the article or main element met) to the core, outermost
    first; each node with the positions of its children that are kept, None for all."""
    nodes = measure(root)
    body = next((n for n in nodes if n.name == "body"), root)
    holders = [n for n in in_order(body) if n is body or n.name not in INLINE and any(isinstance(c, Node) and c.name not in INLINE for c in n.children)]
    core = max(holders, key=lambda n: n.sum)
    path = [core]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    top = next((i for i, n in enumerate(path) if n.name in ("article", "main")), len(path) - 1)
    chosen: list[tuple[Node, set[int] | None]] = [(core, None)]
    for inner, n in zip(path, path[1 : top + 1]):
        chosen.append((n, {i for i, c in enumerate(n.children) if c is inner or isinstance(c, str) or belongs(c, threshold)}))
    return chosen[::-1]


def belongs(n: Node, threshold: float) -> bool:
    """Whether a subtree beside the path is part of the article."""
    if n.name in HEADINGS or n.has_h1 or n.name in INLINE and 2 * n.link_chars <= n.chars:
        return True
    return n.density >= threshold or n.name in TEXT_BLOCKS and 3 * n.link_chars <= n.chars


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, white space folded, one a line."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    chosen = select(root)
    only = {id(n): kept for n, kept in chosen if kept is not None}
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(text)

    todo: list[Node | str | None] = [chosen[0][0]]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            held.append(n)
        elif n.name == "br":
            held.append("\n")
        else:
            if n.name not in INLINE and n.name != "#gap":
                flush()
                todo.append(None)
            kept = only.get(id(n))
            todo.extend(c for i, c in reversed(list(enumerate(n.children))) if kept is None or i in kept)
    flush()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and text, n_chars (code points of the text)."""

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [main_text(x) for x in batch.column("__html").to_pylist()]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return add_columns(pages.select(*keep, pages[html].alias("__html")), make, "text string, n_chars bigint", drop=("__html",))
