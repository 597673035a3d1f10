"""Density selection against a plain recursive version, broken pages and odd rows."""

import math
import random
import time

import pytest
from corpusloom.llm import html_text

ARTICLE = "Some long text of the article, in one block of words."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<article><div class="entry-header"><h1>Title</h1></div><p>{ARTICLE}</p></article>', f"Title\n{ARTICLE}"),
        (f"<header><h1>Headline</h1><nav>x</nav></header><div><p>{ARTICLE}</p><p>more</p></div>", f"Headline\n{ARTICLE}\nmore"),
        (f"<header><p>Banner</p></header><div><h1>T</h1><p>{ARTICLE}</p></div>", f"T\n{ARTICLE}"),
        ("<p title=it's>Text one</p><p>two</p>", "Text one\ntwo"),
        (f"<form><div class='layout no-sidebar'><h1>T</h1><p>{ARTICLE}</p></div><div class=sidebar><p>beside the text</p></div></form>", f"T\n{ARTICLE}"),
        ("a <script>x</script>b<div class=ad>no</div>c", "a b\nc"),
        (f"<div><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div><a href=x>one</a> <a href=y>two</a> <a href=z>three</a></div></div>", f"{ARTICLE}\n{ARTICLE}"),
        (f"<div><section><h2>A</h2><p>{ARTICLE}</p><p>{ARTICLE}</p></section><section><h2>B</h2><p>{ARTICLE}</p></section></div>", f"A\n{ARTICLE}\n{ARTICLE}\nB\n{ARTICLE}"),
        (f"<div id=main><p>{ARTICLE}</p><ul><li>x<li>y</ul></div><div id=comments><p>{ARTICLE}</p><p>{ARTICLE}</p><p>I agree</p></div>", f"{ARTICLE}\nx\ny"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        (f"<!DOCTYPE html><head><title>x</title><body><article><h1>T</h1><p>{ARTICLE}</p><p>more</p></article>", f"T\n{ARTICLE}\nmore"),
        (f"<head><meta charset=utf-8><title>x</title><style>p{{}}</style><h1>T</h1><p>{ARTICLE}<p>more", f"T\n{ARTICLE}\nmore"),
        (f"<title>x</title><p>{ARTICLE}<p>more", f"{ARTICLE}\nmore"),
        ("<head>\n  <title>x</title>\n  Words in front of all tags", "Words in front of all tags"),
        ("<article><p>We have <math><mi>x</mi><mo>=</mo><mfrac><mn>2</mn><mn>3</mn></mfrac></math> as shown.</p></article>", "We have x=23 as shown."),
        ("<article><p>So <math><semantics><mi>y</mi><annotation encoding=tex>\\\\y</annotation></semantics></math> holds.</p><object data=x><p>A film on rivers.</p></object></article>", "So y holds.\nA film on rivers."),
        (f"<body><form action=/page><div><p>{ARTICLE}</p><p>more</p><input name=q><button>Go</button></div></form>", f"{ARTICLE}\nmore"),
        (f"<article><h1>T</h1><p>{ARTICLE}</p></article><form><p>{ARTICLE}</p><p>{ARTICLE}</p></form>", f"T\n{ARTICLE}"),
        (f"<article><p>{ARTICLE}</p><dialog><p>Sign up</p></dialog><dialog open><p>Seen</p></dialog></article>", f"{ARTICLE}\nSeen"),
    ],
)
def test_articles_of_many_shapes(html, text):
    assert html_text.main_text(html) == text


def plain(node, page=None):
    """Characters, tags, link characters, link tags, density and density sum by recursion."""
    c = t = lc = lt = 0
    below = []
    for child in node.children:
        if isinstance(child, str):
            c += len("".join(child.split()))
        elif child.name not in ("#cut", "#gap"):
            x = plain(child, page)
            c, t, lc, lt = c + x[0], t + x[1] + 1, lc + x[2], lt + x[3] + (child.name == "a")
            if child.name not in html_text.INLINE:
                below.append(x[4])
    if node.name == "a":
        lc = c
    page = (lc / c if c else 0.0) if page is None else page
    d = 0.0
    if c:
        e, m = 0.01, max(t, 1)
        base = math.log(c * lc / (c - lc + e * c) + page * c + math.e)
        d = c / m * math.log(max(1.0, c * m / ((lc + e * c) * (lt + e * m)))) / math.log(base + math.e - 1)
    return c, t, lc, lt, d, sum(below)


def page_of(rnd, depth=0):
    out = []
    for _ in range(rnd.randrange(1, 5)):
        kind = rnd.choice(["p", "div", "section", "ul", "a", "b"]) if depth < 4 else "p"
        text = " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 30)))
        if kind in ("div", "section"):
            out.append(f"<{kind}>{page_of(rnd, depth + 1)}</{kind}>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li><a href=x>{text[:12]}</a>" for _ in range(rnd.randrange(1, 5))) + "</ul>")
        else:
            out.append(f"<{kind}>{text}</{kind}>")
    return "".join(out)


def test_densities_equal_a_plain_recursion():
    rnd = random.Random(5)
    for _ in range(60):
        root = html_text.parse(f"<html><body>{page_of(rnd)}</body></html>")
        html_text.prune(root)
        chosen = html_text.select(root)
        page = root.link_chars / root.chars if root.chars else 0.0
        nodes = html_text.in_order(root)
        for n in nodes:
            want = plain(n, page)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == want[:4]
            assert n.density == pytest.approx(want[4]) and n.sum == pytest.approx(want[5])
        body = next(n for n in nodes if n.name == "body")
        core, up = chosen[-1][0], chosen[-1][0]
        holders = [n for n in html_text.in_order(body) if n is body or n.name not in html_text.INLINE and any(not isinstance(c, str) and c.name not in html_text.INLINE for c in n.children)]
        assert core.sum == max(n.sum for n in holders)
        threshold = core.density
        while up is not body:
            up = up.parent
            threshold = min(threshold, up.density)
        for n, kept in chosen[:-1]:
            for i, c in enumerate(n.children):
                if not isinstance(c, str) and c.density >= threshold:
                    assert i in kept


@pytest.mark.parametrize("html", ["<b>x ", "<font>x</b>", "<p>x<div>", "<ul><li>x", "<table><tr><td>x", "<", "<!-", "<script>", '<a x=">" y=', "<i title='"])
def test_broken_pages_take_linear_time(html):
    def seconds(n):
        start = time.process_time()
        html_text.main_text(html * n)
        return time.process_time() - start

    assert seconds(60_000) < 8 * max(seconds(15_000), 0.1)


def test_pages_odd_rows(spark):
    rows = [(1, "u", "<p>a b</p>", "x", 9), (1, "u", "<p>a b</p>", "x", 9), (2, None, None, "y", 9), (None, "u", "", None, 9), (3, "v", "<p>" + "w " * 300_000, "z", 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"][:3], r["n_chars"]) for r in html_text.extract_pages(pages).collect())
    assert got == [(0, "u", "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, "", "", 0), (3, "v", "w w", 599_999)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0
