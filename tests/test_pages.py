"""Cards, elements and tokens of pages against a plain parser, on broken pages too."""

import random
import re

import pytest
from pyspark.sql import functions as F

from proofmill.operators import pages as P

KINDS = {"owner": "^/@", "collection": "^/tag/"}


def tokens(page):
    return [m[0] for m in re.finditer(P.TOKEN.replace("\\z", "\\Z"), page)]


def name_of(t):
    m = re.match(r"</?([A-Za-z][^\s/>]*)", t)
    return m[1].lower() if m else ""


def pairs(page):
    """(start, end, name) of every element: a stack for each name."""
    stacks, out = {}, []
    for i, t in enumerate(tokens(page)):
        name = name_of(t)
        if not name or t.startswith("<!") or re.match(r"(?i)<(script|style)\b", t):
            continue
        if t.startswith("</"):
            if stacks.get(name):
                out.append((stacks[name].pop(), i, name))
        elif name not in P.VOID and not t.endswith("/>"):
            stacks.setdefault(name, []).append(i)
    return sorted(out)


def soup(rnd):
    bits = ["<div>", "</div>", "<DIV hidden>", '<div class="ad x">', "<p>", "</p>", "<br>", "<li>", "</li>", '<li id="k1">', "<li data-id=k2>", "</Li >", '<a href="/@o">o', "<a href='/tag/t?a=1&amp;b=2'>", "</a>", "<a name=x>",
            '<a title="</div>" href=/z>', "text ", "1 < 2 ", "<!-- <li> -->", "<script>if (a<b) '</div>'</script>", "<style>p{}</style>", "<li/>", '<a rel="author" href="/@p">', "</b>", '<span style="display : none">', "</span>"]
    return "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(4)
    return [soup(rnd) for _ in range(300)] + ["", "<", "<!-- open", "<div", "<script>never", "</div></div><div></div>", "<p><p><p></p>"]


def test_tokens_join_to_the_page(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k int, html string")
    for r in df.select("k", P.html_tokens(F.col("html")).alias("t")).collect():
        assert "".join(r.t) == pages[r.k] and r.t == tokens(pages[r.k])


def test_elements_equal_a_stack_for_each_name(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(None, None), (None, "<b></b>"), (None, "<b></b>")], "k int, html string")
    got = {}
    for r in P.elements(df, "k", "html").collect():
        got.setdefault(r.k, []).append((r.pos, r.close, r["name"]))
    assert got.pop(None) == [(0, 1, "b")] * 2
    assert {k: sorted(v) for k, v in got.items()} == {k: pairs(p) for k, p in enumerate(pages) if pairs(p)}


def plain_cards(page):
    toks, found = tokens(page), pairs(page)
    low = lambda i: toks[i].lower()
    away = [(a, b) for a, b, _ in found if " hidden" in low(a) or 'class="ad' in low(a) or "display" in low(a)]
    out = lambda i: not any(a <= i < b for a, b in away)
    cards = [(a, b) for a, b, n in found if n == "li" and out(a)]
    links, authors = [], set()
    for i, t in enumerate(toks):
        m = re.search(r"\shref=([\"']?)([^\"'>]*)\1", t)
        if name_of(t) != "a" or t.startswith("</") or not m or not out(i):
            continue
        around = [a for a, b in cards if a < i < b]
        link = m[2].replace("&amp;", "&")
        if around:
            links.append((max(around), link))
        elif 'rel="author"' in t:
            authors.add(link)
    first, ids = {}, {}
    for a, link in links:
        first.setdefault(a, link)
    for a in first:
        m = re.search(r'(?:data-id|id)="?(\w+)', toks[a])
        ids[a] = m[1] if m else first[a]
    rows = []
    for a, link in links:
        if a == max(x for x in ids if ids[x] == ids[a]):
            owner = next((x for y, x in links if y == a and x.startswith("/@")), next(iter(authors)) if len(authors) == 1 else None)
            rows.append((ids[a], owner, link, "owner" if link.startswith("/@") else "collection" if link.startswith("/tag/") else "other"))
    return rows


def test_cards_equal_a_plain_parser(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k int, html string")
    got = {}
    for r in P.page_cards(df, "k", "html", lambda name, tag: name == "li", KINDS).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.card, r.owner, r.link, r.kind))
    want = {k: plain_cards(p) for k, p in enumerate(pages)}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 40


def test_crossing_cards_leave_the_rest_to_none(spark):
    page = '<li id=a><td id=b><a href="/1"></a></li><a href="/2"></a></td><a href="/3"></a>'
    df = spark.createDataFrame([(1, page)], "k int, html string")
    got = P.page_cards(df, "k", "html", lambda name, tag: name.isin("li", "td"), {}).collect()
    assert [(r.card, r.link) for r in got] == [("b", "/1")]


def test_attributes(spark):
    tag = """<a title=" href='no' > x" DATA-x HREF = "/a?b=1&amp;c=&quot;2&quot;" href=/second rel=author/>"""
    row = spark.createDataFrame([(tag,)], "t string").select(*[P.attribute(F.col("t"), a).alias(a) for a in ("href", "data-x", "title", "rel", "none")]).first()
    assert tuple(row) == ('/a?b=1&c="2"', "", " href='no' > x", "author", None)


def test_surface(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k int, html string")
    got = {r.k: r for r in P.page_surface(df, "k", "html").collect()}
    for k, p in enumerate(pages):
        if tokens(p):
            found = pairs(p)
            assert got[k].elements == len(found)
            ends = sum(t.startswith("</") and bool(name_of(t)) for t in tokens(p))
            assert got[k].stray == ends - len(found)
