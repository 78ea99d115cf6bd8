"""References against the examples of RFC 3986 (5.4) and the standard library; links that lead nowhere."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from proofmill.functions import uris as U
from proofmill.operators import links as L

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, sections 5.4.1 and 5.4.2.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    return [x.t for x in df.select("i", U.resolve(F.col("b"), F.col("r")).alias("t")).orderBy("i").collect()]


def test_examples_of_the_rfc(spark):
    assert dict(zip(EXAMPLES, resolved(spark, [(BASE, r) for r in EXAMPLES]), strict=True)) == EXAMPLES


def test_random_references(spark):
    rnd = random.Random(1)
    bits = ["a", "b", "..", ".", "c.d", "é"]
    ref = lambda: rnd.choice(["", "/", "../", "./", "?q=1", "#f"]) + "/".join(rnd.choice(bits) for _ in range(rnd.randint(1, 6))) + rnd.choice(["", "/", "?x", "#y", "?x#y"])
    pairs = [("https://h.org/" + "/".join(rnd.choice(["p", "q", "r"]) for _ in range(rnd.randint(0, 4))), ref()) for _ in range(400)]
    assert resolved(spark, pairs) == [urljoin(b, r) for b, r in pairs]
    assert resolved(spark, [(None, "a"), ("http://h/", None)]) == [None, None]


def test_canonical(spark):
    rows = [("HTTP://Ex.Org:80#x", "http://ex.org/"), ("https://e:443/A?b#c", "https://e/A?b"), ("https://e:80/", "https://e:80/"), ("mailto:A@b", "mailto:A@b"), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, u string")
    assert [r.c for r in df.select("i", U.canonical(F.col("u")).alias("c")).orderBy("i").collect()] == [w for _, w in rows]


def test_links_with_reasons(spark):
    html = '<base href="/sub/"><a href="x">1</a><a href="../home#p">2</a><a href="javascript:go()">3</a><a>4</a><!-- <a href="/c"> --><a href=\'/../y\'>5</a><a href="HTTP://E:80/home">6</a><a href="">7</a>'
    pages = spark.createDataFrame([(1, "http://e/home", html), (2, None, "<a href=x>"), (3, "http://e/sub/x?1", None), (None, "nowhere", '<a href="/x">')], "k int, url string, html string")
    got = sorted((str(r.k), r.ref, r.target, r.reason) for r in L.unresolved(L.page_references(pages, "k", "url", "html"), pages, "k", "url").collect())
    assert got == [("1", "", "http://e/sub/", "absent"), ("1", "/../y", "http://e/y", "leaves_root"), ("1", "javascript:go()", "javascript:go()", "other_scheme"), ("1", "x", "http://e/sub/x", "absent"), ("2", "x", None, "no_base"), ("None", "/x", "/x", "no_base")]


def test_no_links_no_rows(spark):
    pages = spark.createDataFrame([], "k int, url string, html string")
    assert L.unresolved(L.page_references(pages, "k", "url", "html"), pages, "k", "url").count() == 0
