"""Queries over stored pages: cards with their links, surfaces, and links that lead nowhere."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.operators import links as L
from proofmill.operators import pages as P

#: Kinds of links of the query, by the start of their path.
KINDS = {"owner": r"^/@", "collection": r"^/(?:tag|music|effect|playlist)/"}
#: What the stored pages lack is written into their own markup: owners, collections, an author header, links in paid and hidden parts.
DRESS = [
    (r'<li><a href="/([A-Z][^"/]*)"', r'<li><a href="/@$1"'),
    (r'<li><a href="/([^"/@]{1,3})"', r'<LI class=card><A title="a > b" HREF=\'/tag/$1\''),
    (r"<h1>", r'<h1><a rel="me author" href="/@page">by</a>'),
    (r'<div class="ad">', r'<div class="box ad"><ul><li><a href="/paid">x</a></li></ul>'),
    (r"<footer>", r'<footer style="display: none"><ul><li><a href="/tag/gone">x</a></li></ul>'),
]
_SQL_HTML = "html"
for _old, _new in DRESS:
    _SQL_HTML = f"regexp_replace({_SQL_HTML}, '{_old}', '{_new.replace(chr(92) + chr(39), chr(39) * 2).replace('$1', chr(92) + '1')}', 'g')"


def dressed(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    for old, new in DRESS:
        html = F.regexp_replace(html, old, new.replace("\\'", "'"))
    return pages.withColumn("html", html)


@query(f"""
WITH d AS (SELECT page_id, {_SQL_HTML} AS html FROM pages),
l AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:li|LI class=card)><(?:a href="|A title="a > b" HREF=.)(/[^"'']*)', 1)) AS link, generate_subscripts(regexp_extract_all(html, '<(?:li|LI class=card)><(?:a href="|A title="a > b" HREF=.)(/[^"'']*)', 1), 1) AS n FROM d),
k AS (SELECT page_id, replace(link, '&amp;', '&') AS link, max(n) AS n FROM l WHERE link NOT IN ('/paid', '/tag/gone') GROUP BY ALL)
SELECT page_id, link AS card, CASE WHEN starts_with(link, '/@') THEN link ELSE '/@page' END AS owner, link,
       CASE WHEN starts_with(link, '/@') THEN 'owner' WHEN starts_with(link, '/tag/') THEN 'collection' ELSE 'other' END AS kind
FROM k
""")
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of every page, outside paid and hidden parts, the last of each id, with owner, links and their kinds."""
    cards = P.page_cards(dressed(table(spark, sf_dir, "pages")), "page_id", "html", lambda name, tag: name == "li", KINDS)
    return cards.drop("pos")


@query(r"""
WITH t AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<![^>]*>', '', 'g') AS h FROM pages),
g AS (SELECT page_id, regexp_extract_all(h, '<[a-z][^>]*>') AS starts, regexp_extract_all(h, '</[a-z][^>]*>') AS ends, regexp_replace(regexp_replace(h, '<div class="ad">[^<]*</div>', '', 'g'), '<[^>]*>', '', 'g') AS words FROM t)
SELECT page_id, len(starts) AS tags, len(list_filter(starts, lambda x: regexp_matches(x, '^<a [^>]*href='))) AS links,
       len(list_filter(starts, lambda x: NOT regexp_matches(x, '^<(meta|br)\b'))) - len(ends) AS unclosed_less_stray, length(words) AS visible_chars
FROM g
""")
def page_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, links, how many more start tags than end tags, and the characters outside paid parts of every stored page."""
    s = P.page_surface(table(spark, sf_dir, "pages"), "page_id", "html")
    return s.select("page_id", "tags", "links", (F.col("unclosed") - F.col("stray")).alias("unclosed_less_stray"), "visible_chars")


#: References written into each page, with the reason why each leads nowhere; those without a reason lead to the page itself.
_REFS = [("{url}#part", None), ("#top", None), ("//{host}/a/./b/../..{tail}", None), ("mailto:a@example.org", "other_scheme"), ("../../../../x", "leaves_root"), ("?none=1", "absent"), ("/no/./where/../{id}", "absent")]
_HOST, _TAIL = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)", "regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1)"


def linked(pages: DataFrame) -> DataFrame:
    """pages with more references before the end of their markup."""
    html = F.col("html")
    for ref, _ in _REFS:
        parts = [F.expr({"url": "url", "host": _HOST, "tail": _TAIL, "id": "cast(page_id as string)"}[p[1:-1]]) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", ref) if p]
        html = F.concat(html, F.lit('<a href="'), *parts, F.lit('">x</a>'))
    return pages.withColumn("html", html)


@query(f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^([^:]+)://', 1) AS scheme, {_TAIL} AS tail, html FROM pages),
nav AS (SELECT page_id, scheme, host, replace(unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)), '&amp;', '&') AS ref FROM p),
dead AS (SELECT page_id, ref, scheme || '://' || host || ref AS target, 'absent' AS reason FROM nav WHERE scheme || '://' || host || ref NOT IN (SELECT scheme || '://' || host || tail FROM p))
SELECT * FROM dead
UNION ALL SELECT page_id, 'mailto:a@example.org', 'mailto:a@example.org', 'other_scheme' FROM p
UNION ALL SELECT page_id, '../../../../x', scheme || '://' || host || '/x', 'leaves_root' FROM p
UNION ALL SELECT page_id, '?none=1', scheme || '://' || host || regexp_replace(tail, '[?].*$', '') || '?none=1', 'absent' FROM p
UNION ALL SELECT page_id, '/no/./where/../' || page_id, scheme || '://' || host || '/no/' || page_id, 'absent' FROM p
""")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page that leads to no page of the table, with its target and the reason."""
    pages = table(spark, sf_dir, "pages")
    return L.unresolved(L.page_references(linked(pages), "page_id", "url", "html"), pages, "page_id", "url").drop("pos")


@query("""
WITH f AS (SELECT page_id, 'docs/' || (page_id % 7) || '/p' || page_id || '.md' AS path FROM pages)
SELECT path, '../' || (page_id % 5) || '/p' || page_id || '.md' AS ref, 'docs/' || (page_id % 5) || '/p' || page_id || '.md' AS target, 'absent' AS reason FROM f WHERE page_id % 5 <> page_id % 7
UNION ALL SELECT path, '../../../up.md', 'up.md', 'leaves_root' FROM f WHERE page_id % 3 = 0
""")
def unresolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown links of files, one for each page, that lead to no file of the set; code and web links don't count."""
    n = F.col("page_id")
    number = lambda c: c.cast("string")
    path = F.concat(F.lit("docs/"), number(n % 7), F.lit("/p"), number(n), F.lit(".md"))
    text = F.concat(
        F.lit("# [web]("), "url", F.lit(")\n```\n[code](none.md)\n```\nsee [self](./p"), number(n), F.lit(".md \"title\") and [other](../"), number(n % 5), F.lit("/p"), number(n), F.lit(".md#a)"),
        F.when(n % 3 == 0, " or [up](../../../up.md)").otherwise(""),
    )
    files = table(spark, sf_dir, "pages").select(path.alias("path"), text.alias("text"))
    return L.unresolved(L.file_references(files, "path", "text"), files, "path", "path", files=True).drop("pos")
