"""Stored pages as trees: tags as tokens, elements as pairs of tags, cards as subtrees with their links and owner.

A page is cut into tokens by one expression: comments, script and style elements
whole, start and end tags, and the text between.  Each token is a row; from there
on windows over a page's rows rebuild the nesting, and no page is parsed in
Python.

What counts as an element.  Start and end tags of one name pair up as brackets of
that name do: a running depth per name, kept from falling below zero, gives each
tag its level, and a start tag is closed by the next tag of its level.  Broken
nesting has these results: an end tag without its start tag is skipped; a start
tag that nothing closes, and a void or self-closed one, holds nothing; where two
cards cross, what follows the first end belongs to neither; an unfinished comment
or tag reaches to the page's end.  A null page has no tokens; rows with equal or
null keys are pages of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that HTML never closes, and those whose content is no markup.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
TOKEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|<![^>]*>|</?[a-z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*+(?:>|\z)|[^<]+|<"
ATTRIBUTE = r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>]+)))?"
#: Classes and element names that mark paid content.
AD_CLASSES = r"(?i)(?:^|\s)(?:ads?|advert|sponsored|promoted)(?:\s|$)"
AD_NAMES = r"(?i)(?:^|-)ad(?:-|$)"

Rule = Callable[[Column, Column], Column]


def html_tokens(html: Column) -> Column:
    """The page as an array of tokens that joined give the page again."""
    return F.regexp_extract_all(html, F.lit(TOKEN), 0)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, entities decoded; empty without a value; NULL without the attribute."""
    rest = F.regexp_replace(tag, r"(?s)^</?[^\s/>]+|/?>$", "")
    group = lambda i: F.regexp_extract_all(rest, F.lit(ATTRIBUTE), i)
    at = F.array_position(F.transform(group(1), F.lower), name) - 1
    value = F.concat(F.get(group(2), at), F.get(group(3), at), F.get(group(4), at))
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(plain))
    return F.when(at >= 0, value)


def is_hidden(name: Column, tag: Column) -> Column:
    """Attribute hidden, aria-hidden, or a style that shows nothing."""
    style = F.regexp_replace(F.coalesce(attribute(tag, "style"), F.lit("")), r"\s", "")
    return attribute(tag, "hidden").isNotNull() | (F.lower(F.coalesce(attribute(tag, "aria-hidden"), F.lit(""))) == "true") | style.rlike("(?i)display:none|visibility:hidden")


def is_ad(name: Column, tag: Column) -> Column:
    return F.coalesce(attribute(tag, "class"), F.lit("")).rlike(AD_CLASSES) | name.rlike(AD_NAMES)


def page_tokens(pages: DataFrame, key: str, html: str, keep: list[str] | None = None, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """_page (a page's own number), the key, kept columns, pos, token, kind (start, end, void, text, other), name; `of` reduces them before they are shuffled."""
    # The page's number is given below the explode, once a page.
    numbered = pages.select(F.monotonically_increasing_id().alias("_page"), key, *(keep or []), F.col(html).alias("_html"))
    rows = numbered.select("_page", key, *(keep or []), F.posexplode(html_tokens(F.col("_html"))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*)", 1))
    t = F.col("token")
    kind = (
        F.when(t.startswith("<!") | t.rlike(r"(?is)^<(?:script|style)\b"), "other").when(name == "", "text").when(t.startswith("</"), "end")
        .when(name.isin(VOID) | t.endswith("/>"), "void").otherwise("start")
    )
    # One shuffle: every window below is within a page.
    return of(rows.select("*", name.alias("name"), kind.alias("kind"))).repartition("_page")


def paired(tokens: DataFrame) -> DataFrame:
    """tokens with _level (of the name's own brackets) and close: where a start tag's element ends; NULL if it holds nothing."""
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    running = Window.partitionBy("_page", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    summed = tokens.withColumn("_sum", F.sum(step).over(running))
    floor = F.least(F.lit(0), F.coalesce(F.min("_sum").over(before), F.lit(0)))
    level = F.when(F.col("kind") == "start", F.col("_sum") - floor).when(F.col("kind") == "end", F.col("_sum") - floor + 1).otherwise(0)
    same = Window.partitionBy("_page", "name", "_level").orderBy("pos")
    closed = (F.col("kind") == "start") & (F.col("_level") > 0) & (F.lead("kind").over(same) == "end")
    return summed.withColumn("_level", level).withColumn("close", F.when(closed, F.lead("pos").over(same))).drop("_sum")


def _depth(tokens: DataFrame, name: str, opens: Column) -> DataFrame:
    """tokens with a running count of the open elements that `opens` picks among the closed ones; _step is 1 and -1 at their tags."""
    same = Window.partitionBy("_page", "name", "_level").orderBy("pos")
    marked = tokens.withColumn("_open", F.coalesce(opens & F.col("close").isNotNull(), F.lit(False)))
    ends = (F.col("kind") == "end") & F.coalesce(F.lag("_open").over(same), F.lit(False))
    marked = marked.withColumn("_step", F.when(F.col("_open"), 1).when(ends, -1).otherwise(0)).drop("_open")
    return marked.withColumn(name, F.sum("_step").over(Window.partitionBy("_page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def elements(pages: DataFrame, key: str, html: str, keep: list[str] | None = None) -> DataFrame:
    """M02 of pages: key, pos, close, name, tag, depth of every element that holds something, from 1."""
    tree = _depth(paired(page_tokens(pages, key, html, keep)), "depth", F.lit(True))
    return tree.filter("close is not null").select(key, *(keep or []), "_page", "pos", "close", "name", F.col("token").alias("tag"), "depth")


def _card_tags(pages: DataFrame, key: str, html: str, is_card: Rule, is_away: Rule) -> DataFrame:
    """The tags of pages with what cards need of them: neither tags nor texts themselves are shuffled and sorted."""
    name, tag, starts = F.col("name"), F.col("token"), F.col("kind") == "start"
    link = F.col("kind").isin("start", "void") & (name == "a")
    cards = starts & F.coalesce(is_card(name, tag), F.lit(False))
    return page_tokens(pages, key, html, of=lambda rows: rows.filter(F.col("kind").isin("start", "end") | link).select(
        "_page", key, "pos", "name", "kind", (starts & F.coalesce(is_away(name, tag), F.lit(False))).alias("_away"), cards.alias("_card_tag"),
        F.when(cards, F.coalesce(attribute(tag, "data-id"), attribute(tag, "id"))).alias("_own"), F.when(link, F.trim(attribute(tag, "href"))).alias("link"),
        (link & F.array_contains(F.split(F.coalesce(F.when(link, attribute(tag, "rel")), F.lit("")), r"\s+"), "author")).alias("_by"),
    ))


def page_cards(
    pages: DataFrame, key: str, html: str, is_card: Rule, kinds: Mapping[str, str],
    is_away: Rule = lambda name, tag: is_hidden(name, tag) | is_ad(name, tag), owner_kind: str = "owner",
) -> DataFrame:
    """Key, card, owner, link, kind: the links of a page's visible cards in order of their places.

    A card is an element that is_card picks, by name and tag, outside every
    element that is_away picks; a link belongs to the innermost card around it.
    A card's id is its attribute data-id or id, else its first link; of cards
    with one id the last of the page counts.  kinds gives the pattern of each
    kind of link, first match wins, else the kind is other.  The owner is the
    card's first link of owner_kind, else the page's only different visible link
    with rel=author outside cards, else NULL.
    """
    by_page = Window.partitionBy("_page").orderBy("pos")
    seen = _depth(paired(_card_tags(pages, key, html, is_card, is_away)), "away", F.col("_away")).drop("_step", "_away")
    seen = _depth(seen, "inside", F.col("_card_tag") & (F.col("away") == 0))
    here = F.when(F.col("_step") == 1, F.struct("pos", "close", F.col("_own").alias("id")))
    stack = Window.partitionBy("_page", "inside").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.withColumn("_card", F.when(F.col("inside") > 0, F.last(here, ignorenulls=True).over(stack)))
    placed = placed.withColumn("_card", F.when(F.col("_card.close") > F.col("pos"), F.col("_card")))
    links = placed.filter((F.col("away") == 0) & F.col("link").isNotNull())
    kind = F.coalesce(*[F.when(F.col("link").rlike(pattern), name) for name, pattern in kinds.items()], F.lit("other"))
    links = links.select("_page", key, "pos", "link", kind.alias("kind"), F.col("_card.pos").alias("_at"), F.col("_card.id").alias("_id"), (F.col("_by") & F.col("_card").isNull()).alias("_author"))
    authors = F.collect_set(F.when(F.col("_author"), F.col("link"))).over(by_page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    whole = Window.partitionBy("_page", "_at").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.first(F.when(F.col("kind") == owner_kind, F.col("link")), ignorenulls=True).over(whole)
    cards = links.withColumn("_authors", authors).withColumn("owner", F.coalesce(own, F.when(F.size("_authors") == 1, F.col("_authors")[0])))
    cards = cards.withColumn("card", F.coalesce("_id", F.first("link").over(whole))).filter("_at is not null")
    last = F.max("_at").over(Window.partitionBy("_page", "card"))
    return cards.withColumn("_last", last).filter("_at = _last").select(key, "card", "owner", "link", "kind", "pos")


def page_surface(pages: DataFrame, key: str, html: str) -> DataFrame:
    """For each page with tokens: tags, elements, unclosed start tags, stray end tags, links, fields, dialogs, visible characters of text, deepest nesting."""
    tree = _depth(paired(page_tokens(pages, key, html)), "depth", F.lit(True)).drop("_step")
    tree = _depth(tree, "away", is_hidden(F.col("name"), F.col("token")) | is_ad(F.col("name"), F.col("token")))
    n = lambda c: F.count_if(c).alias
    kind, name = F.col("kind"), F.col("name")
    starts = n(kind.isin("start", "void"))("tags")
    ends = F.count_if(kind == "end") - F.count("close")
    return tree.groupBy("_page", key).agg(
        starts, F.count("close").alias("elements"), (F.count_if(kind == "start") - F.count("close")).alias("unclosed"), ends.alias("stray"),
        n((name == "a") & kind.isin("start", "void") & attribute(F.col("token"), "href").isNotNull())("links"), n(kind.isin("start", "void") & name.isin("input", "select", "textarea"))("fields"),
        n((kind == "start") & ((name == "dialog") | (attribute(F.col("token"), "role") == "dialog")))("dialogs"),
        F.sum(F.when((kind == "text") & (F.col("away") == 0), F.length("token")).otherwise(0)).alias("visible_chars"), F.max("depth").alias("deepest"),
    ).drop("_page")
