"""Closure of links: what each reference resolves to, and those that lead nowhere, each with its reason.

Equal targets are looked up once: a target that a third of all links share is one
row of the anti-join, and the way back to the links is an equality join whose hot
side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.folders import written
from proofmill.functions import text as T
from proofmill.functions import uris as U
from proofmill.operators import pages as P

#: Schemes whose targets are pages.
WEB = ("http", "https")


def page_references(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, base, pos, ref of every a element of a page with an address; a page's first base element moves its base."""
    rows = P.page_tokens(pages, key, html, [url]).filter(F.col("name").isin("a", "area", "base") & F.col("kind").isin("start", "void"))
    href = F.trim(P.attribute(F.col("token"), "href"))
    refs = rows.select("_page", key, F.col(url).alias("base"), "pos", "name", href.alias("ref")).filter("ref is not null")
    moved = refs.filter("name = 'base'").groupBy("_page").agg(F.min_by("ref", "pos").alias("_moved")).withColumnRenamed("_page", "_of")
    own = refs.filter("name <> 'base'").join(moved, F.col("_page") == F.col("_of"), "left")
    return own.select(key, F.coalesce(U.resolve(F.col("base"), F.col("_moved")), F.col("base")).alias("base"), "pos", "ref")


def file_references(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, base, pos, ref of every Markdown link of a file outside fenced code; links to the web and to a place in the same file are none."""
    refs = files.select(path, F.col(path).alias("base"), F.posexplode(T.markdown_links(T.strip_fences(F.col(text)))).alias("pos", "ref"))
    return refs.withColumn("ref", F.regexp_replace(F.trim("ref"), r"\s+[\"'].*$", "")).filter(~F.col("ref").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#|$)"))


def unresolved(refs: DataFrame, known: DataFrame, key: str, known_url: str, files: bool = False) -> DataFrame:
    """Key, pos, ref, target, reason of every reference that leads to no known page or file.

    The reasons, first match: no_base (a null base, or a page's without a scheme),
    other_scheme (pages only), leaves_root, absent.  For files, known_url is
    compared without query and fragment; null known addresses are ignored.
    """
    base, ref, at = F.col("base"), F.col("ref"), F.col("_at")
    target = U.resolve(base, ref)
    same = F.regexp_replace(target, "[?#].*$", "") if files else U.canonical(target)
    found = refs.withColumn("target", target).withColumn("_at", same)
    scheme = F.lower(U.uri_parts(F.col("target"))["scheme"])
    early = F.when(base.isNull() | (F.lit(not files) & U.uri_parts(base)["scheme"].isNull() & scheme.isNull()), "no_base")
    if not files:
        early = early.when(~scheme.isin(*WEB), "other_scheme")
    # Written: three branches read it, and its expressions are dear.
    found = written(found.withColumn("_early", early.when(U.leaves_root(base, ref), "leaves_root")))
    own = F.col(known_url) if files else U.canonical(F.col(known_url))
    names = known.select(own.alias("_name")).filter("_name is not null").distinct()
    absent = found.filter("_early is null").select(at.alias("_target")).distinct().join(names, F.col("_target") == F.col("_name"), "left_anti")
    lost = found.filter("_early is null").join(absent, at == F.col("_target")).withColumn("reason", F.lit("absent"))
    rows = lambda df: df.select(key, "pos", "ref", "target", "reason")
    return rows(found.filter("_early is not null").withColumn("reason", F.col("_early"))).unionByName(rows(lost))
