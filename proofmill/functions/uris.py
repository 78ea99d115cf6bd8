"""References of pages and files resolved by RFC 3986, as column expressions.

A reference that is null gives null; an empty one names its base; one whose
scheme has no hierarchy (mailto:, data:) stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the expression of RFC 3986, appendix B; groups 2, 4, 5, 7 and 9 are scheme, authority, path, query and fragment.
PARTS = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
#: Ports that a scheme has anyway.
PORTS = {"http": "80", "https": "443"}


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value computed once, however often of names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def uri_parts(uri: Column) -> Column:
    """struct of scheme, authority, query, fragment (NULL where absent) and path (empty where absent)."""
    got = lambda group, present: F.when(F.regexp_extract(uri, PARTS, present) != "", F.regexp_extract(uri, PARTS, group))
    scheme = F.nullif(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(""))
    return F.struct(scheme.alias("scheme"), got(4, 3).alias("authority"), F.regexp_extract(uri, PARTS, 5).alias("path"), got(7, 6).alias("query"), got(9, 8).alias("fragment"))


def _fold(path: Column) -> Column:
    """struct(kept segments, how often .. went above the root) of a path's segments."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("above"))
    parent = lambda a: F.struct(F.slice(a["kept"], 1, F.greatest(F.size(a["kept"]) - 1, F.lit(0))).alias("kept"), (a["above"] + F.when(F.size(a["kept"]) == 0, 1).otherwise(0)).alias("above"))
    step = lambda a, s: F.when(s == ".", a).when(s == "..", parent(a)).otherwise(F.struct(F.array_append(a["kept"], s).alias("kept"), a["above"].alias("above")))
    return F.aggregate(F.split(F.regexp_replace(path, "^/", ""), "/"), start, step)


def without_dots(path: Column) -> Column:
    """Section 5.2.4: . and .. taken out; a path that ends in one of them ends in a slash; .. at the root stays there."""

    def kept(p: Column, plain: Column) -> Column:
        rooted = F.concat(F.when(p.startswith("/"), "/").otherwise(""), plain)
        return F.when(p.rlike(r"(?:^|/)\.\.?$") & (plain != ""), F.concat(rooted, F.lit("/"))).otherwise(rooted)

    return _let(path, lambda p: F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), _let(F.array_join(_fold(p)["kept"], "/"), lambda plain: kept(p, plain))).otherwise(p))


def goes_above(path: Column) -> Column:
    """Whether .. would leave the root."""
    return _fold(path)["above"] > 0


def _merged(base: Column, ref: Column) -> Column:
    """The path before dots are taken out, section 5.2.3."""
    folder = F.when(base["authority"].isNotNull() & (base["path"] == ""), "/").otherwise(F.regexp_replace(base["path"], "(?s)[^/]*$", ""))
    return F.when(ref["path"] == "", base["path"]).when(ref["path"].startswith("/"), ref["path"]).otherwise(F.concat(folder, ref["path"]))


def _joined(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column | None = None) -> Column:
    some = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    parts = [some("", scheme, ":"), some("//", authority), path, some("?", query)]
    return F.concat(*parts, *([] if fragment is None else [some("#", fragment)]))


def resolve(base: Column, ref: Column) -> Column:
    """The target of ref as seen from base, section 5.2.2."""

    def target(two: Column) -> Column:
        b, r = two["b"], two["r"]
        full, net = r["scheme"].isNotNull(), r["authority"].isNotNull()
        opaque, own = full & ~net & ~r["path"].startswith("/"), full | net
        path = F.when(own, r["path"]).otherwise(_merged(b, r))
        stays = opaque | (~own & (r["path"] == ""))
        query = F.when(own | (r["path"] != ""), r["query"]).otherwise(F.coalesce(r["query"], b["query"]))
        return _joined(F.coalesce(r["scheme"], b["scheme"]), F.when(own, r["authority"]).otherwise(b["authority"]), F.when(stays, path).otherwise(without_dots(path)), query, r["fragment"])

    return F.when(base.isNotNull() & ref.isNotNull(), _let(F.struct(uri_parts(base).alias("b"), uri_parts(ref).alias("r")), target))


def leaves_root(base: Column, ref: Column) -> Column:
    """Whether ref's dots would go above the root that base lies in."""
    own = lambda r: r["scheme"].isNotNull() | r["authority"].isNotNull()
    path = lambda two: F.when(own(two["r"]), two["r"]["path"]).otherwise(_merged(two["b"], two["r"]))
    return goes_above(_let(F.struct(uri_parts(base).alias("b"), uri_parts(ref).alias("r")), path))


def canonical(uri: Column) -> Column:
    """The page that a full target names: scheme and host in lower case, no default port, no fragment, an empty path is /."""

    def name(p: Column) -> Column:
        scheme, host = F.lower(p["scheme"]), F.lower(p["authority"])
        for known, port in PORTS.items():
            host = F.when(scheme == known, F.regexp_replace(host, f":(?:{port})?$", "")).otherwise(host)
        path = F.when(host.isNotNull() & (p["path"] == ""), "/").otherwise(p["path"])
        return _joined(scheme, host, path, p["query"])

    return F.when(uri.isNotNull(), _let(uri_parts(uri), name))
