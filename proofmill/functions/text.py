"""Column functions on strings, urls and identities.

Every function takes and returns Columns and keeps unknown apart from empty: a
value that can't be read is NULL, never '' or 0.  Host names and reserved words
are parameters, so the functions fit any site.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path words that can't be account names.
RESERVED_HANDLES = ("accounts", "about", "api", "challenge", "checkpoint", "direct", "developer", "developers", "emails", "explore", "legal", "p", "popular", "privacy", "reel", "reels", "static", "stories", "terms", "tv", "web")
HANDLE = r"^[a-z0-9._]{1,30}$"


def nonempty(c: Column) -> Column:
    """NULL for NULL, empty and white space only."""
    return F.when(F.length(F.trim(c)) > 0, c)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or NULL where the pattern doesn't match (regexp_extract alone gives '')."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def collapse_space(c: Column) -> Column:
    """runs of any Unicode white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def whole_json(c: Column) -> Column:
    """A text as a variant; NULL unless all of it is one JSON value.

    Spark's parser stops after the first value and takes `{"a":1} x` for JSON.
    Inside brackets and inside an object at once, nothing may follow: a text that
    ends either early leaves the other one broken.
    """
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull(), F.try_variant_get(inside, "$.v", "variant"))


def handle_key(c: Column) -> Column:
    """the last path part of a url, or the handle itself, without @ and in lower case."""
    return nonempty(F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?i)https?://[^/]+/", ""), r"^@|/.*$", "")))


def site_path(url: Column, hosts: Sequence[str]) -> Column:
    """the path of an https url on an allowed host, without user or port; else NULL."""
    return F.when((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("AUTHORITY")).isin(*hosts), F.try_parse_url(url, F.lit("PATH")))


def normal_handle(c: Column, hosts: Sequence[str], reserved: Sequence[str] = RESERVED_HANDLES) -> Column:
    """a handle from @name, name or a bare profile url of an allowed host; NULL if it isn't one or is reserved."""
    text = F.trim(c)
    bare = F.when(text.rlike(r"(?i)^https?://"), found(site_path(text, hosts), r"^/([A-Za-z0-9._]{1,30})/?$")).otherwise(F.regexp_replace(text, "^@", ""))
    low = F.lower(bare)
    return F.when(low.rlike(HANDLE) & ~low.isin(*reserved), low)


def account(handle: Column, stable_id: Column, namespace: Column, site: str) -> Column:
    """struct of entity key and identity status: a namespaced id, else a provisional handle, else invalid."""
    stable = nonempty(stable_id).isNotNull() & nonempty(namespace).isNotNull()
    return F.struct(
        F.when(stable, F.concat(F.lit(f"{site}:"), F.trim(namespace), F.lit(":"), F.trim(stable_id))).when(handle.isNotNull(), F.concat(F.lit(f"{site}:handle:"), handle)).alias("entity_key"),
        F.when(stable, "namespaced_id_supplied").when(handle.isNotNull(), "provisional_handle").otherwise("invalid").alias("identity_status"),
    )


def work_url(url: Column, hosts: Sequence[str]) -> Column:
    """struct of format, shortcode (case kept) and author of a post or reel url; NULL if it is none."""
    pattern = r"^/(?:([A-Za-z0-9._]{1,30})/)?(p|reels?)/([A-Za-z0-9_-]+)/?$"
    path = site_path(url, hosts)
    kind = F.regexp_extract(path, pattern, 2)
    return F.when(path.rlike(pattern), F.struct(F.when(kind == "p", "p").otherwise("reel").alias("format"), F.regexp_extract(path, pattern, 3).alias("shortcode"), nonempty(F.regexp_extract(path, pattern, 1)).alias("author")))


def keep_parameter(url: Column, name: str = "q") -> Column:
    """scheme, host and path with only the repeated parameter `name` kept, in order; no fragment."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.coalesce(found(url, r"^[^?#]*\?([^#]*)"), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{name}="))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def path_only(url: Column) -> Column:
    """scheme, host and path."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def search_url(base: str, query: Column) -> Column:
    """base?q=<percent-encoded query>, space as %20."""
    return F.concat(F.lit(f"{base}?q="), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))


def path_part(url: Column, before: str) -> Column:
    """the path part after /<before>/, percent-decoded where it can be."""
    raw = found(url, rf"^[a-z]+://[^/?#]+/{before}/([^/?#]+)")
    return F.coalesce(F.try_url_decode(raw), raw)


def url_id_agrees(url: Column, item_id: Column, owner: Column, pattern: str) -> Column:
    """both groups of the url pattern equal the owner and the id; NULL without a url."""
    return F.when(url.isNotNull(), (F.coalesce(found(url, pattern, 1), F.lit("")) == owner) & (F.coalesce(found(url, pattern, 2), F.lit("")) == item_id))


def action_key(kind: Column, *parts: Column) -> Column:
    """kind and parts joined by |, unknown parts empty."""
    return F.concat_ws("|", kind, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def canonical_json(**fields: Column) -> Column:
    """JSON of a flat row with keys in order and NULL fields written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def semantic_key(length: int = 64, **fields: Column) -> Column:
    """leading hex digits of the SHA-256 of the canonical JSON."""
    return F.substring(F.sha2(canonical_json(**fields), 256), 1, length)


def fingerprint(values: Column) -> Column:
    """One SHA-256 of a set of texts, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)


def guard_formula(c: Column) -> Column:
    """a text that a spreadsheet would run, or that starts with a control character, gets an apostrophe."""
    return F.when(c.rlike(r"^\s*[=+@-]|^[\t\r\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def escape_illegal_xml(c: Column) -> Column:
    """characters that XML forbids are written \\uXXXX; one replacement for each of the fixed set."""
    out = c
    for code in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFE, 0xFFFF]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return out


def hashtags(c: Column) -> Column:
    """distinct lower-cased tags of letters, digits and _."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"#([\p{L}\p{N}_]+)"), 1), F.lower))


def mentions(c: Column) -> Column:
    """distinct lower-cased @names after a start or white space."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?:^|\s)@([A-Za-z0-9_.]+)"), 1), F.lower))


def caption_matches(shown: Column, full: Column, least: int = 24) -> Column:
    """equal, contained, or cut off by an ellipsis after at least `least` characters."""
    a, b = collapse_space(shown), collapse_space(full)
    cut = F.regexp_replace(a, r"(…|\.\.\.)$", "")
    return (a == b) | F.contains(b, a) | ((F.length(cut) >= least) & (cut != a) & F.startswith(b, cut))


def redact(c: Column, most: int | None = 300) -> Column:
    """urls, bearer tokens, mail addresses and secrets given as key=value, hidden; at most `most` characters of a message, None for whole texts."""
    out = F.regexp_replace(c, r"https?://[^ \n\t]+", "[url]")
    out = F.regexp_replace(out, r"Bearer +[A-Za-z0-9._-]+", "Bearer [secret]")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]")
    out = F.regexp_replace(out, r"(token|password|secret|api_key|cookie)=[^ \n\t&]+", "$1=[secret]")
    return out if most is None else F.substring(out, 1, most)


#: Named patterns of text that must not leave a machine.
LEAK_PATTERNS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github_token": r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{20,}\b",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{12,}\b",
    "bearer_token": r"(?i)\bAuthorization\s*[:=]\s*Bearer\s+[A-Za-z0-9._~+/=-]{12,}",
    "assigned_secret": r"(?i)\b(?:api[_-]?key|access[_-]?token|client[_-]?secret|password|cookie)\b\s*[:=]\s*['\"]?[A-Za-z0-9._~+/=-]{12,}",
    "windows_path": r"(?i)(?<![A-Za-z0-9])(?:[A-Z]:[\\/]{1,2})(?:[^\\/\s'\"`<>|]{2,})(?:(?:[\\/]{1,2})[^\\/\s'\"`<>|]+)*",
    "unc_path": r"(?<![\\])\\\\[A-Za-z0-9][A-Za-z0-9._-]{1,}\\[A-Za-z0-9][A-Za-z0-9$._ -]{1,}|(?<![\\])\\\\\\\\[A-Za-z0-9][A-Za-z0-9._-]{1,}\\\\[A-Za-z0-9][A-Za-z0-9$._ -]{1,}",
    "posix_device_path": r"(?<![A-Za-z0-9_.-])/(?:Users|home|root|mnt|Volumes)/(?:[^\s'\"`<>|]+)",
    "facebook_target": r"(?i)https?://(?:www\.)?facebook\.com/groups/[A-Za-z0-9._-]{4,}",
    "instagram_target": r"(?i)https?://(?:www\.)?instagram\.com/[A-Za-z0-9._]{3,}",
    "tiktok_target": r"(?i)https?://(?:www\.)?tiktok\.com/@[A-Za-z0-9._-]{3,}",
    "reddit_target": r"(?i)https?://(?:www\.)?reddit\.com/r/[^/\s]+/comments/[A-Za-z0-9]{4,}",
}
#: The engine that checks the SQL has no look-behind: there the character before is part of the match, or the text starts.
#: Whether a text matches is the same; what the match covers isn't.
WITHOUT_LOOKBEHIND = {
    "windows_path": r"(?i)(?:^|[^A-Za-z0-9])[A-Z]:[\\/]{1,2}[^\\/\s'\"`<>|]{2,}",
    "unc_path": r"(?:^|[^\\])(?:\\\\[A-Za-z0-9][A-Za-z0-9._-]+\\[A-Za-z0-9][A-Za-z0-9$._ -]+|\\\\\\\\[A-Za-z0-9][A-Za-z0-9._-]+\\\\[A-Za-z0-9][A-Za-z0-9$._ -]+)",
    "posix_device_path": r"(?:^|[^A-Za-z0-9_.-])/(?:Users|home|root|mnt|Volumes)/[^\s'\"`<>|]+",
}
#: Texts of which every match of a pattern holds one, whatever its case: a text without them isn't given to the pattern.
NEEDLES = {
    "private_key": ["PRIVATE KEY-----"], "github_token": ["ghp_", "github_pat_"], "aws_access_key": ["AKIA"], "slack_token": ["xox"], "windows_path": [":\\", ":/"], "unc_path": ["\\\\"],
    "posix_device_path": ["/Users/", "/home/", "/root/", "/mnt/", "/Volumes/"], "facebook_target": ["://"], "instagram_target": ["://"], "tiktok_target": ["://"], "reddit_target": ["://"], "email": ["@"],
}
#: Personal data that the tables hold and the rules above leave alone.
PERSONAL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}


def rule_matches(c: Column, name: str, pattern: str) -> Column:
    """Whether a text matches a named pattern; of the patterns above, only texts with a needle are searched."""
    needles = NEEDLES.get(name, []) if (LEAK_PATTERNS | PERSONAL_PATTERNS).get(name) == pattern else []
    return reduce(or_, [F.contains(c, F.lit(t)) for t in needles]) & c.rlike(pattern) if needles else c.rlike(pattern)


def leaks(c: Column, patterns: dict[str, str] | None = None) -> Column:
    """names of the patterns that a text matches, in order."""
    return F.array_compact(F.array(*[F.when(rule_matches(c, n, p), F.lit(n)) for n, p in sorted((patterns or LEAK_PATTERNS).items())]))


def unescaped(c: Column) -> Column:
    """A text with JSON escapes decoded, and percent-encoding after them; where that can't be done, the text as it is."""
    # A quote counts as escaped after an odd number of backslashes; control characters stay as they are.
    quoted = F.regexp_replace(c, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    decoded = F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    plain = F.coalesce(F.get(decoded, F.lit(0)), c)
    return F.coalesce(F.try_url_decode(plain), plain)


def escaped_leaks(c: Column, tokens: Sequence[str] = (), patterns: dict[str, str] | None = None) -> Column:
    """names of patterns, and the caller's own tokens, found in the text as it is or with its escapes decoded."""
    plain = unescaped(c)
    own = [F.when(F.contains(c, F.lit(t)) | F.contains(plain, F.lit(t)), F.lit(f"token:{t}")) for t in sorted(tokens)]
    return F.array_sort(F.array_union(F.array_union(leaks(c, patterns), leaks(plain, patterns)), F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")))


def synthetic_line(path: Column, line: Column, marker: str = r"(?i)(synthetic|example|fixture|placeholder)") -> Column:
    """a line of a test or fixture file that says that it is made up, or one that only has a placeholder."""
    made_up = path.rlike(r"(?i)(^|/)(tests?|fixtures)/|[._-]test\.") & line.rlike(marker)
    return F.coalesce(made_up, F.lit(False)) | F.coalesce(line.rlike(r"\b(?:REPLACE_WITH|PLACEHOLDER)(?:_[A-Z0-9]+)+\b"), F.lit(False))


def portable_name(path: Column) -> Column:
    """NULL for a portable relative file name, else the first rule that it breaks."""
    part = rf"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"
    return (
        F.when(F.length(path) == 0, "empty")
        .when(path.rlike(r"^/|^[A-Za-z]:"), "absolute")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.rlike(r"(^|/)\.\.(/|$)"), "parent")
        .when(path.rlike(part), "device")
        .when(path.rlike(r'[<>:"|?*\x00-\x1f]'), "character")
        .when(path.rlike(r"[. ](/|$)"), "trailing")
    )


def markdown_links(c: Column) -> Column:
    """targets of inline links, without fragments."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\]\(([^)\s]+)\)"), 1), lambda t: F.regexp_replace(t, "#.*$", "")), lambda t: t != "")


def version(c: Column) -> Column:
    """struct of three numbers, ordered as versions are; NULL if it isn't one."""
    pattern = r"^(\d+)\.(\d+)\.(\d+)$"
    return F.when(c.rlike(pattern), F.struct(*[F.regexp_extract(c, pattern, i + 1).cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def sequence_name(number: Column, width: int = 8, suffix: str = ".json") -> Column:
    """the number padded with zeros and a suffix."""
    return F.concat(F.lpad(number.cast("string"), width, "0"), F.lit(suffix))


def error_code(c: Column) -> Column:
    """the leading upper-case code of a message, else OTHER."""
    return F.coalesce(found(c, r"^([A-Z][A-Z0-9_]{2,63})(?::|$|\s)"), F.lit("OTHER"))


def evidence_id(c: Column) -> Column:
    """F32: forward slashes, no leading snapshots/; NULL if empty."""
    return nonempty(F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "^snapshots/", ""))


def without_placeholder(c: Column, pattern: str = r"(?i)^\s*(no bio yet\.?|n/?a|none|-)\s*$") -> Column:
    """a text that only says that there is none is NULL."""
    return F.when(~c.rlike(pattern), c)


def paid_disclosure(text: Column, brand: Column) -> Column:
    """the text says that the brand pays or gave something, and doesn't deny it."""
    name = F.concat(F.lit(r"\Q"), F.replace(brand, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    said = F.concat(F.lit(r"(?i)(sponsored by|paid partnership with|gifted by|ad for) "), name, F.lit(r"\b"))
    denied = F.concat(F.lit(r"(?i)not (sponsored by|a paid partnership with|gifted by|an ad for) "), name)
    return F.rlike(text, said) & ~F.rlike(text, denied)


def strip_fences(c: Column) -> Column:
    """a text without its fenced code blocks."""
    return F.regexp_replace(c, r"(?s)```.*?```", "")


def base36(number: Column) -> Column:
    """a number in base 36, lower case."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def id_text(value: Column, kind: str) -> Column:
    """an id as text; only integral numbers become one, others are unknown."""
    if kind in ("string", "bigint", "int", "smallint", "tinyint"):
        return value.cast("string")
    return F.when((value == F.floor(value)) & (F.abs(value) < F.lit(2.0**53)), value.cast("bigint").cast("string"))
